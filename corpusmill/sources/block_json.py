"""A data source for trees of block JSON: decoded page layouts as rows of blocks.

Each line of a file, or the whole file, is one document: {"file", "language", "pages": [{"page_number", "blocks": [{"text",
"bbox": [x0, y0, x1, y1]}]}]}. Registered by `register(spark)`, then read in batch or as a stream:

    spark.read.format("block_json").load(folder)

A row a block: relative_path and bytes of its file, file, language, page_number, block_no (position in the page unless
given), text, x0, y0, x1, y1. Documents that are not of this form are skipped, blocks without four numbers too; a
missing folder has no rows. Options: pattern (of file names, *.json), partition_bytes (input a task gets, about). Paths are those
that pyarrow's file systems open on driver and executors.
"""

from __future__ import annotations

import fnmatch
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "relative_path string, bytes long, file string, language string, page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
BATCH_ROWS = 8192


@dataclass
class Files(InputPartition):
    """(path, relative path, bytes) of some files."""

    files: list


def parse_document(text: str) -> list[tuple] | None:
    """(file, language, page_number, block_no, text, x0, y0, x1, y1) of each block; None if this is no document."""
    try:
        doc = json.loads(text)
        pages = doc["pages"]
        rows = []
        for page in pages:
            for n, block in enumerate(page["blocks"]):
                box = block.get("bbox") or []
                if len(box) == 4 and all(isinstance(v, int | float) and math.isfinite(v) for v in box) and isinstance(block.get("text"), str):
                    rows.append((doc.get("file"), doc.get("language"), int(page["page_number"]), int(block.get("block_no", n)), block["text"], *map(float, box)))
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    return rows


def documents_of(text: str) -> Iterator[list[tuple]]:
    """The documents of a file: its lines, or the whole of it."""
    whole = parse_document(text)
    for rows in [whole] if whole is not None else map(parse_document, text.splitlines()):
        if rows:
            yield rows


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.json")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))

    def files(self) -> list[tuple[float, str, str, int]]:
        """(modified, path, relative path, bytes), oldest first."""
        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        kept = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", "."))]
        return sorted((f.mtime_ns or 0, f.path, f.path[len(base.rstrip("/")) + 1 :], f.size or 0) for f in kept)

    def dealt(self, files: list) -> list[Files]:
        """Neighbouring files up to partition_bytes, or one larger file."""
        parts, size = [], 0
        for _, path, relative, n in files:
            if not parts or size + n > self.partition_bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append((path, relative, n))
            size += n
        return parts or [Files([])]

    def partitions(self) -> list[Files]:
        return self.dealt(self.files())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows: list[tuple] = []
        for path, relative, size in partition.files:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            for found in documents_of(text):
                rows += [(relative, size, *r) for r in found]
                while len(rows) >= BATCH_ROWS:
                    yield _batch(rows[:BATCH_ROWS])
                    rows = rows[BATCH_ROWS:]
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class BlockStreamReader(BlockReader, DataSourceStreamReader):
    """New files by (time of change, path): a file that was read must not be changed, nor another appear with an older time."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.files()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.dealt([f for f in self.files() if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        pass


class BlockJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))

    def streamReader(self, schema) -> BlockStreamReader:
        return BlockStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockJson)
