"""Hashes of all k-grams of a sequence, winnowing, and packed exchanges of what tasks find.

Whole batches of documents are handled as one numpy sequence. What a task sends on is packed: a row holds
an array of records for one destination, so Spark shuffles few, large rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

#: An anchor that one batch holds this often is hot: it is known to repeat, and is not gathered by its key.
HOT = 32
NO_ID = -(1 << 63)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A scrambled copy of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * M2
    x ^= x >> np.uint64(29)
    x *= M1
    return x ^ (x >> np.uint64(32))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] at each i; the last k - 1 places hold TOP. values: uint64, already scrambled."""
    n = len(values)
    out = np.full(n, TOP)
    if n < k:
        return out
    power, size, done, total = values, 1, 0, None
    while size <= k:
        if k & size:
            if total is None:
                total = power[: n - k + 1].copy() if done == 0 else power[done : done + n - k + 1].copy()
            else:
                total *= M1
                total ^= total >> np.uint64(30)
                total += power[done : done + n - k + 1]
            done += size
        if size * 2 <= k:
            nxt = power[:-size] * M2
            nxt ^= nxt >> np.uint64(28)
            nxt += power[size:]
            power = nxt
        size *= 2
    out[: n - k + 1] = np.minimum(mix(total), TOP - np.uint64(1))
    return out


def sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """best (np.minimum or np.maximum) over values[i:i+width] for each i where that fits."""
    size, out = 1, values
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1]) if len(values) >= width else values[:0]


def winnow(hashes: np.ndarray, width: int, starts_ok: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some window of `width` hashes; starts_ok: which windows count."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    least = np.where(starts_ok[: n - width + 1], sliding(hashes, width, np.minimum), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((sliding(np.concatenate([edge, least, edge]), width, np.maximum) == hashes) & (hashes != TOP))


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `size` bytes; a part has one row at least."""
    for batch in batches:
        rows = max(1, int(size * batch.num_rows / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows of a string or binary column, where each row begins; the last entry is the end)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def destinations(df: DataFrame) -> int:
    return 2 * max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed(records: np.ndarray, where: np.ndarray, kind: int) -> pa.RecordBatch:
    """Rows (dest, kind, blob) of a structured array, by destination; blobs hold it field by field, compressed."""
    order = np.argsort(where, kind="stable")
    records, where = records[order], where[order]
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    columns = [np.ascontiguousarray(records[name]) for name in records.dtype.names]
    blobs = [squeeze(b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(where)])]
    return pa.RecordBatch.from_arrays([pa.array(where[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), pa.array(blobs, pa.binary())], names=["dest", "kind", "blob"])


PACKED = "dest int, kind int, blob binary"


def unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """All records of a partition, by kind."""
    found: dict[int, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in kinds.items()}
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data, dtype = expand(blob), kinds[kind]
            rows = np.empty(len(data) // dtype.itemsize, dtype)
            at = 0
            for name in dtype.names:
                field = dtype[name]
                size = len(rows) * field.itemsize
                rows[name] = np.frombuffer(data, field.base, size // field.base.itemsize, at).reshape(len(rows), *field.shape)
                at += size
            found[kind].append(rows)
    return {k: np.concatenate(v) for k, v in found.items()}


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all numbers in a column of lists."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


VALUE = np.dtype([("doc", "<i8"), ("value", "<i8")])


def by_document(doc: np.ndarray, values: np.ndarray, dests: int) -> pa.RecordBatch:
    """Packed rows of int64 values, by document."""
    records = np.empty(len(doc), VALUE)
    records["doc"], records["value"] = doc, values
    return packed(records, _dest(mix(records["doc"].astype(np.uint64)), dests), 0)


FOUND = "_doc long, found array<long>"


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """by_document() rows -> a FOUND row a document."""
    got = unpacked(batches, {0: VALUE})[0]
    got = got[np.argsort(got["doc"], kind="stable")]
    doc = got["doc"]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(np.ascontiguousarray(got["value"])))
    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), lists], names=["_doc", "found"])


def exchange(df: DataFrame, send: Callable, receive: Callable) -> DataFrame:
    """df -> send(batches, dests) -> dealt by destination -> receive(batches, dests) -> dealt by document -> a FOUND row a document.

    Between the tasks go only packed rows, one for each pair of task and destination.
    """
    dests = destinations(df)
    dealt = df.mapInArrow(lambda b: send(b, dests), PACKED).repartition("dest").mapInArrow(lambda b: receive(b, dests), PACKED)
    return dealt.repartition("dest").mapInArrow(gather, FOUND)


def with_copies(found: DataFrame, copies: DataFrame) -> DataFrame:
    return found.union(copies).groupBy("_doc").agg(F.flatten(F.collect_list("found")).alias("found"))


#: Stands for the whole document.
ALL = -1


def copies(docs: DataFrame) -> DataFrame:
    """FOUND rows with ALL for documents (_id, text) whose text a document with a smaller id has."""
    keys = docs.select("_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    first = keys.groupBy("key").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    return keys.join(first, "key").where("_id > first").select(F.col("_id").alias("_doc"), F.array(F.lit(ALL).cast("long")).alias("found"))


def told_apart(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> _id, text, _own: _id orders documents as doc_id does, null first, and is _own, the id, where
    that is enough. Where one id has several texts, _id is a number for each (id, text), in order of id and a hash of the text."""
    hashed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_own"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    texts = hashed.select("_own", "_th").groupBy("_own").agg(F.min("_th").alias("least"), F.max("_th").alias("most"))
    if texts.where("least <> most").isEmpty():
        return hashed.select(F.col("_own").alias("_id"), "text", "_own")
    pairs = cut(hashed.select("_own", "_th").distinct().orderBy("_own", "_th").withColumn("_id", F.monotonically_increasing_id()))
    return hashed.join(pairs, ["_own", "_th"]).select("_id", "text", "_own")


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (_id, text) with the found numbers of each; every use of it with the same docs shares one exchange of the texts."""
    return docs.join(found, docs["_id"] == found["_doc"], "left").select("_id", "text", "found", *[c for c in ("_own",) if c in docs.columns])


# Anchors: places selected by winnowing whose gram occurs again somewhere.

ANCHOR = np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<u4")])
KEY = np.dtype([("h", "<u8")])


def send_anchors(h: np.ndarray, doc: np.ndarray, at: np.ndarray, dests: int, hot_at: int = HOT) -> Iterator[pa.RecordBatch]:
    """Packed rows for one batch's anchors: kind 0 by gram; kind 1 (hot here) by document; kind 2 the hot grams by gram."""
    order = np.argsort(h, kind="stable")
    h, doc, at = h[order], doc[order], at[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    hot = np.bincount(group, minlength=1)[group] >= hot_at if len(h) else new
    records = np.empty(len(h), ANCHOR)
    records["h"], records["doc"], records["at"] = h, doc, at
    yield packed(records[~hot], _dest(h[~hot], dests), 0)
    if hot.any():
        yield packed(records[hot], _dest(mix(doc[hot].astype(np.uint64)), dests), 1)
        keys = np.empty((hot & new).sum(), KEY)
        keys["h"] = h[hot & new]
        yield packed(keys, _dest(keys["h"], dests), 2)


def _dest(h: np.ndarray, dests: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(dests)).astype(np.int32)


def receive_anchors(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    """(document, place * 2 + hot) of each anchor that occurs again."""
    got = unpacked(batches, {0: ANCHOR, 1: ANCHOR, 2: KEY})
    a = got[0][np.argsort(got[0]["h"], kind="stable")]
    h = a["h"]
    same = h[1:] == h[:-1]
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(h) else np.zeros(0, bool)
    hot = np.isin(h, got[2]["h"])
    a, hot = a[again | hot], hot[again | hot]
    yield by_document(np.concatenate([a["doc"], got[1]["doc"]]), np.concatenate([a["at"].astype(np.int64) * 2 + hot, got[1]["at"].astype(np.int64) * 2 + 1]), dests)


# Windows: the earliest place of each content, all later ones reported.

WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("at", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("span", "<i8")])


def span(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | end.astype(np.int64)


def later(h: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order by content and place, which of them in that order are later than the first of their content).

    same_doc: a later place in the first place's document counts too.
    """
    order = np.lexsort((at, doc, g, h))
    h, g, doc, at = h[order], g[order], doc[order], at[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    return order, (doc != doc[first]) | (same_doc & (at != at[first]))


def runs(doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at) of windows of a length -> document, start, end of the runs that windows at neighbouring places make."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(doc) else new
    return doc[new], at[new], at[last] + length


def fits(bounds: np.ndarray, length: int) -> np.ndarray:
    """Which starts leave `length` places within their document; bounds: where each begins, and the end."""
    change = np.zeros(bounds[-1] + 1, np.int32)
    long = np.diff(bounds) >= length
    np.add.at(change, bounds[:-1][long], 1)
    np.add.at(change, bounds[1:][long] - length + 1, -1)
    return np.cumsum(change[:-1]) > 0


def send_windows(h: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int, same_doc: bool, dests: int, kinds: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Packed rows for one batch's windows: the first place of each content by content; later places, already decided, by document."""
    order, gone = later(h, g, doc, at, same_doc)
    h, g, doc, at = h[order], g[order], doc[order], at[order]
    records = np.empty((~gone).sum(), WINDOW)
    records["h"], records["g"], records["doc"], records["at"] = h[~gone], g[~gone], doc[~gone], at[~gone]
    yield packed(records, _dest(records["h"], dests), kinds[0])
    yield send_spans(*runs(doc[gone], at[gone], length), dests, kinds[1])


def send_all(doc: np.ndarray, dests: int, kind: int) -> pa.RecordBatch:
    records = np.empty(len(doc), SPAN)
    records["doc"], records["span"] = doc, ALL
    return packed(records, _dest(mix(records["doc"].astype(np.uint64)), dests), kind)


def send_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, dests: int, kind: int) -> pa.RecordBatch:
    records = np.empty(len(doc), SPAN)
    records["doc"], records["span"] = doc, span(start, end)
    return packed(records, _dest(mix(doc.astype(np.uint64)), dests), kind)


def merged(spans: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Packed spans, or ALL, -> disjoint (start, end), touching ones joined, none beyond `most`."""
    out: list[tuple[int, int]] = []
    if (spans == ALL).any():
        return [(0, most)]
    for s in np.sort(np.unique(spans)).tolist():
        a, b = s >> 32, min(s & 0xFFFFFFFF, most)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
