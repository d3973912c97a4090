"""Packing of documents into token sequences by order-preserving dynamic programming (operator 9).

A document is its token ids and then id 0. The documents of a Spark partition, in their order, form one
stream; the program chooses where to cut it into sequences of at most `length` ids. Cuts lie at document
ends (free), sentence ends (a small penalty), or, inside sentences of over `GRID` ids, on a grid (a larger
one). The cost of a plan is its padding plus its penalties plus a little a sequence; with positions p and
costs f, f(j) = min over p(j) - p(i) <= length of (f(i) + p(i)) + length - p(j) + penalty(j), a sliding
minimum that a monotone queue gives in constant time a cut. Sequences of half and quarter length count as
without padding and are further choices.

Each partition streams its batches and carries at most one open sequence from a batch to the next, so
memory is a batch's ids; nothing is shuffled and nothing depends on other partitions. sequence_id holds the
partition's number in its upper bits.

Defined results: null and empty texts are the one id 0; repeated rows are packed each; null ids stay null;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import documents

LENGTH = 1024
GRID = 16
SENTENCE_PENALTY, GRID_PENALTY, SEQUENCE_COST = 1.0, 4.0, 1.0
#: Text characters tokenised and planned at once.
CHUNK = 3_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts under a tokenizers file, as arrays of unsigned 32-bit numbers.

    A byte-level file whose merges are in the order of their ids is run by tiktoken, which takes such merges and
    is the faster. Texts with characters on which the two may differ in what is a letter, a digit or a space,
    or with an added token's string, go through tokenizers itself.
    """

    #: The split of byte-level tokenizers, and a faster one that does the same where no white space stands beside other.
    PIECE = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    SIMPLE_PIECE = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    WIDE_SPACE = re.compile(r"\s\s")
    UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ϿЀ-ӿぁ-ゖァ-ヺ一-龥가-힣]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split = re.search(r"ByteLevel\(add_prefix_space=False, trim_offsets=\w+, use_regex=True\)", str(self.tokenizer.pre_tokenizer))
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.ranked = self._ranks(path) if split and self.tokenizer.normalizer is None else None
        if self.ranked:
            import tiktoken

            self.full, self.simple = (tiktoken.Encoding("same merges", pat_str=p, mergeable_ranks=self.ranked, special_tokens={}) for p in (self.PIECE, self.SIMPLE_PIECE))
        size = max(self.tokenizer.get_vocab().values()) + 1
        ends = [t[-1:] in (".", "!", "?", "Ċ", "\n") for t in (self.tokenizer.id_to_token(i) or "" for i in range(size))]
        self.ends_sentence = np.array(ends, dtype=bool)

    def _ranks(self, path: str) -> dict[bytes, int] | None:
        """The bytes of all tokens with their ids, or nothing where ids don't ascend with the merges."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as themselves
        hidden = [b for b in range(256) if b not in visible]
        of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        single = [i for t, i in model["vocab"].items() if len(t) == 1]
        if merged != sorted(merged) or max(single) > merged[0]:
            return None
        added = self.tokenizer.get_added_tokens_decoder()
        return {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if i not in added}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self.ranked is None or self.UNSURE.search(t) or (self.added and self.added.search(t)):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append((self.full if self.WIDE_SPACE.search(t) else self.simple).encode_to_numpy(t, disallowed_special=()))
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The Python worker's encoder; workers run many tasks with it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def plan(position: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices of the chosen cuts, first and last included; position starts at 0 and has no gap over length."""
    p, pen = position.tolist(), (penalty + SEQUENCE_COST).tolist()
    n = len(p)
    at = []
    for size in (length // 2, length // 4):
        found = np.minimum(np.searchsorted(position, position - size), n - 1)
        at.append(np.where(position[found] == position - size, found, -1).tolist())
    half, quarter = at
    first = np.searchsorted(position, position - length).tolist()  # the earliest cut in reach
    f, back = [0.0] * n, [0] * n
    queue, g = [0], [0.0]  # cuts in order, and f + p of each, ascending
    head = 0
    for j in range(1, n):
        pj = p[j]
        least = first[j]
        while queue[head] < least:
            head += 1
        i = queue[head]
        best = g[head] + length - pj
        if (k := half[j]) >= 0 and f[k] < best:
            i, best = k, f[k]
        if (k := quarter[j]) >= 0 and f[k] < best:
            i, best = k, f[k]
        f[j] = best = best + pen[j]
        back[j] = i
        best += pj
        while len(queue) > head and g[-1] >= best:
            queue.pop()
            g.pop()
        queue.append(j)
        g.append(best)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidate_cuts(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible cuts of a stream and their penalties; ends: where its documents end."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1] = SENTENCE_PENALTY
    penalty[ends] = 0.0
    penalty[0] = penalty[n] = 0.0
    cuts = np.flatnonzero(np.isfinite(penalty))
    gap = np.diff(cuts)
    grid = min(GRID, length)
    many = (gap - 1) // grid
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
    penalty[np.repeat(cuts[:-1], many) + nth * grid] = GRID_PENALTY
    cuts = np.flatnonzero(np.isfinite(penalty))
    return cuts, penalty[cuts]


def _pieces(doc: list, start: np.ndarray, total: np.ndarray, sizes: np.ndarray, ids: np.ndarray, cuts: np.ndarray, number: int) -> pa.RecordBatch:
    """Rows for the sequences between cuts of a stream of documents; start: ids of each document before the stream."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    upto = cuts[-1]
    bounds = np.unique(np.concatenate([begin[begin <= upto], cuts]))
    low, high = bounds[:-1], bounds[1:]
    d = np.searchsorted(begin, low, side="right") - 1
    s = np.searchsorted(cuts, low, side="right") - 1
    data = np.ascontiguousarray(ids[:upto], dtype="<u4")
    binary = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data)])
    columns = [pa.array([doc[k] for k in d], pa.int64()), pa.array(start[d] + low - begin[d]), pa.array(high - low), binary, pa.array(total[d]), pa.array(s + number), pa.array(low - cuts[s])]
    return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if c.type != pa.binary() else c for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack_stream(rows: Iterable[tuple[list, list[str]]], encoder: Encoder, length: int, first: int) -> Iterator[pa.RecordBatch]:
    """rows: (ids of documents, their texts) in chunks; yields pieces, sequences numbered from first."""
    doc: list = []
    start = total = sizes = np.zeros(0, np.int64)
    ids = np.zeros(0, "<u4")
    for last, (names, texts) in _with_last(rows):
        new = [np.append(x, np.uint32(0)) for x in encoder.encode(texts)]
        counts = np.array([len(x) for x in new], np.int64)
        doc, ids = doc + names, np.concatenate([ids, *new])
        start, total, sizes = np.concatenate([start, np.zeros_like(counts)]), np.concatenate([total, counts]), np.concatenate([sizes, counts])
        if not len(ids):
            continue
        positions, penalty = candidate_cuts(ids, np.cumsum(sizes), encoder.ends_sentence, length)
        cuts = positions[plan(positions, penalty, length)]
        if not last:
            cuts = cuts[:-1]  # the open sequence goes on with the next batch
        if len(cuts) > 1:
            yield _pieces(doc, start, total, sizes, ids, cuts, first)
            first += len(cuts) - 1
        begin, done = np.concatenate([[0], np.cumsum(sizes)]), cuts[-1]
        k = int(np.searchsorted(begin, done, side="right")) - 1
        cut_off = done - begin[k] if k < len(sizes) else 0
        doc, start, total, sizes, ids = doc[k:], start[k:].copy(), total[k:], sizes[k:].copy(), ids[done:]
        if len(sizes):
            start[0] += cut_off
            sizes[0] -= cut_off


def _with_last(items: Iterable) -> Iterator[tuple[bool, object]]:
    it = iter(items)
    try:
        held = next(it)
    except StopIteration:
        return
    for item in it:
        yield False, held
        held = item
    yield True, held


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> a row a piece: SCHEMA; ids: little-endian unsigned 32-bit."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)

        def chunks():
            names, texts, size = [], [], 0
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    names.append(name)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size >= CHUNK:
                        yield names, texts
                        names, texts, size = [], [], 0
            if names:
                yield names, texts

        yield from pack_stream(chunks(), encoder, length, TaskContext.get().partitionId() << 36)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
