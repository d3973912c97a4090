"""Repeated word sequences by fixed-block anchors (operator 7).

A word goes if a window of `WINDOW` words that covers it also starts in a document with a smaller id.
Windows are judged on the input.

1. Candidates: each window's word 8-gram of least hash. A repeated window has it in both places, so windows
   none of whose chosen 8-grams occurs again are left out. This loses nothing.
2. Blocks: non-overlapping blocks of `BLOCK` words of each document are the index; every rolling window of
   BLOCK words is a probe. A window of 2 * BLOCK words contains a whole block at any offset. A block content
   is live if a document with a larger id than some block's document has it as a probe.
3. Extension: around each place of a live block all windows of WINDOW words that contain it are compared by
   content (two 64-bit hashes); the first document of each content stays, the windows of later ones go. Their
   union is the maximal exact repeats.

Equal texts are found first, by their hash, and count as repeated whole. Each batch decides first what it can by itself: a block content that is live within a batch, or a window
that a batch holds twice, costs one row a batch at the exchange, however many documents share it.

Defined results: null text has no words; null ids come first; rows with one id (or none) and different texts are
documents of their own, in order of a hash of the text, and the later one counts as of a larger id; repeated rows
(one id and text) are one document and do not remove each other; very long texts are read whole; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import rolling
from corpusmill.llm.common import documents

WINDOW = 50
BLOCK = WINDOW // 2
GRAM = 8
BATCH = 6_000_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
TABLES = [np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) for seed in (7, 8)]
BASE = 0x5851F42D4C957F2D
#: Powers of an odd base and of its inverse, by which a span of bytes gets one hash wherever it stands.
INVERSE = pow(BASE, -1, 1 << 64)


class Words:
    """The words of a batch of rows (_id, text, ...): hashes of all in one sequence, and each document's bounds in it."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat, bounds = rolling.joined(batch.column(1))
        word = ~SPACES[self.flat]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = bounds[1:-1][bounds[1:-1] < len(word)]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
        self.begins, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.begins, bounds)

    def hashes(self, which: int = 0) -> np.ndarray:
        n = len(self.flat)
        power = np.full(n, BASE, np.uint64)
        back = np.full(n, INVERSE, np.uint64)
        if n:
            power[0] = back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLES[which][self.flat] * power)])
        h = (total[self.ends] - total[self.begins]) * back[self.begins]
        return rolling.mix(h + (self.ends - self.begins).astype(np.uint64) * rolling.M1)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, side="right") - 1


def find_anchors(batches: Iterator[pa.RecordBatch], dests: int, hot_at: int) -> Iterator[pa.RecordBatch]:
    for batch in rolling.chunks(batches, BATCH):
        w = Words(batch)
        if not len(w.begins):
            continue
        h = rolling.grams(w.hashes(), GRAM)
        h[~rolling.fits(w.bounds, GRAM)] = rolling.TOP
        chosen = rolling.winnow(h, WINDOW - GRAM + 1, rolling.fits(w.bounds, WINDOW))
        d = w.document(chosen)
        yield from rolling.send_anchors(h[chosen], w.ids[d], chosen - w.bounds[d], dests, hot_at)


def _spread(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in some range first..last, both included."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.clip(first, 0, size), 1)
    np.add.at(change, np.clip(last + 1, 0, size), -1)
    return np.cumsum(change[:-1]) > 0


PLACE = np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<u4")])


def send_blocks(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    """rows (_id, text, anchors) -> kind 0: places of block contents not live here; kind 1: runs of live places; kind 2: contents live here."""
    for batch in rolling.chunks(batches, BATCH):
        row, mark = rolling.numbers(batch.column(2))
        if not len(row):
            continue
        w = Words(batch)
        whole = mark == rolling.ALL
        yield rolling.send_all(np.unique(w.ids[row[whole]]), dests, 1)
        row, mark = row[~whole], mark[~whole]
        place = w.bounds[row] + (mark >> 1)
        ok = rolling.fits(w.bounds, WINDOW)
        windows = np.flatnonzero(_spread(place - (WINDOW - GRAM), place, len(ok)) & ok)
        probes = np.flatnonzero(_spread(windows, windows + WINDOW - BLOCK, len(ok)) & rolling.fits(w.bounds, BLOCK))
        h = rolling.grams(w.hashes(), BLOCK)[probes]
        d = w.document(probes)
        doc, at = w.ids[d], probes - w.bounds[d]
        live = _live(h, doc, at)
        records = np.empty((~live).sum(), PLACE)
        records["h"], records["doc"], records["at"] = h[~live], doc[~live], at[~live]
        yield rolling.packed(records, rolling._dest(records["h"], dests), 0)
        if live.any():
            yield rolling.send_spans(*rolling.runs(doc[live], at[live], 1), dests, 1)
            keys = np.empty(len(known := np.unique(h[live])), rolling.KEY)
            keys["h"] = known
            yield rolling.packed(keys, rolling._dest(known, dests), 2)


def _live(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places whose content has an index block in one document and a probe in one with a larger id."""
    if not len(h):
        return np.zeros(0, bool)
    _, group = np.unique(h, return_inverse=True)
    n = group.max() + 1
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    block = at % BLOCK == 0
    np.minimum.at(first, group[block], doc[block])
    np.maximum.at(last, group, doc)
    return (first < last)[group]


def receive_blocks(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    got = rolling.unpacked(batches, {0: PLACE, 1: rolling.SPAN, 2: rolling.KEY})
    p = got[0]
    live = _live(p["h"], p["doc"], p["at"])
    live |= np.isin(p["h"], got[2]["h"])
    doc, start, end = rolling.runs(p["doc"][live], p["at"][live], 1)
    yield rolling.by_document(np.concatenate([doc, got[1]["doc"]]), np.concatenate([rolling.span(start, end), got[1]["span"]]), dests)


def send_windows(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    """rows (_id, text, runs of live places) -> kind 0: windows by content; kind 1: spans already decided."""
    for batch in rolling.chunks(batches, BATCH):
        row, run = rolling.numbers(batch.column(2))
        if not len(row):
            continue
        w = Words(batch)
        whole = run == rolling.ALL
        yield rolling.send_all(np.unique(w.ids[row[whole]]), dests, 1)
        row, run = row[~whole], run[~whole]
        first, last = w.bounds[row] + (run >> 32), w.bounds[row] + (run & 0xFFFFFFFF) - 1
        ok = rolling.fits(w.bounds, WINDOW)
        starts = np.flatnonzero(_spread(first - (WINDOW - BLOCK), last, len(ok)) & ok)
        d = w.document(starts)
        one, two = (rolling.grams(w.hashes(k), WINDOW)[starts] for k in (0, 1))
        yield from rolling.send_windows(one, two, w.ids[d], starts - w.bounds[d], WINDOW, False, dests, (0, 1))


def receive_windows(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    got = rolling.unpacked(batches, {0: rolling.WINDOW, 1: rolling.SPAN})
    w = got[0]
    order, gone = rolling.later(w["h"], w["g"], w["doc"], w["at"], False)
    doc, start, end = rolling.runs(w["doc"][order][gone], w["at"][order][gone], WINDOW)
    yield rolling.by_document(np.concatenate([doc, got[1]["doc"]]), np.concatenate([rolling.span(start, end), got[1]["span"]]), dests)


def removed_spans(docs: DataFrame, hot_at: int = rolling.HOT) -> DataFrame:
    """docs (_id, text) -> _id, text, found: packed spans of words to remove (they may overlap)."""
    copies = rolling.copies(docs)
    once = rolling.with_found(docs, copies.distinct()).where("found IS NULL")
    anchors = rolling.exchange(once, lambda b, dests: find_anchors(b, dests, hot_at), rolling.receive_anchors)
    places = rolling.exchange(rolling.with_found(docs, rolling.with_copies(anchors, copies)), send_blocks, receive_blocks)
    spans = rolling.exchange(rolling.with_found(docs, places), send_windows, receive_windows)
    return rolling.with_found(docs, spans)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        out = []
        for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            words = (text or "").encode().split()  # splits at exactly the six ASCII spaces
            spans = rolling.merged(np.array(found, np.int64), len(words)) if found and len(words) >= WINDOW else []
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((doc if doc != rolling.NO_ID else None, len(words), len(words) - len(kept), b" ".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, hot_at: int = rolling.HOT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by a space, as UTF-8)."""
    found = removed_spans(rolling.told_apart(docs), hot_at).select("_own", "text", "found")
    return found.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept binary")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


