"""Repeated byte strings by an enhanced suffix array (operator 5).

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a document with a smaller
id, or earlier in the same one. Matches never cross documents and are judged on the input.

1. Anchors: in every window of LENGTH bytes, the 32-byte gram of least hash. A repeated window has its
   anchor in both places, so only anchors that occur again can lie in one; one exchange finds them.
2. The suffixes at those anchors, with LENGTH bytes to the right and what a window can have to the left,
   are dealt out by anchor. Each task sorts its suffixes, builds the common-prefix (LCP) array and finds the
   tree of LCP intervals by a stack scan. All members of an interval share its prefix; where they also
   share what precedes it, it grows to the left, and where left contexts diverge the group is a maximal
   repeat of its own. Each member gets, over all members that come earlier, the longest such left extension;
   prefix and extension of LENGTH bytes or more make a removed span.
3. Spans are gathered by document, joined with the texts and cut out.

Equal texts are found first, by their hash, and count as repeated whole. Groups without bound: equal contexts of one batch are collapsed to the first before they are dealt out;
anchors that one batch holds `HOT` times or more are not gathered at all: their windows are dealt out one by
one, by content, after the batch has kept only the first of each.

Defined results: null text is empty; null ids come first; rows with one id (or none) and different texts are
documents of their own, in order of a hash of the text; repeated rows (one id and text) are one document and do not
make each other later; very long texts are read whole; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import rolling
from corpusmill.llm.common import documents

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM
BATCH = 4_000_000
BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)
BYTES2 = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64)
CONTEXT = np.dtype([("doc", "<i8"), ("at", "<u4"), ("left_n", "u1"), ("right_n", "u1"), ("text", "u1", (LEFT + LENGTH,))])


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, all bytes, bounds) of rows (_id, text, ...)."""
    flat, bounds = rolling.joined(batch.column(1))
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), flat, bounds


def find_anchors(batches: Iterator[pa.RecordBatch], dests: int, hot_at: int) -> Iterator[pa.RecordBatch]:
    """rows (_id, text, ...); copies are left out before."""
    for batch in rolling.chunks(batches, BATCH):
        ids, flat, bounds = _documents(batch)
        if not len(flat):
            continue
        h = rolling.grams(BYTES[flat], GRAM)
        h[~rolling.fits(bounds, GRAM)] = rolling.TOP
        chosen = rolling.winnow(h, LEFT + 1, rolling.fits(bounds, LENGTH))
        d = np.searchsorted(bounds, chosen, side="right") - 1
        yield from rolling.send_anchors(h[chosen], ids[d], chosen - bounds[d], dests, hot_at)


def send_contexts(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    """rows (_id, text, found) -> packed suffixes (kind 0), windows of hot anchors (kind 1), spans already certain (kind 2)."""
    for batch in rolling.chunks(batches, BATCH):
        row, mark = rolling.numbers(batch.column(2))
        if not len(row):
            continue
        ids, flat, bounds = _documents(batch)
        whole = mark == rolling.ALL
        yield rolling.send_all(np.unique(ids[row[whole]]), dests, 2)
        row, mark = row[~whole], mark[~whole]
        place, first = np.unique(bounds[row] + (mark >> 1), return_index=True)
        hot = (mark[first] & 1).astype(bool)
        ok = place < len(flat)
        place, hot = place[ok], hot[ok]
        d = np.searchsorted(bounds, place, side="right") - 1
        yield from _suffixes(ids, flat, bounds, place[~hot], d[~hot], dests)
        if hot.any():
            starts = np.unique((place[hot][:, None] - np.arange(LEFT + 1)).ravel())
            starts = starts[starts >= 0]
            starts = starts[rolling.fits(bounds, LENGTH)[starts]]
            d = np.searchsorted(bounds, starts, side="right") - 1
            one, two = rolling.grams(BYTES[flat], LENGTH)[starts], rolling.grams(BYTES2[flat], LENGTH)[starts]
            yield from rolling.send_windows(one, two, ids[d], starts - bounds[d], LENGTH, True, dests, (1, 2))


def _row_hash(text: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes; the row length is a multiple of 8."""
    out = np.zeros(len(text), np.uint64)
    for column in np.ascontiguousarray(text).view("<u8").T:
        out = rolling.mix(out * rolling.M1 + column)
    return out


def _suffixes(ids: np.ndarray, flat: np.ndarray, bounds: np.ndarray, place: np.ndarray, d: np.ndarray, dests: int) -> Iterator[pa.RecordBatch]:
    if not len(place):
        return
    rows = np.empty(len(place), CONTEXT)
    left, right = np.minimum(place - bounds[d], LEFT), np.minimum(bounds[d + 1] - place, LENGTH)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(LEFT, np.uint8), flat, np.zeros(LENGTH, np.uint8)]), LEFT + LENGTH)
    text = around[place]
    edge = np.flatnonzero((left < LEFT) | (right < LENGTH))
    offset = np.arange(-LEFT, LENGTH)
    text[edge] *= (offset >= -left[edge, None]) & (offset < right[edge, None])
    rows["text"], rows["doc"], rows["at"], rows["left_n"], rows["right_n"] = text, ids[d], place - bounds[d], left, right
    gram = _row_hash(text[:, LEFT : LEFT + GRAM])
    content = rolling.mix(_row_hash(text) + (left * 1000 + right).astype(np.uint64))
    order = np.lexsort((rows["at"], rows["doc"], content))
    rows, gram, content = rows[order], gram[order], content[order]
    new = np.concatenate([[True], content[1:] != content[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    k = np.flatnonzero(first != np.arange(len(rows)))
    f = first[k]
    same = (rows["text"][k] == rows["text"][f]).all(axis=1) & (rows["left_n"][k] == rows["left_n"][f]) & (rows["right_n"][k] == rows["right_n"][f])
    later = np.zeros(len(rows), bool)
    later[k[same & ((rows["doc"][k] != rows["doc"][f]) | (rows["at"][k] != rows["at"][f]))]] = True
    yield rolling.packed(rows[~later], rolling._dest(gram[~later], dests), 0)
    gone = rows[later & (rows["left_n"].astype(int) + rows["right_n"] >= LENGTH)]
    if len(gone):
        yield rolling.send_spans(gone["doc"], gone["at"].astype(np.int64) - gone["left_n"], gone["at"].astype(np.int64) + gone["right_n"], dests, 2)


def common_prefix(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Bytes that rows of a and b share at the start, within their lengths."""
    differ = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
    return np.minimum(np.argmax(differ, axis=1), np.minimum(a_n, b_n))


def sort_rows(text: np.ndarray) -> np.ndarray:
    """Order of byte rows."""
    padded = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    padded[:, : text.shape[1]] = text
    return np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of the common-prefix tree of depth `least` or more, by one stack scan; lcp[i]: of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        begin = i
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            yield d, begin, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def longest_earlier(shared: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For members in order of their left contexts (shared[i]: what i and i + 1 share), the most each shares with one whose place is smaller; -1 if none."""
    n = len(place)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    to_before, to_after = [-1, *shared.tolist()], [*shared.tolist(), -1]
    best = np.full(n, -1)
    for i in np.argsort(-place, kind="stable").tolist():  # take members out, the last place first
        a, b = before[i], after[i]
        best[i] = max(to_before[i], to_after[i])
        both = min(to_before[i], to_after[i])
        if a >= 0:
            after[a], to_after[a] = b, both
        if b < n:
            before[b], to_before[b] = a, both
    return best


def repeats(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CONTEXT records -> (document, start, end) of spans made of strings of LENGTH bytes that start earlier."""
    left, right = rows["text"][:, LEFT - 1 :: -1] if LEFT else rows["text"][:, :0], rows["text"][:, LEFT:]
    place_rank = np.empty(len(rows), np.int64)
    order = np.lexsort((rows["at"], rows["doc"]))
    changed = np.concatenate([[False], (rows["doc"][order][1:] != rows["doc"][order][:-1]) | (rows["at"][order][1:] != rows["at"][order][:-1])])
    place_rank[order] = np.cumsum(changed)
    left_rank = np.empty(len(rows), np.int64)
    left_rank[sort_rows(left)] = np.arange(len(rows))
    suffix = sort_rows(right)  # equal anchors, with which all suffixes begin, come together
    r = rows[suffix]
    lcp = common_prefix(right[suffix[:-1]], right[suffix[1:]], r["right_n"][:-1], r["right_n"][1:])
    nodes = list(lcp_intervals(lcp, GRAM))
    who, back, forth = [], [], []
    pairs = np.array([(d, a) for d, a, b in nodes if b - a == 1], np.int64).reshape(-1, 2)
    i, j = suffix[pairs[:, 1]], suffix[pairs[:, 1] + 1]
    shared = common_prefix(left[i], left[j], rows["left_n"][i], rows["left_n"][j])
    good = (shared + pairs[:, 0] >= LENGTH) & (place_rank[i] != place_rank[j])
    who.append(np.where(place_rank[i] > place_rank[j], i, j)[good])
    back.append(shared[good])
    forth.append(pairs[good, 0])
    for depth, a, b in nodes:
        if b - a == 1:
            continue
        members = suffix[a : b + 1]
        members = members[np.argsort(left_rank[members])]
        extend = common_prefix(left[members[:-1]], left[members[1:]], rows["left_n"][members[:-1]], rows["left_n"][members[1:]])
        if extend.max() + depth < LENGTH:
            continue
        if extend.min() == extend.max():  # no left diversity below the cap: one group, its first place stays
            best = np.where(place_rank[members] == place_rank[members].min(), -1, extend[0])
        else:
            best = longest_earlier(extend, place_rank[members])
        good = best + depth >= LENGTH
        who.append(members[good])
        back.append(best[good])
        forth.append(np.full(good.sum(), depth))
    w, back, forth = np.concatenate(who), np.concatenate(back), np.concatenate(forth)
    at = rows["at"][w].astype(np.int64)
    return rows["doc"][w], at - back, at + forth


def receive_contexts(batches: Iterator[pa.RecordBatch], dests: int) -> Iterator[pa.RecordBatch]:
    got = rolling.unpacked(batches, {0: CONTEXT, 1: rolling.WINDOW, 2: rolling.SPAN})
    docs, spans = [got[2]["doc"]], [got[2]["span"]]
    if len(got[0]):
        doc, start, end = repeats(got[0])
        docs.append(doc)
        spans.append(rolling.span(start, end))
    w = got[1]
    order, gone = rolling.later(w["h"], w["g"], w["doc"], w["at"], True)
    w = w[order][gone]
    doc, start, end = rolling.runs(w["doc"], w["at"], LENGTH)
    docs.append(doc)
    spans.append(rolling.span(start, end))
    yield rolling.by_document(np.concatenate(docs), np.concatenate(spans), dests)


def removed_spans(docs: DataFrame, hot_at: int = rolling.HOT) -> DataFrame:
    """docs (_id, text) -> _id, text, found: the packed spans to cut (they may overlap)."""
    copies = rolling.copies(docs)
    once = rolling.with_found(docs, copies.distinct()).where("found IS NULL")
    anchors = rolling.exchange(once, lambda b, dests: find_anchors(b, dests, hot_at), rolling.receive_anchors)
    spans = rolling.exchange(rolling.with_found(docs, rolling.with_copies(anchors, copies)), send_contexts, receive_contexts)
    return rolling.with_found(docs, spans)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode()
            spans = rolling.merged(np.array(found, np.int64), len(data)) if found and len(data) >= LENGTH else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append((doc if doc != rolling.NO_ID else None, len(data), sum(b - a for a, b in spans), len(spans), b"".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, hot_at: int = rolling.HOT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    found = removed_spans(rolling.told_apart(docs), hot_at).select("_own", "text", "found")
    return found.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
