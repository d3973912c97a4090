"""Retrieval over tables of queries: exact vector top-k, reranking, fusion, and the search plans.

Hits are rows (query_id, id, score); ranks break ties by id, on scores of six decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V

#: Queries that may reach the tasks through the driver: so many vectors are fetched and sent with the code.
FEW_QUERIES = 4096
#: Queries, items, and pairs of a query and a scope that one cell of a larger search holds, about; hits that it keeps.
CELL_QUERIES, CELL_ITEMS, CELL_PAIRS, CELL_HITS = 65_536, 4_194_304, 8_388_608, 2_097_152
#: New hits after which the k best are cut out, if no more are kept: a score to reach that is up to date spares more than the cut takes.
FRESH_HITS = 131_072
#: One item of so many is searched before the others, if these are many blocks, for scores that each query's hits reach.
FLOOR_PART = 64
#: Items of a scope that are dealt to a cell together; a larger scope is dealt over several.
SCOPE_ITEMS = 65_536
#: Queries and items that are multiplied at once.
QUERY_BLOCK, ITEM_BLOCK = 1024, 2048
#: Items that are multiplied at once with groups of queries that share their dimensions, and items of a cell that travel as one row.
GROUP_ITEMS, PACK_ITEMS = 4096, 32
#: Scores of such a block that are looked through together, if their largest is near.
STRETCH = 512
#: Dimensions that a group of sparse queries may have together; the cheapest of these is taken.
SHARED = (24, 32, 40, 48)
#: Items of one scope in a batch from which they are multiplied with its queries; fewer are paired one by one.
RUN_ITEMS = 16
#: Pairs that are scored at once in double precision, and found pairs that wait for it.
PAIR_BLOCK, FOUND_PAIRS = 32_768, 262_144
#: Entries of a vector from which on a product may be none in single precision.
LARGEST = 1e15
#: Error that a score of unit vectors in single precision may have, rounding to six decimals included, with room.
SLACK = 1e-5


def best(hits: DataFrame, k: int, item: str = "id") -> DataFrame:
    """The k best of each query with their rank; Spark cuts to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, items: DataFrame, k: int, item: str = "id") -> DataFrame:
    """queries (query_id, q_vector), items (item, vector), unit vectors -> (query_id, item, score, rank).

    Blocks of queries are multiplied with batches of items; each task keeps a running top k. Up to
    FEW_QUERIES queries go with the code and items stay where they are; more are dealt with the items over a grid
    of cells, with the same result. Null and empty vectors have no hits.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q_vector").cast("array<double>").alias("q")).where("size(q) > 0")
    given = items.select(item, F.col("vector").cast("array<double>").alias("vector")).where("size(vector) > 0")
    few = asked.limit(FEW_QUERIES + 1).collect()
    if len(few) <= FEW_QUERIES:
        return best(_topk_of_few([r[0] for r in few], np.array([r[1] for r in few], float), given, k, item), k, item)
    return best(_topk_by_cells(asked, given, k, item), k, item)


class Nearest:
    """The k best items of each of some queries, of items that come in batches: no more than about twice the hits kept are held.

    Scores are first taken in single precision; what may reach a query's k-th best of before is scored in double precision, one
    pair at a time, so that a score does not depend on what it is computed with. Equal scores are settled by id; an item that
    comes again for a query counts once. Where all queries meet all items (whole), equal queries are scored once, and sparse ones in
    groups, over the dimensions that a group's queries have: the others add nothing.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, item: str, spans: np.ndarray | None = None, whole: bool = False, floor: np.ndarray | None = None) -> None:
        self.owners = self.groups = None
        if whole:
            given, asking = floor, ids
            matrix, self.owners = distinct_rows(matrix, np.arange(len(ids)))
            floor = given if given is None or not len(ids) else np.minimum.reduceat(given[self.owners[0]], self.owners[1][:-1])
            self.owners = asking[self.owners[0]], self.owners[1]
            ids = np.arange(len(matrix))
            self.groups = [(at, dims, np.ascontiguousarray(matrix[at] if dims is None else matrix[np.ix_(at, dims)], np.float32)) for at, dims in shared_dimensions(matrix)]
        self.ids, self.matrix, self.k, self.item, self.spans = ids, matrix, k, item, spans
        self.single = None if whole else matrix.astype(np.float32)
        self.scores = np.empty(max((len(g[0]) for g in self.groups), default=0) * -(-GROUP_ITEMS // STRETCH) * STRETCH if whole else min(len(ids), QUERY_BLOCK) * ITEM_BLOCK, np.float32)  # of a block
        self.length = float(np.sqrt((matrix * matrix).sum(axis=-1)).max(initial=0.0))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()  # a score that k items of each query have reached
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = self.kept = 0

    def slack(self, vectors: np.ndarray) -> float:
        return SLACK * max(1.0, self.length * float(np.linalg.norm(vectors, axis=1).max(initial=0.0)))

    def add(self, ids: pa.Array, vectors: np.ndarray, at: np.ndarray | None = None, pages: np.ndarray | None = None) -> None:
        """Different items for all queries, or for those at some places; with spans, an item counts where its page is in a query's."""
        if self.groups is not None:
            return self._add_whole(ids, vectors)
        slack = self.slack(vectors)
        for i in range(0, len(vectors), ITEM_BLOCK):
            some = vectors[i : i + ITEM_BLOCK].astype(np.float32)
            n = len(some)
            for a in range(0, len(self.ids) if at is None else len(at), QUERY_BLOCK):
                own = slice(a, min(a + QUERY_BLOCK, len(self.ids))) if at is None else at[a : a + QUERY_BLOCK]
                floor, single = self.floor[own], self.single[own]
                scores = np.matmul(single, some.T, out=self.scores[: len(single) * n].reshape(len(single), n))
                if self.spans is not None:
                    page = pages[i : i + ITEM_BLOCK]
                    scores[~((page >= self.spans[own, :1]) & (page <= self.spans[own, 1:]))] = -np.inf
                if n >= self.k and np.isneginf(floor).any():
                    known = np.where(np.isnan(scores), -np.inf, scores)  # what is no number is no hit
                    floor = np.maximum(floor, np.partition(known, n - self.k, axis=1)[:, n - self.k] - slack)
                    self.floor[own] = floor
                least = np.maximum(floor - slack, np.finfo(np.float32).min).astype(np.float32)
                # most queries have nothing near in most blocks, which their largest score tells; one that is no number tells nothing
                rows = np.flatnonzero(~(scores.max(axis=1) < least)) if n else ()
                if len(rows):
                    q, c = np.divmod(np.flatnonzero((scores[rows] >= least[rows, None]).ravel()), n)
                    self._score(rows[q] + a if at is None else own[rows[q]], ids, vectors, i + c)

    def _add_whole(self, ids: pa.Array, vectors: np.ndarray) -> None:
        small = (np.abs(vectors) < LARGEST).all(axis=1)
        if not small.all():  # what is no number, or none in single precision, counts in all dimensions: such items are scored in double precision alone
            for i in np.flatnonzero(~small):
                self._score(np.arange(len(self.ids)), ids, vectors, np.full(len(self.ids), i))
            ids, vectors = ids.take(pa.array(np.flatnonzero(small))), vectors[small]
        slack = self.slack(vectors)
        for i in range(0, len(vectors), GROUP_ITEMS):
            some = vectors[i : i + GROUP_ITEMS]
            n, wide = len(some), -(-len(some) // STRETCH) * STRETCH
            turned = np.zeros((some.shape[1], wide), np.float32)
            turned[:, :n] = some.T
            near, found = [], 0
            for own, dims, single in self.groups:
                scores = np.matmul(single, turned if dims is None else turned[dims], out=self.scores[: len(own) * wide].reshape(len(own), wide))
                scores[:, n:] = -np.inf
                floor = self.floor[own]
                if n >= self.k and np.isneginf(floor).any():
                    floor = np.maximum(floor, np.partition(scores, wide - self.k, axis=1)[:, wide - self.k] - slack)
                    self.floor[own] = floor
                least = np.maximum(floor - slack, np.finfo(np.float32).min).astype(np.float32)
                stretches = scores.reshape(-1, STRETCH)
                rows = np.flatnonzero(stretches.max(axis=1) >= np.repeat(least, wide // STRETCH))
                if len(rows):
                    q, at = np.divmod(rows, wide // STRETCH)
                    r, c = np.divmod(np.flatnonzero((stretches[rows] >= least[q, None]).ravel()), STRETCH)
                    near.append((own[q[r]], i + at[r] * STRETCH + c))
                    found += len(r)
                if near and (found > FOUND_PAIRS or single is self.groups[-1][2]):
                    self._score(np.concatenate([q for q, _ in near]), ids, vectors, np.concatenate([c for _, c in near]))
                    near, found = [], 0

    def add_pairs(self, ids: pa.Array, vectors: np.ndarray, at: np.ndarray, places: np.ndarray, pages: np.ndarray | None = None) -> None:
        """Pairs of the query at a place and an item of a batch."""
        if self.spans is not None:
            within = (pages[places] >= self.spans[at, 0]) & (pages[places] <= self.spans[at, 1])
            at, places = at[within], places[within]
        self._score(at, ids, vectors, places)

    def _score(self, at: np.ndarray, ids: pa.Array, vectors: np.ndarray, places: np.ndarray) -> None:
        for a in range(0, len(at), PAIR_BLOCK):
            q, i = at[a : a + PAIR_BLOCK], places[a : a + PAIR_BLOCK]
            scores = np.round(np.einsum("ij,ij->i", self.matrix[q], vectors[i]), 6) + 0.0
            good = scores >= self.floor[q]
            if good.any():
                self.parts.append((q[good], scores[good], ids.take(pa.array(i[good]))))
                self.held += int(good.sum())
                if self.held - self.kept > max(self.kept, FRESH_HITS):
                    self._cut()

    def _cut(self) -> None:
        """Keeps the k best of each query, by score and id; ids are looked at where scores are equal."""
        q, scores = (np.concatenate([p[c] for p in self.parts]) for c in (0, 1))
        items = pa.chunked_array([p[2] for p in self.parts])
        order = np.lexsort((-scores, q))
        q, scores = q[order], scores[order]
        like = np.zeros(len(q) + 1, bool)
        like[1:-1] = (q[1:] == q[:-1]) & (scores[1:] == scores[:-1])
        alike = np.flatnonzero(like[1:] | like[:-1])
        same = np.zeros(len(q), bool)
        if len(alike):
            tied = items.take(pa.array(order[alike])).combine_chunks()
            table = pa.table({"run": np.cumsum(~like[:-1])[alike], "i": tied})
            by = pc.sort_indices(table, sort_keys=[("run", "ascending"), ("i", "ascending")]).to_numpy()
            order[alike], tied, run = order[alike[by]], tied.take(pa.array(by)), table["run"].to_numpy()
            same[alike[1:]] = (run[1:] == run[:-1]) & pc.equal(tied[1:], tied[:-1]).to_numpy(zero_copy_only=False)
        order, q, scores = order[~same], q[~same], scores[~same]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kth = nth == self.k - 1
        self.floor[q[kth]] = np.maximum(self.floor[q[kth]], scores[kth])
        good = nth < self.k
        kept = items.take(pa.array(order[good]))
        self.parts = [(q[good], scores[good], kept.combine_chunks())]
        self.held = self.kept = int(good.sum())

    def hits(self, query_id: str = "query_id") -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            q, scores, items = self.parts[0]
            if self.owners is not None:
                yield from self._owned(q, scores, items, query_id)
                return
            for a in range(0, len(q), 65_536):
                b = slice(a, a + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q[b]]), items[b], pa.array(scores[b])], names=[query_id, self.item, "score"])


    def _owned(self, q: np.ndarray, scores: np.ndarray, items: pa.Array, query_id: str) -> Iterator[pa.RecordBatch]:
        """The hits of equal queries, given to each of them, some at a time."""
        ids, starts = self.owners
        n = (starts[1:] - starts[:-1])[q]
        upto, a = np.cumsum(n), 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 65_536, side="right")))
            rows = np.repeat(np.arange(a, b), n[a:b])
            first = np.repeat(starts[q[a:b]] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + np.arange(len(rows))]), items.take(pa.array(rows)), pa.array(scores[rows])], names=[query_id, self.item, "score"])
            a = b


def distinct_rows(matrix: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The different rows, and the ids of their owners: (ids by row, where a row's begin)."""
    if not len(matrix):
        return matrix, (ids, np.zeros(1, np.int64))
    rows = np.ascontiguousarray(matrix) + 0.0  # no negative zeros
    _, first, place = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return rows[first], (ids[np.argsort(place, kind="stable")], np.append(0, np.cumsum(np.bincount(place, minlength=len(first)))))


def shared_dimensions(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Groups of rows, with the dimensions outside of which all of a group are zero; None: all dimensions.

    A group takes what adds the fewest dimensions, up to one of SHARED. What a group costs is reckoned in products: its rows times its
    dimensions, and what is spent on a row, a dimension and a group.
    """
    n, d = matrix.shape
    blocks = [(np.arange(a, min(a + QUERY_BLOCK, n)), None) for a in range(0, n, QUERY_BLOCK)]
    if not n or d > 64:
        return blocks
    has = ((matrix != 0).astype(np.uint64) << np.arange(d, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    order = np.argsort(has, kind="stable")
    best_cost, found = n * (d + 8.0), None
    for most in SHARED:
        left, bits, groups, cost = order, has[order], [], 0.0
        while len(left) and cost < best_cost:
            shared = bits[0]
            while True:
                more = np.bitwise_count(bits & ~shared)
                more[more == 0] = 255
                nearest = int(more.argmin())
                if more[nearest] == 255 or int(np.bitwise_count(shared)) + int(more[nearest]) > most:
                    break
                shared |= bits[nearest]
            inside = (bits & ~shared) == 0
            dims = np.flatnonzero((shared >> np.arange(d, dtype=np.uint64)) & np.uint64(1))
            own = left[inside]
            groups += [(own[a : a + QUERY_BLOCK], dims) for a in range(0, len(own), QUERY_BLOCK)]
            cost += len(dims) * (len(own) + 24) + 8 * len(own) + 150
            left, bits = left[~inside], bits[~inside]
        if not len(left) and cost < best_cost:
            best_cost, found = cost, groups
    return found or blocks


def as_matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _topk_of_few(ids: list, matrix: np.ndarray, items: DataFrame, k: int, item: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(np.array(ids, np.int64), matrix, k, item, whole=True) if ids else None
        for batch in batches:
            if batch.num_rows and ids:
                near.add(batch.column(0), as_matrix(batch.column(1)))
        if ids:
            yield from near.hits()

    return items.mapInArrow(run, f"query_id long, {item} {dict(items.dtypes)[item]}, score double")


def equal_runs(*values: np.ndarray) -> list[tuple[int, int]]:
    """The (start, end) of runs of rows that are equal in all arrays."""
    new = np.zeros(max(len(values[0]) - 1, 0), bool)
    for v in values:
        new |= v[1:] != v[:-1]
    cuts = (np.flatnonzero(new) + 1).tolist()
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(values[0])]) if b > a]


def _topk_in_cells(queries: DataFrame, items: DataFrame, k: int, item: str, cells: int, pairs: DataFrame, ranged: bool = False) -> DataFrame:
    """queries (cell, query_id, q, low, high), items (cell, key, item, vector, page), pairs (cell, key, query_id): each cell's queries with its items whose key they are paired with.

    A cell reads its queries and pairs first, then streams its items by key.
    """
    kind = dict(items.dtypes)[item]
    none = F.lit(None)
    rows = queries.select("cell", F.lit(0).alias("kind"), none.cast("long").alias("key"), "query_id", none.cast(kind).alias(item), F.col("q").alias("vector"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    rows = rows.union(pairs.select("cell", F.lit(1), "key", "query_id", none.cast(kind), none.cast("array<double>"), none.cast("double"), none.cast("double")))
    rows = rows.union(items.select("cell", F.lit(2), F.col("key").cast("long"), none.cast("long"), item, "vector", F.col("page").cast("double"), none.cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, paired, near, asking = None, [], [], None, None
        for batch in batches:
            at, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in equal_runs(at, kinds):
                if at[a] != now:
                    if near is not None:
                        yield from near.hits()
                    now, asked, paired, near, asking = at[a], [], [], None, None
                part = batch.slice(a, b - a)
                key = part.column(2)
                if kinds[a] == 0:
                    asked.append((part.column(3).to_numpy(), as_matrix(part.column(5)), np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in (6, 7)], axis=1)))
                elif kinds[a] == 1:
                    paired.append((key.to_numpy(), part.column(3).to_numpy()))
                elif asked:
                    if near is None:
                        ids, matrix, spans = (np.concatenate(x) for x in zip(*asked))
                        near = Nearest(ids, matrix, k, item, spans if ranged else None)
                        asking = Asking(ids, paired)
                    pages = part.column(6).to_numpy(zero_copy_only=False)
                    asking.meet(near, key.to_numpy(), part.column(4), as_matrix(part.column(5)), pages)
        if near is not None:
            yield from near.hits()

    return rows.repartitionById(cells, "cell").sortWithinPartitions("cell", "kind", "key").mapInArrow(run, f"query_id long, {item} {kind}, score double")


class Asking:
    """Which of some queries ask for a key."""

    def __init__(self, ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys, queries = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        by_id = np.argsort(ids, kind="stable")
        place = np.searchsorted(ids[by_id], queries)
        known = ids[by_id][np.minimum(place, len(ids) - 1)] == queries  # some have no vector
        order = np.argsort(keys[known], kind="stable")
        self.keys, self.starts = np.unique(keys[known][order], return_index=True)
        self.places = by_id[place[known]][order]
        self.ends = np.append(self.starts[1:], len(order))

    def meet(self, near: Nearest, keys: np.ndarray, ids: pa.Array, vectors: np.ndarray, pages: np.ndarray) -> None:
        """Items, sorted by key, for the queries that ask for it: runs of a key are multiplied, single items paired."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        wanted = self.keys[at] == keys
        for a, b in equal_runs(keys):
            if b - a >= RUN_ITEMS and wanted[a]:
                near.add(ids.slice(a, b - a), vectors[a:b], self.places[self.starts[at[a]] : self.ends[at[a]]], pages[a:b])
                wanted[a:b] = False
        rows = np.flatnonzero(wanted)
        counts = (self.ends - self.starts)[at[rows]]
        upto = np.cumsum(counts)
        a = 0
        while a < len(rows):  # a few million pairs at a time
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + (1 << 20), side="right")))
            n = counts[a:b]
            first = np.repeat(self.starts[at[rows[a:b]]] - (np.cumsum(n) - n), n)
            near.add_pairs(ids, vectors, self.places[first + np.arange(n.sum())], np.repeat(rows[a:b], n), pages)
            a = b


def _every(n: int | Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1))


def _grid(n_queries: int, n_items: int, k: int, cores: int, pairs: int = 0) -> tuple[int, int]:
    """Rows of queries and columns of items: as few as memory and cores allow, for each row repeats the items and each column the hits."""
    rows = max(1, -(-n_queries // max(1, min(CELL_QUERIES, CELL_HITS // k))))
    return rows, max(1, -(-n_items // CELL_ITEMS), -(-pairs // (rows * CELL_PAIRS)), min(-(-2 * cores // rows), -(-n_items // ITEM_BLOCK)))


def _topk_by_cells(queries: DataFrame, items: DataFrame, k: int, item: str) -> DataFrame:
    """Queries and items hashed to the rows and columns of a grid of cells.

    Of many items a part is searched first: what is under a query's k-th best score there is no hit, so that cells score few pairs and give few hits.
    """
    n_queries, n_items, cores = queries.count(), items.count(), queries.sparkSession.sparkContext.defaultParallelism
    asked = queries.withColumn("floor", F.lit(None).cast("double"))
    if n_items >= FLOOR_PART * max(ITEM_BLOCK, 2 * k):
        some = items.where(F.pmod(F.xxhash64(item, F.lit(FLOOR_PART)), F.lit(FLOOR_PART)) == 0)
        near = best(_cells(asked, some, k, item, *_grid(n_queries, n_items // FLOOR_PART, k, cores)), k, item)
        asked = queries.join(near.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "query_id", "left")
    return _cells(asked, items, k, item, *_grid(n_queries, n_items, k, cores))


def _cells(queries: DataFrame, items: DataFrame, k: int, item: str, rows: int, columns: int) -> DataFrame:
    """queries (query_id, q, floor), items (item, vector) -> each cell's k best of its queries, without those under the query's floor."""

    def cell(row, column):
        return (row * columns + column).cast("int").alias("cell")

    kind, none = dict(items.dtypes)[item], F.lit(None)
    left = queries.withColumn("column", _every(columns)).select(cell(F.pmod(F.xxhash64("query_id"), F.lit(rows)), F.col("column")), F.lit(0).alias("kind"), "query_id", "q", "floor", none.cast(f"array<{kind}>").alias("items"), none.cast("int").alias("size"), none.cast("binary").alias("block"))
    dealt = _packed(items.select(F.pmod(F.xxhash64(item), F.lit(columns)).cast("int").alias("column"), item, "vector"), item)
    right = dealt.withColumn("row", _every(rows)).select(cell(F.col("row"), F.col("column")), F.lit(1), none.cast("long"), none.cast("array<double>"), none.cast("double"), "items", "size", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, near = None, [], None
        for batch in batches:
            at, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in equal_runs(at, kinds):
                if at[a] != now:
                    if near is not None:
                        yield from near.hits()
                    now, asked, near = at[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    asked.append((part.column(2).to_numpy(), as_matrix(part.column(3)), part.column(4).fill_null(-np.inf).to_numpy()))
                elif asked:
                    if near is None:
                        ids, matrix, floor = (np.concatenate(x) for x in zip(*asked))
                        near = Nearest(ids, matrix, k, item, whole=True, floor=floor)
                    for names, vectors in _unpacked(part.column(5), part.column(6), part.column(7)):
                        near.add(names, vectors)
        if near is not None:
            yield from near.hits()

    return left.union(right).repartitionById(rows * columns, "cell").sortWithinPartitions("cell", "kind").mapInArrow(run, f"query_id long, {item} {kind}, score double")


def _packed(items: DataFrame, item: str) -> DataFrame:
    """items (column, item, vector) -> (column, items, size, block): up to PACK_ITEMS of a column as one row, with their vectors compressed.

    A cell's rows are sorted, to have its queries first: packed, they take a fraction of the memory and of the conversion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, vectors = batch.column(0).to_numpy(), as_matrix(batch.column(2)).astype("<f8", copy=False)
            order = np.argsort(columns, kind="stable")
            spans = [(a, min(a + PACK_ITEMS, end)) for start, end in equal_runs(columns[order]) for a in range(start, end, PACK_ITEMS)]
            names = pa.ListArray.from_arrays(pa.array([a for a, _ in spans] + [len(order)], pa.int32()), batch.column(1).take(pa.array(order)))
            blocks = pa.array([pa.compress(vectors[order[a:b]].tobytes(), codec="zstd", asbytes=True) for a, b in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(columns[order][[a for a, _ in spans]], pa.int32()), names, pa.array([vectors.shape[1]] * len(spans), pa.int32()), blocks], names=["column", "items", "size", "block"])

    return items.mapInArrow(run, f"column int, items array<{dict(items.dtypes)[item]}>, size int, block binary")


def _unpacked(names: pa.ListArray, sizes: pa.Array, blocks: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The items of packed rows with their vectors, about GROUP_ITEMS at a time."""
    n = names.value_lengths().to_numpy()
    size, step = sizes[0].as_py(), max(1, GROUP_ITEMS // PACK_ITEMS)
    for a in range(0, len(n), step):
        held = n[a : a + step]
        parts = [np.frombuffer(pa.decompress(x.as_buffer(), decompressed_size=int(m) * size * 8, codec="zstd"), "<f8").reshape(m, size) for x, m in zip(blocks[a : a + step], held)]
        yield names.slice(a, step).flatten(), np.concatenate(parts)


# Top k among the items that a query may have: items and queries meet in scopes, such as a file or a title


def scope(kind: str, *values: Column) -> Column:
    """The name of a scope; null where a value is."""
    return F.concat(F.lit(kind), *[x for v in values for x in (F.lit("\0"), v.cast("string"))])


def masked_topk(queries: DataFrame, items: DataFrame, scopes: DataFrame, k: int, ranged: bool = False, item: str = "id") -> DataFrame:
    """queries (query_id, q_vector), items (item, vector, scopes array<string>), scopes (query_id, scope) -> each query's k best of the items in its scopes.

    ranged: queries have first_page and last_page, items page_number, and where first_page is set only items between the
    two count. Blocks of a scope's items are multiplied with all its queries; no row holds both vectors. Up to FEW_QUERIES queries
    go with the code, and items meet the list of their scope's queries; more are dealt with the items over a grid of cells by
    query and scope, where a large scope is no single group.
    """
    asked = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("q_vector").cast("array<double>").alias("q"),
        *([F.when(F.col("first_page").isNull(), -np.inf).otherwise(F.col("first_page").cast("double")).alias("low"), F.when(F.col("first_page").isNull(), np.inf).otherwise(F.coalesce(F.col("last_page").cast("double"), F.lit(-np.inf))).alias("high")] if ranged else [F.lit(None).alias("low"), F.lit(None).alias("high")]),
    ).where("size(q) > 0")
    page = F.col("page_number").cast("double") if ranged else F.lit(None).cast("double")
    given = items.where("size(vector) > 0").select(item, F.col("vector").cast("array<double>").alias("vector"), page.alias("page"), F.explode("scopes").alias("scope"))
    wanted = scopes.select(F.col("query_id").cast("long").alias("query_id"), "scope").where("scope IS NOT NULL").distinct()
    few = asked.limit(FEW_QUERIES + 1).collect()
    hits = _masked_few(few, given, wanted, k, ranged, item) if len(few) <= FEW_QUERIES else masked_many(asked, given, wanted, k, ranged, item)
    # an item that stands in several of a query's scopes comes several times, with one rank
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return hits.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_id", item])


def _masked_few(few: list, items: DataFrame, scopes: DataFrame, k: int, ranged: bool, item: str) -> DataFrame:
    ids = np.array([r.query_id for r in few], np.int64)
    matrix = np.array([r.q for r in few], float)
    spans = np.array([[r.low, r.high] for r in few], float) if ranged else None
    place = {q: i for i, q in enumerate(ids.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(ids, matrix, k, item, spans)
        for batch in batches if place else ():
            codes = batch.column(3).dictionary_encode().indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            vectors, pages = as_matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in equal_runs(codes[order]):
                rows = order[a:b]
                at = np.array([place[q] for q in batch.column(4)[int(rows[0])].as_py() if q in place], np.int64)
                if len(at):
                    near.add(batch.column(0).take(pa.array(rows)), vectors[rows], at, pages[rows])
        yield from near.hits()

    lists = scopes.groupBy("scope").agg(F.collect_list("query_id").alias("asking"))  # FEW_QUERIES numbers at most
    return items.join(lists, "scope").select(item, "vector", "page", "scope", "asking").mapInArrow(run, f"query_id long, {item} {dict(items.dtypes)[item]}, score double")


def masked_many(asked: DataFrame, items: DataFrame, scopes: DataFrame, k: int, ranged: bool, item: str) -> DataFrame:
    """asked (query_id, q, low, high), items (item, vector, page, scope), scopes (query_id, scope) -> hits, by a grid of cells.

    A row of cells has a part of the queries, with their vectors once a cell; a column has some scopes, with their items and the ids of
    those who ask for them. Items of a scope of more than SCOPE_ITEMS are dealt over several columns.
    """
    items = items.join(scopes.select("scope").distinct(), "scope", "left_semi")
    sizes = items.groupBy("scope").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)  # read twice; a lost part is counted again
    n_items = sizes.agg(F.sum("n")).first()[0] or 0
    rows, columns = _grid(asked.count(), n_items, k, asked.sparkSession.sparkContext.defaultParallelism, scopes.count())
    large = F.broadcast(sizes.where(F.col("n") > SCOPE_ITEMS).select("scope", F.ceil(F.col("n") / SCOPE_ITEMS).cast("int").alias("parts")))  # n_items / SCOPE_ITEMS at most
    parts = F.coalesce("parts", F.lit(1))
    key = F.xxhash64("scope", "part")

    def cell(row: Column) -> Column:
        return (row * columns + F.pmod(key, F.lit(columns))).cast("int").alias("cell")

    row = F.pmod(F.xxhash64("query_id"), F.lit(rows))
    left = asked.withColumn("column", _every(columns)).select((row * columns + F.col("column")).cast("int").alias("cell"), "query_id", "q", "low", "high")
    pairs = scopes.join(large, "scope", "left").withColumn("part", _every(parts)).select(cell(row), key.alias("key"), "query_id")
    right = items.join(large, "scope", "left").withColumn("part", F.pmod(F.xxhash64(item), parts).cast("int")).withColumn("row", _every(rows))
    right = right.select(cell(F.col("row")), key.alias("key"), item, "vector", "page")
    return _topk_in_cells(left, right, k, item, rows * columns, pairs, ranged)


def filtered_topk(queries: DataFrame, items: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """vector_topk over allowed (query_id, id) pairs only: each item is a scope."""
    return masked_topk(queries, items.withColumn("scopes", F.array(scope("id", F.col("id")))), allowed.select("query_id", scope("id", F.col("id")).alias("scope")), k)


def chunk_scopes(chunks: DataFrame, sections: bool = True) -> DataFrame:
    """chunks with the scopes of their file, their title, and, for sections, both."""
    file, title = F.col("filename"), F.col("section_title")
    return chunks.withColumn("scopes", F.array_compact(F.array(scope("file", file), scope("title", title), *([scope("section", file, title)] if sections else []))))


def match_scopes(matches: DataFrame) -> DataFrame:
    """The files and titles that queries match, as scopes."""
    return matches.select("query_id", F.explode(F.array(scope("file", F.col("filename")), scope("title", F.col("section_title")))).alias("scope"))


#: Buckets that the pages of a corpus are dealt to for queries by page range.
PAGE_BUCKETS = 64


def page_scopes(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scopes of queries, chunks with scopes) for page ranges: buckets of neighbouring pages, as many at most as PAGE_BUCKETS, however wide a range is."""
    low, high = chunks.agg(F.min("page_number"), F.max("page_number")).first()
    low, width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // PAGE_BUCKETS))

    def bucket(page: Column) -> Column:
        return F.floor((page - low) / width)

    first, last = F.greatest("first_page", F.lit(low)), F.least("last_page", F.lit(high or 0))
    some = queries.where(F.col("last_page").isNotNull() & F.col("first_page").isNotNull()).where(first <= last)
    buckets = some.select("query_id", F.explode(F.sequence(bucket(first), bucket(last))).alias("bucket"))
    return buckets.select("query_id", scope("pages", F.col("bucket")).alias("scope")), chunks.withColumn("scopes", F.array(scope("pages", bucket(F.col("page_number")))))


def lexical(query: Column, text: Column) -> Column:
    """Share of the query's words in the text, less for long texts."""
    q, d = F.array_distinct(T.words(F.lower(query))), T.words(F.lower(text))
    return F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1)) / (1 + F.size(d) / 100)


def with_texts(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(queries.select("query_id", "query"), "query_id").join(chunks.select("id", "text"), "id")


def rerank(hits: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """hits with query and text, their score replaced: by the lexical score, or a model's column."""
    s = lexical(F.col("query"), F.col("text")) if score is None else score
    return best(hits.drop("rank").withColumn("score", F.round(s, 6)), k)


#: Words of a query and a text together that a pair model reads.
PAIR_WORDS = 512


def words_lost(n_query: Column, n_text: Column, most: int = PAIR_WORDS) -> tuple[Column, Column]:
    """How many words a query and a text lose so that `most` are left: one from the longer of the two at a time, the text first among equals."""
    over, gap = F.greatest(n_query + n_text - most, F.lit(0)), n_text - n_query
    alike = F.greatest(over - F.abs(gap), F.lit(0))
    from_query = F.when(gap < 0, F.least(over, -gap)).otherwise(0) + F.floor(alike / 2)
    return from_query.cast("int"), (over - from_query).cast("int")


def pair_within(query: Column, text: Column, most: int = PAIR_WORDS) -> tuple[Column, Column]:
    """Both cut to `most` words together; what fits stays as it is."""
    q, t = T.words(query), T.words(text)

    def cut(c: Column, words: Column, n: Column) -> Column:
        return F.when(n > 0, F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " ")).otherwise(c)

    from_q, from_t = words_lost(F.size(q), F.size(t), most)
    return cut(query, q, from_q), cut(text, t, from_t)


def predict_scores(hits: DataFrame, make_predict_fn, batch_size: int = 32, name: str = "model_score", most: int = PAIR_WORDS) -> DataFrame:
    """hits with query and text -> the same with a pair model's scores, in batches, of pairs cut to `most` words; the model is loaded once a Python worker."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for q, t in pairs:
            out: list[float] = []
            for a in range(0, len(q), batch_size):
                out += map(float, predict(q.iloc[a : a + batch_size].tolist(), t.iloc[a : a + batch_size].tolist()))
            yield pd.Series(out, dtype="float64")

    return hits.withColumn(name, score(*pair_within(F.col("query"), F.col("text"), most)))


def blend(hits: DataFrame, k: int, only_if_over: bool = False, score: Column | None = None) -> DataFrame:
    """0.3 of the vector's score and 0.7 of the reranker's; queries with at most k hits stay as they are if only_if_over."""
    s = F.round(lexical(F.col("query"), F.col("text")) if score is None else score, 6)
    n = F.count("*").over(Window.partitionBy("query_id"))
    mixed = F.round(0.3 * F.col("score") + 0.7 * s + 1e-9, 6)  # the last term settles halves alike everywhere
    return best(hits.drop("rank").withColumn("n", n).withColumn("score", F.when(F.col("n") > k, mixed).otherwise(F.col("score")) if only_if_over else mixed).drop("n"), k)


def minmax(hits: DataFrame) -> DataFrame:
    """Scores to 0..1 within a query; 0.5 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.select("query_id", "id", F.round(F.when(high > low, (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5), 6).alias("score"))


def section_match(queries: DataFrame, sections: DataFrame, alpha: float = 0.5, threshold: float = 0.65, k: int = 5) -> DataFrame:
    """queries (query_id, query, q_vector, filename), sections (filename, section_no, section_title, vector) -> the accepted section of each query's file.

    The k nearest titles are fused: (1 - alpha) min-max vector score + alpha sigmoid of the rerank score.
    """
    own = sections.select(F.col("section_no").alias("id"), "vector", F.array(scope("file", F.col("filename"))).alias("scopes"))
    near = masked_topk(queries, own, queries.select("query_id", scope("file", F.col("filename")).alias("scope")), k).withColumnRenamed("id", "section_no")
    near = near.join(queries.select("query_id", "query", "filename"), "query_id").join(sections.select("filename", "section_no", "section_title"), ["filename", "section_no"])
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)
    fused = (1 - alpha) * scaled + alpha / (1 + F.exp(-F.round(lexical(F.col("query"), F.col("section_title")), 6)))
    top = near.withColumn("fused", F.round(fused, 6)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("fused"), F.desc("score"), "section_no")))
    return top.where((F.col("nth") == 1) & (F.col("fused") >= threshold)).select("query_id", "filename", "section_title", F.col("fused").alias("score"))


def search_vector_only(queries: DataFrame, chunks: DataFrame, k: int = 10, first: int = 30) -> DataFrame:
    return blend(with_texts(vector_topk(queries, chunks, first), queries, chunks), k, only_if_over=True)


def search_keyword(queries: DataFrame, chunks: DataFrame, k: int = 10, first: int = 30) -> DataFrame:
    """Of 3 * first vector hits those that share a word with the query, by share; the vector's order where none does."""
    hits = with_texts(vector_topk(queries, chunks, 3 * first), queries, chunks)
    q, d = F.array_distinct(T.words(F.lower(F.col("query")))), T.words(F.lower(F.col("text")))
    shared = hits.withColumn("share", F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1)))
    most = F.max("share").over(Window.partitionBy("query_id"))
    kept = shared.withColumn("most", most).where((F.col("most") == 0) | (F.col("share") > 0)).withColumn("score", F.when(F.col("most") == 0, F.col("score")).otherwise(F.round("share", 6))).drop("most", "share", "rank")
    return blend(best(kept, first), k, only_if_over=True)


#: Queries that name a page range from which on it is a search of its own, and such ranges at most.
COMMON_RANGE, COMMON_RANGES = 128, 8


def search_hybrid(queries: DataFrame, chunks: DataFrame, matches: DataFrame, k: int = 60) -> DataFrame:
    """Filtered vector hits for queries that match a file or section, by page range alone or unfiltered for the others; blended if over k."""
    first = max(120, 3 * k)
    with_filter = queries.join(matches.select("query_id").distinct(), "query_id", "left_semi")
    others = queries.join(matches.select("query_id").distinct(), "query_id", "left_anti")
    ranged, (first_page, last_page) = others.where("first_page IS NOT NULL"), (F.col("first_page"), F.col("last_page"))
    # ranges that many queries name are searches of their own, over their pages alone
    common = ranged.where(last_page.isNotNull()).groupBy("first_page", "last_page").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_RANGE).orderBy(F.desc("n"), "first_page", "last_page").limit(COMMON_RANGES).collect()
    plans = [vector_topk(others.where("first_page IS NULL"), chunks, first)]
    for r in common:
        own = (first_page == r.first_page) & (last_page == r.last_page)
        plans.append(vector_topk(ranged.where(own), chunks.where(F.col("page_number").between(r.first_page, r.last_page)), first))
        ranged = ranged.where(~F.coalesce(own, F.lit(False)))
    hits = masked_topk(with_filter, chunk_scopes(chunks, sections=False), match_scopes(matches), first, ranged=True).select("query_id", "id", "score")
    if not ranged.isEmpty():
        buckets, paged = page_scopes(ranged, chunks)
        plans.append(masked_topk(ranged, paged, buckets, first, ranged=True))
    for plan in plans:
        hits = hits.union(plan.select("query_id", "id", "score"))
    return blend(with_texts(hits, queries, chunks), k, only_if_over=True)


def search_smart(queries: DataFrame, chunks: DataFrame, matches: DataFrame, k: int = 100, fallback: int = 60) -> DataFrame:
    """Queries that match a file or section search there and blend always; the others go the hybrid way with a fixed k."""
    matched = matches.select("query_id").distinct()
    any_page = queries.join(matched, "query_id", "left_semi")
    hits = masked_topk(any_page, chunk_scopes(chunks, sections=False), match_scopes(matches), k, ranged=True).select("query_id", "id", "score")
    own = blend(with_texts(hits, queries, chunks), k)
    rest = search_hybrid(queries.join(matched, "query_id", "left_anti"), chunks, matches, fallback)
    return own.unionByName(rest)


def smart_retrieval(queries: DataFrame, chunks: DataFrame, files: DataFrame, sections: DataFrame, k: int = 60, file_threshold: float = 0.7) -> DataFrame:
    """File by marker or by nearest name, section within it, then vector hits of that section, or of the file if its name is near enough; else none."""
    named = queries.where("filter_pdf IS NOT NULL").select("query_id", F.col("filter_pdf").alias("filename"), F.lit(1.0).alias("file_score"))
    near = vector_topk(queries.where("filter_pdf IS NULL"), files, 1, "file_no").select("query_id", "file_no", F.col("score").alias("file_score")).join(files.select("file_no", "filename"), "file_no")
    target = named.unionByName(near.select("query_id", "filename", "file_score"))
    located = queries.join(target, "query_id")
    section = section_match(located, sections).select("query_id", F.col("section_title").alias("target_section"))
    mode = F.when(F.col("target_section").isNotNull(), "precise_by_section").when(F.col("file_score") >= file_threshold, "precise_by_file")
    plan = located.select("query_id", "filename", "file_score").join(section, "query_id", "left").withColumn("smart_mode", mode).where("smart_mode IS NOT NULL")
    file, title = F.col("filename"), F.col("target_section")
    scopes = plan.select("query_id", F.when(title.isNull(), scope("file", file)).otherwise(scope("section", file, title)).alias("scope"))
    hits = masked_topk(queries, chunk_scopes(chunks), scopes, k)
    return hits.join(plan.select("query_id", "smart_mode"), "query_id")


def search_service(queries: DataFrame, chunks: DataFrame, matches: DataFrame, k: int = 10) -> DataFrame:
    """Hybrid hits, twice as many as asked for, with the reranker's score in place of theirs."""
    return rerank(with_texts(search_hybrid(queries, chunks, matches, 2 * k).select("query_id", "id", "score"), queries, chunks), k)


def first_nonempty(*hits: DataFrame) -> DataFrame:
    """Of hit tables in order of preference, each query's from the first that has any."""
    union = None
    for i, h in enumerate(hits):
        one = h.select("query_id", "id", "score", "rank", F.lit(i).alias("plan"))
        union = one if union is None else union.union(one)
    return union.withColumn("first", F.min("plan").over(Window.partitionBy("query_id"))).where("plan = first").drop("first")


def vector_topk_lsh(queries: DataFrame, items: DataFrame, k: int, bucket: float = 0.5, tables: int = 8, most: float = 2.1) -> DataFrame:
    """Approximate: random projections put near unit vectors in common buckets; distance d gives cosine 1 - d^2 / 2.

    Unit vectors are at most 2 apart, so by default no hit is left out for its distance.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    a = items.where("size(vector) > 0").select("id", "vector", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    q = queries.where("size(q_vector) > 0").select("query_id", "q_vector", array_to_vector(F.col("q_vector").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(a)
    buckets = F.array(*[scope(f"bucket{i}", F.get(vector_to_array(F.get("hashes", F.lit(i))), F.lit(0)).cast("long")) for i in range(tables)])
    # buckets are scopes: items stay where they are, and no pair is shuffled
    hits = masked_topk(q, model.transform(a).select("id", "vector", buckets.alias("scopes")), model.transform(q).select("query_id", F.explode(buckets).alias("scope")), k)
    return hits.where(F.col("score") >= 1 - most * most / 2)
