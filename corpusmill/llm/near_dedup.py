"""Near-duplicates by Order MinHash with banded alignment (operator 6).

A document's k-mers are its shingles of `SHINGLE` words, each labelled with how often it stood before in the
text. Each of `SKETCHES` hash functions picks the `PICKED` least labelled k-mers, and keeps them in text
order: documents that share k-mers in another order get another sketch. An edit spoils `SHINGLE` k-mers, too many
of a short text, so texts of up to `SHORT` words have `SHORT_SKETCHES` sketches of k-mers of `SHORT_SHINGLE` words instead; from
`BOTH` words on, as many as a text similar to a longer one has, they have both kinds. Texts with an equal sketch are
candidates. A candidate pair's words are aligned within the band of diagonals that the threshold allows; with
L aligned words of n and m its similarity is L / (n + m - L), the Jaccard similarity of words that stand in
the same order. Pairs of `THRESHOLD` or more are links, and the connected components are the classes.

Texts that are equal are one text from the start. The rest goes in rounds, so that a group of n copies costs
about n pairs and not n * n:

1. Each text meets one text: of the leaders of its sketch buckets the one whose sketches most others share
   (the original of a group of edited copies). What links makes components.
2. `ROUNDS` times, components that meet in a bucket are compared by their leading members there.
3. In buckets that still hold several components, every text outside the largest meets all texts of other
   components, in blocks of at most some `SIDE` texts a side. The others are aligned.

From step 2 on, before texts are fetched, pairs are compared by a minhash of `BINS` bytes over their words, each labelled with
how often it stood before. Aligned words are common words, so the similarity of the labelled words is at
least that of the alignment; about one in 10^5 pairs at the threshold is lost.

No candidate is left out for the size of its bucket. A bucket is never gathered in one task; many dissimilar
texts in one bucket cost the product of its size and of what is outside its largest component.

Defined results: null text counts as empty; texts without words, and texts of fewer than SHINGLE words
(whose one shingle is the whole text), are linked to equal ones only; texts are told apart by a hash of their
content, and ids only order them and name the classes; null ids come first; rows with one id get a row each,
and if their texts differ each is linked for itself; very long texts are read whole; an empty table gives no
rows; other columns, whatever their names, pass through `keep_first`, and are ignored by `classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import rolling
from corpusmill.llm.common import cut, documents, salted_join
from corpusmill.llm.substring_dedup import Words

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, PICKED = 24, 2
#: Words of a short text, of its k-mers, and how many sketches they make; the words from which it has those of long texts too.
SHORT, SHORT_SHINGLE, SHORT_SKETCHES = 40, 2, 16
BOTH = int(THRESHOLD * SHORT)
#: In place of a sketch that a text does not have.
NO_SKETCH = 0
#: Rounds of leading pairs before buckets are compared whole.
ROUNDS = 1
#: Bytes of the minhash that filters pairs.
BINS = 512
#: Standard errors that an estimate may lie under the threshold; texts a side in a block.
SLACK, SIDE = 4.5, 500
#: Edges that one task of a component step holds.
EDGES_A_TASK = 300_000
#: Texts that are sent to one place with the text they are compared with.
GROUP = 1000
#: Names of texts that may be broadcast.
FEW = 200_000
BATCH = 4_000_000


def shingles(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words: the hashes of w -> (hashes of the shingles in order, bounds by document) of texts of BOTH words or more, and of those
    of fewer than SHINGLE words, which are one shingle; of no others, nor of empty ones."""
    counts = np.diff(w.bounds)
    h = rolling.grams(words, SHINGLE)
    ok = rolling.fits(w.bounds, SHINGLE) & np.repeat(counts >= BOTH, counts)
    for d in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        a, b = w.bounds[d], w.bounds[d + 1]
        h[a] = rolling.grams(words[a:b], int(b - a))[0]
        ok[a] = True
    return h[ok], np.concatenate([[0], np.cumsum(ok)])[w.bounds]


def short_shingles(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of the short k-mers of texts of SHINGLE to SHORT words."""
    counts = np.diff(w.bounds)
    ok = rolling.fits(w.bounds, SHORT_SHINGLE) & np.repeat((counts >= SHINGLE) & (counts <= SHORT), counts)
    return rolling.grams(words, SHORT_SHINGLE)[ok], np.concatenate([[0], np.cumsum(ok)])[w.bounds]


def labelled(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how many equal ones stand before it in its document)."""
    order = np.lexsort((h, doc))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    before = np.empty(len(h), np.uint64)
    before[order] = (np.arange(len(h)) - first).astype(np.uint64)
    return rolling.mix(h + before * rolling.M2)


def word_bins(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One-permutation minhash of the labelled words: a row of BINS bytes a document, 0 for empty bins."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    label = labelled(words, doc) if len(words) else words
    least = np.full(n * BINS, rolling.TOP)
    np.minimum.at(least, doc * BINS + (label >> np.uint64(65 - BINS.bit_length())).astype(np.int64), label)
    return np.where(least == rolling.TOP, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(-1, BINS)


def order_minhash(h: np.ndarray, bounds: np.ndarray, sketches: int = SKETCHES, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents with shingles, their sketches): a row each. Sketches are numbered from `first`."""
    has = np.flatnonzero(np.diff(bounds) > 0)
    if not len(has):
        return has, np.zeros((0, sketches), np.uint64)
    begin = bounds[has]
    doc = np.repeat(np.arange(len(has)), np.diff(bounds)[has])
    label = labelled(h, doc)
    out = np.empty((len(has), sketches), np.uint64)
    factors = rolling.mix(np.arange(first + 1, first + sketches + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(sketches):
        v = label * factors[k]
        picked = []
        for _ in range(PICKED):
            hit = np.flatnonzero(v == np.minimum.reduceat(v, begin)[doc])
            hit = hit[v[hit] != rolling.TOP]
            v[hit] = rolling.TOP
            picked.append(hit)
        place = np.sort(np.concatenate(picked))  # text order
        nth = np.arange(len(place)) - np.searchsorted(doc[place], doc[place])
        sketch = np.full(len(has), np.uint64(first + k))
        for n in range(int(nth.max()) + 1):
            at = place[nth == n]
            sketch[doc[at]] = rolling.mix(sketch[doc[at]] * rolling.M2 + label[at])
        out[:, k] = sketch
    return has, out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rolling.chunks(batches, BATCH):
        w = Words(batch)
        words = w.hashes()
        has, sketches = order_minhash(*shingles(w, words))
        has_short, short = order_minhash(*short_shingles(w, words), SHORT_SKETCHES, SKETCHES)
        bins = word_bins(words, w.bounds)
        out: list[list] = [[None] * batch.num_rows for _ in range(2)]
        for d, row in zip(has.tolist(), sketches.view(np.int64).tolist()):
            out[0][d], out[1][d] = row, bins[d].tobytes()
        for d, row in zip(has_short.tolist(), short.view(np.int64).tolist()):
            out[0][d], out[1][d] = (out[0][d] or [NO_SKETCH] * SKETCHES) + row, bins[d].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.binary())], names=["_id", "_name", "sketches", "bins"])


def promising(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of bins may belong to texts of the threshold's similarity.

    The share of equal bins estimates it; bins that hold most of the words leave little to chance.
    """
    size = a.shape[-1]
    used = np.minimum(np.maximum(((a > 0) | (b > 0)).sum(axis=-1), 1), size - 0.5)
    word_count = -size * np.log1p(-used / size)
    error = np.sqrt(THRESHOLD * (1 - THRESHOLD) / used * np.maximum(1 - used / word_count, 0))
    return ((a == b) & (a > 0)).sum(axis=-1) / used >= THRESHOLD - SLACK * error - 0.02


def similar(a: list[int], b: list[int], threshold: float = THRESHOLD) -> bool:
    """Whether two word sequences align to the threshold.

    Bit i of `open_` is unset where an alignment of the words of b so far gains a word at a[i]; the bits held are
    those of the diagonals on which a path can still keep to the insertions and deletions allowed.
    """
    n, m = len(a), len(b)
    need = threshold * (n + m) / (1 + threshold) - 1e-9  # least aligned words
    most = int(n + m - 2 * need)  # most insertions and deletions
    if abs(n - m) > most:
        return False
    low, high = -((most - n + m) // 2), (most + n - m) // 2  # of i - j
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = high - low + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    open_, aligned, missed = mask, 0, m - need
    for j, y in enumerate(b):
        first = j + low
        if j:
            aligned += not open_ & 1
            open_ = open_ >> 1 | top
        at = places.get(y)
        if at is None:
            missed -= 1
            if missed < 0:
                return False
        elif gain := open_ & (at >> first if first > 0 else at << -first):
            open_ = (open_ + gain | open_ - gain) & mask
    return aligned + width - open_.bit_count() >= need


def _promising_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows (a, b, bins_a, bins_b) -> (a, b)."""
    for batch in batches:
        x, y = (rolling.joined(batch.column(k))[0].reshape(-1, BINS) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(promising(x, y)))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows (_id, text, g, leads) by g, the leading text of each first -> (a, b) of links with it."""
    group, leader, lead = None, None, []
    for batch in rolling.chunks(batches, BATCH):
        w = Words(batch)
        h, found = w.hashes(), []
        for row, (own, g, leads) in enumerate(zip(w.ids.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            words = h[w.bounds[row] : w.bounds[row + 1]].tolist()
            if leads:
                group, leader, lead = g, own, words
            elif g == group and similar(words, lead):
                found.append((leader, own))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def texts_of(plain: DataFrame, named: DataFrame) -> DataFrame:
    """The texts (_id, text) of named (_doc, least), a row each.

    Up to `FEW` names, two numbers each, are broadcast, so that only the texts wanted are shuffled; more are joined.
    """
    names = cut(named.select("_doc", "least").distinct())
    if names.count() <= FEW:
        names = F.broadcast(names)
    return plain.join(names, (F.col("_id") == F.col("_doc")) & (F.col("_name") == F.col("least")), "left_semi").dropDuplicates(["_id", "_name"])


def verified(pairs: DataFrame, plain: DataFrame, reps: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose texts are similar: the partners b of each a, in groups of some `GROUP`, are sent to one place a group.

    plain has the texts (_id, text, _name); one row of each is taken, that whose name reps holds.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    placed = cut(pairs.join(sizes, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("groups"))).alias("g")))
    parts = placed.select(F.col("b").alias("_doc"), "g", F.lit(False).alias("leads"))
    led = placed.select("a", "g").distinct().select(F.col("a").alias("_doc"), "g", F.lit(True).alias("leads"))
    named = parts.union(led).join(reps.select(F.col("_rep").alias("_doc"), "least"), "_doc")
    rows = texts_of(plain, named).join(named, F.col("_id") == F.col("_doc")).select("_id", "text", "g", "leads")
    return rows.repartition("g").sortWithinPartitions("g", F.desc("leads")).mapInArrow(_align, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (_rep, root): the least member of each connected component, for all members but itself.

    Alternating large-star and small-star steps; each is a grouping by node, cut from its lineage.
    """
    edges = cut(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    state = None
    while True:
        # few edges need few tasks: each step would else write a file for every pair of partitions
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.groupBy(F.col("u").alias("_rep")).agg(F.min("v").alias("root"))
        state, tasks = now, -(-now[0] // EDGES_A_TASK)
        edges = edges.coalesce(tasks)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = cut(small.coalesce(tasks).distinct().coalesce(tasks))


def leading_pairs(crowded: DataFrame) -> DataFrame:
    """(_rep, sketch, rank) -> (a, b): each text b with the best leader a of its buckets."""
    leaders = crowded.groupBy("sketch").agg(F.max(F.struct("rank", F.col("_rep").alias("a"))).alias("lead"))
    best = crowded.join(leaders, "sketch").groupBy("_rep").agg(F.max("lead").alias("lead"))
    return best.select(F.col("lead.a").alias("a"), F.col("_rep").alias("b")).where("a <> b")


def with_roots(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    return crowded.join(roots, "_rep", "left").select("sketch", "_rep", "rank", F.coalesce("root", "_rep").alias("root"))


def component_pairs(own: DataFrame) -> DataFrame:
    """(sketch, _rep, rank, root) -> distinct (a, b): in each bucket the leading member of every component with that of the largest."""
    by_root = own.groupBy("sketch", "root").agg(F.count("*").alias("c"), F.max(F.struct("rank", "_rep")).alias("head"))
    main = by_root.groupBy("sketch").agg(F.max(F.struct("c", "root", "head")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    return by_root.join(main, "sketch").where("root <> main.root").select(F.col("main.head._rep").alias("a"), F.col("head._rep").alias("b")).distinct()


def filtered(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The promising ones of pairs (a, b)."""
    one = pairs.join(reps.select(F.col("_rep").alias("a"), F.col("bins").alias("bins_a")), "a")
    both = one.join(reps.select(F.col("_rep").alias("b"), F.col("bins").alias("bins_b")), "b").select("a", "b", "bins_a", "bins_b")
    return both.mapInArrow(_promising_pairs, "a long, b long").distinct()


def _block_pairs(members: list) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """Members (_rep, root, bins, sketches, outside, ...) of one block of bucket `key` -> ids, roots, (outside member, its promising partners of other components).

    A pair that shares several sketches belongs to the bucket of the first.
    """
    ids, roots = (np.array([m[c] for m in members], np.int64) for c in ("_rep", "root"))
    key = members[0]["key"]
    bins = np.frombuffer(b"".join(m["bins"] for m in members), np.uint8).reshape(-1, BINS)
    sketches = np.full((len(members), SKETCHES + SHORT_SKETCHES), NO_SKETCH, np.int64)
    for row, m in zip(sketches, members):
        row[: len(m["sketches"])] = m["sketches"]
    outside = np.array([m["outside"] for m in members], bool)
    rest = np.flatnonzero(~outside)

    def partners() -> Iterator[tuple[int, np.ndarray]]:
        for i in np.flatnonzero(outside).tolist():
            other = rest[roots[rest] != roots[i]]
            other = other[promising(bins[other], bins[i])]
            if len(other):
                shared = (sketches[other] == sketches[i]) & (sketches[i] != NO_SKETCH)
                yield i, other[sketches[i][shared.argmax(axis=1)] == key]

    return ids, roots, partners()


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows (members) -> the members (their struct) that have a promising partner in their block."""
    for batch in batches:
        keep = []
        for at, members in enumerate(batch.column(0).to_pylist()):
            found = np.zeros(len(members), bool)
            for i, other in _block_pairs(members)[2]:
                found[i] |= len(other) > 0
                found[other] = True
            keep.append(found)
        flat = batch.column(0).flatten()
        yield pa.RecordBatch.from_arrays([flat.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))], names=["member"])


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows (members with their texts) -> links (a, b) between components: enough of them to join all that are linked within the block."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for members in batch.column(0).to_pylist():
            ids, roots, partners = _block_pairs(members)
            joined = {r: r for r in roots.tolist()}

            def root(x: int, joined=joined) -> int:
                while joined[x] != x:
                    joined[x] = x = joined[joined[x]]
                return x

            w = Words(pa.RecordBatch.from_arrays([pa.array(ids), pa.array([m["text"] for m in members])], names=["_id", "text"]))
            h = w.hashes()
            words = [h[x:y].tolist() for x, y in zip(w.bounds.tolist(), w.bounds[1:].tolist())]
            for i, other in partners:
                for k in other.tolist():
                    x, y = root(int(roots[i])), root(int(roots[k]))
                    if x != y and similar(words[i], words[k]):
                        joined[max(x, y)] = min(x, y)
                        found.append((min(int(ids[i]), int(ids[k])), max(int(ids[i]), int(ids[k]))))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


MEMBER = "struct<key: long, block: int, out: int, _rep: long, root: long, bins: binary, sketches: array<long>, outside: boolean>"


def remaining_links(own: DataFrame, plain: DataFrame, reps: DataFrame) -> DataFrame:
    """(sketch, _rep, root) -> links (a, b) between components that meet in a bucket, whatever the bucket's size.

    Blocks first find by their members' bins which texts they need, then align those.
    """
    own = own.select("_rep", "root", F.col("sketch").alias("key"))
    by_root = own.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("most")).where("n > most")
    members = salted_join(own, mixed, "key", F.col("_rep"), "inner").select("key", "_rep", "root", (F.col("root") != F.col("main")).alias("outside"), F.ceil(F.col("n") / SIDE).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / SIDE).cast("int").alias("outs"))
    mine = F.pmod(F.xxhash64("_rep"), F.lit(1 << 40))
    every = members.select("key", (mine % F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("out"), "_rep", "root", F.lit(False).alias("outside"))
    outside = members.where("outside").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), (mine % F.col("outs")).cast("int").alias("out"), "_rep", "root", F.lit(True).alias("outside"))
    dealt = every.union(outside).join(reps.select("_rep", "bins", "sketches"), "_rep").select(F.struct("key", "block", "out", "_rep", "root", "bins", "sketches", "outside").alias("m"))
    place = ["m.key", "m.block", "m.out"]
    wanted = cut(dealt.groupBy(*place).agg(F.collect_list("m").alias("members")).select("members").mapInArrow(_wanted, f"member {MEMBER}").select("member.*"))
    named = wanted.join(reps.select("_rep", "least"), "_rep")
    texts = texts_of(plain, named.select(F.col("_rep").alias("_doc"), "least"))
    full = named.join(texts.select(F.col("_id").alias("_rep"), "text"), "_rep").select(F.struct("key", "block", "out", "_rep", "root", "bins", "sketches", "outside", "text").alias("m"))
    return full.groupBy(*place).agg(F.collect_list("m").alias("members")).select("members").mapInArrow(_cross, "a long, b long").distinct()


def _plain(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (_id: a hash of the text, text, _name: its document's id)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(rolling.NO_ID)).alias("_name"))


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> rows (_id, _name, ...) and texts (_rep, least: the least id with it, head: (least, _rep) of the first text of its class)."""
    plain = _plain(docs)
    sketched = plain.mapInArrow(_sketch, "_id long, _name long, sketches array<long>, bins binary")
    reps = cut(sketched.groupBy(F.col("_id").alias("_rep")).agg(F.min("_name").alias("least"), F.first("sketches").alias("sketches"), F.first("bins").alias("bins")))
    known = reps.where("sketches IS NOT NULL")
    marks = known.select("_rep", F.explode("sketches").alias("sketch")).where(F.col("sketch") != NO_SKETCH)
    sizes = marks.groupBy("sketch").agg(F.count("*").alias("n")).where("n > 1")
    placed = cut(marks.join(sizes, "sketch"))  # of the marks only those that several texts have
    # the text whose sketches most others share ranks first: the original of a group of edited copies
    shared = placed.groupBy("_rep").agg(F.struct(F.sum("n").alias("shared"), F.bitwise_not("_rep").alias("order")).alias("rank"))
    crowded = cut(placed.select("_rep", "sketch").join(shared, "_rep"))
    tried = cut(leading_pairs(crowded))
    links = cut(verified(tried, plain, known))
    roots = components(links)
    for _ in range(ROUNDS):
        again = cut(component_pairs(with_roots(crowded, roots)).join(tried, ["a", "b"], "left_anti"))
        if again.isEmpty():
            break
        tried, found = tried.union(again), cut(verified(cut(filtered(again, known)), plain, known))
        if found.isEmpty():
            break
        links = links.union(found)
        roots = components(links)
    rest = cut(remaining_links(with_roots(crowded, roots), plain, known))
    if not rest.isEmpty():
        roots = components(links.union(rest))
    # only texts of classes of several meet their class's name, dealt out, as a class may be large
    linked = cut(roots.union(roots.select("root", "root").distinct()).join(reps.select("_rep", F.struct("least", "_rep").alias("own")), "_rep"))
    heads = salted_join(linked, linked.groupBy("root").agg(F.min("own").alias("head")), "root", F.col("_rep"), "inner").select("_rep", "head")
    return plain.select("_id", "_name"), reps.join(heads, "_rep", "left").select("_rep", "least", F.coalesce("head", F.struct("least", "_rep")).alias("head"))


def classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id (the least id of the class), text_id (the least id with an equal text)."""
    rows, texts = classed(docs)
    out = rows.select("_id", "_name").join(texts, F.col("_id") == F.col("_rep"))

    def shown(c: str):
        return F.nullif(F.col(c), F.lit(rolling.NO_ID))

    return out.select(shown("_name").alias("doc_id"), shown("head.least").alias("class_id"), shown("least").alias("text_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: a row of its least id, also where classes share that id or have none."""
    first = classed(docs)[1].where("head._rep = _rep").select(F.col("_rep").alias("_id"), F.col("least").alias("_name"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(rolling.NO_ID)).alias("_name"))
    return rows.join(first, ["_id", "_name"], "left_semi").dropDuplicates(["_id", "_name"]).select("_row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
