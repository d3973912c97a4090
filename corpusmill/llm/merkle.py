"""A Merkle manifest of a table: leaves, roots and inclusion proofs by lag and lead windows (operator 13).

Nodes of a group (a language) stand in order, numbered from 0. While several remain, each run of ARITY consecutive
ones becomes the hash of their hex digests. Windows work on blocks of ARITY ** LEVELS nodes: at each
level a node's row (that of its first leaf) takes its siblings from rows at fixed offsets by lag and lead,
masked by its slot and by the run's length, and first children hash their parents. The blocks' tops are the nodes of the next
round; a proof is the block's steps followed by those of its top. The groups' roots are folded
likewise to one root. No task holds more than a few blocks, whatever the size of a group.

Defined results: leaves of one group and doc_id are ordered by their digests, null ids first; equal rows are leaves of
their own; a null group is a group, first; a group of one leaf is its own subroot; an empty table gives no rows; columns
beyond those of the leaf are ignored. A null doc_id is never tampered with; n_chars may pass the range of a long by tampering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, documents

ARITY = 2
#: Levels that one round of windows folds.
LEVELS = 10
#: The same over the groups' roots, which are few.
GROUP_LEVELS = 4
#: Rows are tampered with where this divides the checksum of the id.
TAMPER = 7
STEP = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """Unambiguous text of a value: its UTF-8 length, a colon and itself; - for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, group: str = "lang") -> DataFrame:
    """documents -> grp, doc_id, leaf, tampered: the digest of each row, and of the row as tampered with."""
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = field(F.col("n_chars").cast("decimal(20,0)") + 1)
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0, F.lit(False))
    leaf = digest(*fields)
    return docs.select(F.col(group).alias("grp"), "doc_id", leaf.alias("leaf"), F.when(hit, digest(*fields[:3], more, fields[4])).otherwise(leaf).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0, in its group by `order`, nulls first) and n (rows of the group).

    Rows are dealt by ranges of (group, order) and numbered in their partition; a count a partition and group gives
    the rest. What says the rows' first places is the last key, so that equal rows part too.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = cut(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).cast("int").alias("_part")
    counts = placed.groupBy("grp", part).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    group = Window.partitionBy("grp")
    starts = counts.select(
        F.col("grp").alias("_grp"), F.col("_part").alias("_at"), "_first", F.sum("_n").over(group).alias("n"),
        F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    on = F.col("grp").eqNullSafe(F.col("_grp")) & (F.shiftright("_id", 33).cast("int") == F.col("_at"))
    return placed.join(starts, on).withColumn("pos", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_grp", "_at", "_first", "_before")


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}L")


def _runs(column: str, size: int) -> Column:
    """Runs of `size` that so many make, the last one fewer."""
    return F.expr(f"({column} + {size - 1}L) div {size}L")


def fold_blocks(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """nodes (grp, pos, n, node, ...) with steps, the siblings of the node and of its parents in the block, and top, on the block's first row its hash (else null)."""
    ordered = Window.partitionBy("grp", "_block").orderBy("pos")  # one column for all levels: one exchange and sort
    at = nodes.withColumns({"_h": F.col("node"), "_block": _div("pos", arity**levels)})
    for level in range(levels):
        apart = arity**level
        # nodes of this level, the node's number among them, its slot in its run
        count, number = _runs("n", apart), _div("pos", apart)
        slot = F.pmod(number, F.lit(arity))
        here = (F.pmod("pos", F.lit(apart)) == 0) & (count > 1)
        # masked by the slot: only those in the run; by the run's length: only those that exist
        left = [F.when(here & (slot >= k), F.lag("_h", k * apart).over(ordered)) for k in range(arity - 1, 0, -1)]
        right = [F.when(here & (slot + k < arity) & (number + k < count), F.lead("_h", k * apart).over(ordered)) for k in range(1, arity)]
        at = at.withColumns({"_l": F.concat_ws("", *left), "_r": F.concat_ws("", *right)})
        parent = F.when((F.pmod("pos", F.lit(apart * arity)) == 0), F.when(count > 1, digest(F.col("_h"), F.col("_r"))).otherwise(F.col("_h")))
        at = at.withColumns({f"_s{level}": F.when(here, F.struct(F.col("_l").alias("l"), F.col("_r").alias("r"))), "_h": parent})
    # a row's node of each level is that of the nearest row before it which has one
    found = at.withColumns({f"_f{k}": F.last(f"_s{k}", ignorenulls=True).over(ordered) for k in range(levels)})
    steps = F.filter(F.array(*[F.col(f"_f{k}") for k in range(levels)]), lambda s: s.isNotNull())
    return found.select(*nodes.columns, steps.cast(STEP).alias("steps"), F.col("_h").alias("top"))


def fold(folded: DataFrame, most: int, arity: int, levels: int) -> DataFrame:
    """What fold_blocks gives, groups of up to `most` -> grp, block, steps, root for each of its blocks.

    Each round's blocks are checkpointed: a row for arity ** levels rows of the round before.
    """
    size = arity**levels
    tops = cut(folded.where("top is not null").select("grp", _div("pos", size).alias("pos"), _runs("n", size).alias("n"), F.col("top").alias("node")))
    if most <= size:
        return tops.select("grp", F.col("pos").alias("block"), F.array().cast(STEP).alias("steps"), F.col("node").alias("root"))
    again = fold_blocks(tops, arity, levels)
    above = fold(again, -(-most // size), arity, levels)
    return cut(_with_above(again, above, size).select("grp", F.col("pos").alias("block"), "steps", "root"))


def _with_above(folded: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """folded rows with the steps and the root of their block added."""
    up = above.select(F.col("grp").alias("_grp"), F.col("block").alias("_above"), F.col("steps").alias("_up"), "root")
    on = F.col("grp").eqNullSafe(F.col("_grp")) & (_div("pos", size) == F.col("_above"))
    return folded.join(up, on).withColumn("steps", F.concat("steps", "_up")).drop("_grp", "_above", "_up")


def manifest(docs: DataFrame, group: str = "lang", arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """documents -> doc_id, leaf, tampered, subroot, root, steps: one row a leaf; steps is its proof, from the leaf up, as (left, right) siblings."""
    nodes = fold_blocks(numbered(leaves(docs, group), ["doc_id", "leaf"]).withColumn("node", F.col("leaf")), arity, levels)
    blocks = fold(nodes, _most(nodes), arity, levels)
    subroots = blocks.where("block = 0").select(F.lit("all").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"))
    groups = fold_blocks(numbered(subroots, ["name"]), arity, GROUP_LEVELS)
    whole = _with_above(groups, fold(groups, _most(groups), arity, GROUP_LEVELS), arity**GROUP_LEVELS)
    whole = whole.select(F.col("name").alias("_name"), F.col("steps").alias("_last"), F.col("root").alias("_root"))
    above = blocks.join(whole, F.col("grp").eqNullSafe(F.col("_name")))
    above = above.select("grp", "block", F.concat("steps", "_last").alias("steps"), F.struct(F.col("root").alias("sub"), F.col("_root").alias("all")).alias("root"))
    proved = _with_above(nodes, above, arity**levels)
    return proved.select("doc_id", "leaf", "tampered", F.col("root.sub").alias("subroot"), F.col("root.all").alias("root"), "steps")


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["l"], node, s["r"]))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    done = manifest(documents(spark, sf_dir)).select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.col("tampered"), F.col("steps")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE concat(strlen(CAST({name} AS VARCHAR)), ':', {name}) END"


OP13_SQL = rf"""
WITH RECURSIVE leaves AS (
  SELECT lang, doc_id, sha256(concat({", ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))})) AS leaf,
    sha256(concat({", ".join(map(_field_sql, ("doc_id", "source", "lang", "(n_chars + 1)", "text")))})) AS changed,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % {TAMPER} = 0 AS hit
  FROM documents),
places AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
up AS (
  SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM places
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
over_all AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM over_all WHERE n > 1 GROUP BY level, pos // 2, n),
ways AS (
  SELECT p.lang, p.pos, u.level, u.node AS sib, (p.pos >> u.level) % 2 AS slot
  FROM places p JOIN (SELECT DISTINCT lang, level FROM up WHERE n > 1) k ON p.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.level = k.level AND u.pos = xor(p.pos >> k.level, 1)
  WHERE u.node IS NOT NULL
  UNION ALL
  SELECT p.lang, p.pos, 1000 + o.level, o.node, (s.pos >> o.level) % 2
  FROM places p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN over_all o ON o.pos = xor(s.pos >> o.level, 1) AND o.n > 1),
levels AS (
  SELECT lang, level FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT s.lang, 1000 + o.level FROM subroots s, (SELECT DISTINCT level FROM over_all WHERE n > 1) o),
steps AS (
  SELECT p.lang, p.pos, list(struct_pack(sib := coalesce(w.sib, ''), slot := coalesce(w.slot, 0)) ORDER BY l.level) AS steps
  FROM places p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos AND w.level = l.level
  GROUP BY p.lang, p.pos),
proofs AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT node FROM over_all WHERE n = 1) AS root, coalesce(t.steps, []) AS steps,
    CASE WHEN p.hit AND p.changed IS NOT NULL THEN p.changed ELSE p.leaf END AS start
  FROM places p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN steps t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(steps, lambda x: x.sib)), 'string_agg', '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(sib := start, slot := 0), steps),
      lambda a, x: struct_pack(sib := sha256(CASE WHEN x.slot = 0 THEN concat(a.sib, x.sib) ELSE concat(x.sib, a.sib) END), slot := 0)).sib AS folded_root
  FROM proofs)
SELECT *, folded_root = root AS verified FROM done
"""
