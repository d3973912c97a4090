"""Line deduplication by winnowing (operator 2): DataFrame functions only.

Lines are the newline-separated parts of a text that are not blank, without outer white space. A run of
`RUN` lines or more, or a line of `LONG` characters or more, that also stands earlier (in a document with a
smaller id, or further up) is deleted.

In every window of RUN lines the one with the least hash is its fingerprint, and a long line is its own, so what
two places share has a fingerprint in both. A row is made for each place of a fingerprint, with the windows it
stands for. Places of fingerprints that occur once are dropped; each of the others is extended to both sides, over
the neighbouring line hashes, to the windows that hold it. The earliest place of each window's content is found
by a minimum, and all later places are deleted: their union is the maximal later runs. Places are
never paired with each other, so a line that a third of all documents share costs one row each.

Defined results: null or blank text has no lines; shorter lines in texts of fewer than RUN lines are left alone;
rows with one id and the same text are one document and are treated alike, rows with one id and different texts are
ordered by a hash of the text; null ids come first; very long texts are read whole; an empty table gives no
rows; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import documents

#: Lines of a run; characters of a line that is deleted alone.
RUN, LONG = 3, 100


def lines_of(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(trimmed, lambda x: x != ""))


def fingerprints(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(_doc, _th, mark, windows): a row for each place of a fingerprint, with the windows (at, hashes) that it stands for."""
    lines = F.transform(lines_of(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) >= long).alias("long")))
    lined = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_th"), lines.alias("lines")).where((F.size("lines") >= run) | F.exists("lines", lambda x: x["long"]))
    lined = lined.select("_doc", "_th", "lines", F.col("lines.h").alias("h"))
    starts = F.when(F.size("h") >= run, F.sequence(F.lit(1), F.size("h") - run + 1)).otherwise(F.array().cast("array<int>"))
    lined = lined.withColumn("least", F.transform(starts, lambda s: F.array_min(F.slice("h", s, run))))
    none = F.array().cast("array<struct<at: int, hashes: array<bigint>>>")

    def windows(line: Column, i: Column) -> Column:
        around = F.sequence(F.greatest(i - run + 1, F.lit(0)), F.least(i, F.size("h") - run))
        held = F.when(F.size("h") >= run, F.transform(F.filter(around, lambda s: F.get("least", s) == line["h"]), lambda s: F.struct(s.alias("at"), F.slice("h", s + 1, run).alias("hashes"))))
        alone = F.when(line["long"], F.array(F.struct(i.alias("at"), F.array(line["h"]).alias("hashes"))))
        return F.concat(F.coalesce(held, none), F.coalesce(alone, none))

    each = F.transform("lines", lambda line, i: F.struct(line["h"].alias("mark"), windows(line, i).alias("windows")))
    return lined.select("_doc", "_th", F.explode(F.filter(each, lambda x: F.size(x["windows"]) > 0)).alias("w")).select("_doc", "_th", "w.*")


def repeated_windows(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(_doc, _th, found): of each document, the windows (at, size) that stand earlier too."""
    marks = fingerprints(docs, run, long)
    again = marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    hits = marks.join(again, "mark").select("_doc", "_th", F.explode("windows").alias("w")).select("_doc", "_th", "w.*")
    place = F.struct("_doc", "_th", "at")
    first = hits.groupBy("hashes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hashes", "first")
    later = hits.join(first, "hashes").where(place != F.col("first"))
    return later.groupBy("_doc", "_th").agg(F.collect_set(F.struct("at", F.size("hashes").alias("size"))).alias("found"))


def dedup(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """docs with text reduced to the lines kept, and a last column line_stats (n_lines, n_removed, n_runs).

    A text that loses nothing keeps its blank lines and white space as they were. Where docs has a column
    line_stats, the new one's name gets a line at its end.
    """
    found = repeated_windows(docs.select("doc_id", "text"), run, long)
    joined = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), lines_of(F.col("text")).alias("_lines"))
    joined = joined.join(found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_th")), "left")
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("found", F.array().cast("array<struct<at: int, size: int>>")), lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1)))))
    joined = joined.select("_row", "_lines", gone.alias("_gone"))
    kept = F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i))
    runs = F.size(F.filter("_gone", lambda x, i: ~x.eqNullSafe(F.get("_gone", i - 1) + 1)))
    done = joined.select(
        "_row", F.when(F.size("_gone") > 0, F.array_join(kept, "\n")).alias("__text"), F.size("_lines").cast("long").alias("__lines"), F.size("_gone").cast("long").alias("__gone"), runs.cast("long").alias("__runs")
    )
    columns = [F.coalesce("__text", F.col("_row")[c]).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    name = "line_stats"
    while name in docs.columns:
        name += "_"
    return done.select(*columns, F.struct(F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), F.col("__runs").alias("n_runs")).alias(name))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "line_stats.*", F.sha2(F.array_join(lines_of(F.col("text")), "\n"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lined AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(lines) - 1)) AS s, lines FROM lined WHERE len(lines) >= 3),
longs AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS s, lines FROM lined),
keyed AS (
  SELECT doc_id, s, lines[s:s + 2] AS w FROM windows
  UNION ALL SELECT doc_id, s, [lines[s]] AS w FROM longs WHERE length(lines[s]) >= 100),
later AS (SELECT doc_id, s, len(w) AS size FROM (SELECT doc_id, s, w, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM keyed) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + d AS line FROM later, range(0, 3) AS t(d) WHERE d < size),
runs AS (
  SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN before IS DISTINCT FROM line - 1 THEN 1 ELSE 0 END) AS n_runs, list(line) AS gone
  FROM (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM gone) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN coalesce(lines, []) ELSE list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]) END, chr(10))) AS kept_sha256
FROM lined l LEFT JOIN runs r ON l.doc_id = r.doc_id
"""
