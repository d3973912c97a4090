"""Chunk store: catalogue, JSON documents, ingest rules, embeddings for stored chunks, section index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators.chunks import text_hash

DOCUMENT_SCHEMA = (
    "parent_document struct<filename:string,file_path:string,total_pages:int,language:string,total_chunks:bigint>,"
    "document_chunks array<struct<id:string,text:string,page_number:int,section_title:string,chunk_index:int,total_chunks_in_page:int,text_hash:string>>, _corrupt_record string"
)


def list_files(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """filename, path, relative_path, bytes of files under a directory, without reading them; a missing directory has none."""
    if not exists(spark, directory):
        return spark.createDataFrame([], "filename string, path string, relative_path string, bytes long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory)
    # paths come back with their scheme, and with or without an empty authority
    base = re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", directory).strip("/")
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+.-]+:(//[^/]*)?/*", ""), "^" + re.escape(base) + "/*", "")
    return found.select(T.basename(F.col("path")).alias("filename"), "path", inside.alias("relative_path"), F.col("length").alias("bytes"))


def file_language(paths: DataFrame) -> DataFrame:
    """The path part right after `source`, with either slash; none gives ''."""
    parts = F.split("file_path", r"[/\\]")
    at = F.array_position(parts, "source")
    return paths.withColumn("path_language", F.when(at > 0, F.coalesce(F.get(parts, at.cast("int")), F.lit(""))).otherwise(F.lit("")))


def files_by_language(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.lower("filename").like("%.pdf")).groupBy("language").agg(F.sort_array(F.collect_list("filename")).alias("files"))


def files_flat(grouped: DataFrame) -> DataFrame:
    return grouped.select("language", F.explode("files").alias("filename")).select(F.concat(F.lit("["), "language", F.lit("] "), "filename").alias("display"))


def json_docs(parents: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """A nested record a document: its parent record and its chunks in order."""
    fields = ["id", "text", "page_number", "section_title", "chunk_index", "total_chunks_in_page", "text_hash"]
    nested = chunk_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "chunk_index", F.struct(*fields).alias("c")))).alias("cs"))
    return parents.join(nested, "doc_id").select(F.struct("filename", "file_path", "total_pages", "language", "total_chunks").alias("parent_document"), F.transform("cs", lambda x: x["c"]).alias("document_chunks"))


def read_json_docs(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """A row a chunk with its parent's columns; unreadable documents and those without chunks are skipped.

    Each file under path is one document, or, without one_a_file, each of its lines is.
    """
    raw = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", one_a_file).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    good = raw.where("_corrupt_record IS NULL AND document_chunks IS NOT NULL")
    return good.select("parent_document.filename", "parent_document.file_path", "parent_document.language", F.posexplode("document_chunks").alias("position", "c")).select("filename", "file_path", "language", "position", "c.*")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a query a line -> (query_id, query); blank lines are no queries. Ids ascend within a file, with gaps."""
    lines = spark.read.text(path).withColumn("query_id", F.monotonically_increasing_id())
    return lines.select("query_id", T.strip(F.col("value")).alias("query")).where("query <> ''")


def ingest_dedup(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks whose hash is not stored; within the batch only the first file that has a hash keeps it (all its rows). Empty hashes stay."""
    # a hash that many files share is met by its file, so that its rows are spread
    first = new.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    hashed = new.where("text_hash <> ''").join(first, ["text_hash", "doc_id"], "left_semi").join(stored.select("text_hash").distinct(), "text_hash", "left_anti").select(*new.columns)
    return hashed.unionByName(new.where("text_hash IS NULL OR text_hash = ''"))


def ingest_defaults(rows: DataFrame) -> DataFrame:
    """id, text, page and title with their defaults; the file name from the path."""
    return rows.select(
        F.coalesce("id", F.format_string("%s_%06d", "stem", "position")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("page").try_cast("int"), F.lit(0)).alias("page_number"),
        F.coalesce("section_title", F.lit("")).alias("section_title"), T.basename(F.col("file_path")).alias("pdf_filename"), "language",
    )


RESERVED = ["page_number", "section_title", "pdf_path", "pdf_filename", "language", "coordinates", "chunk_id"]


def json_values(columns: dict[str, Column]) -> Column:
    """A map of values as metadata keeps them: strings, numbers and booleans as their text, lists, maps and structs as JSON; nulls are left out."""
    entries = [F.struct(F.lit(k).alias("key"), F.get_json_object(F.to_json(F.struct(v.alias("v"))), "$.v").alias("value")) for k, v in columns.items()]
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: v.isNotNull())


def flatten_metadata(rows: DataFrame) -> DataFrame:
    """(id, reserved map<string,string>, extra map<string,string>): the reserved keys win."""
    return rows.select("id", F.map_concat("reserved", F.map_filter("extra", lambda k, v: ~k.isin(RESERVED))).alias("metadata"))


def pick_keys(m: Column, keys: list[str]) -> Column:
    """The entries of a map with these keys."""
    return F.map_filter(m, lambda k, v: k.isin(keys))


def get_or(m: Column, key: str, default: str) -> Column:
    """A map's value, or a default where the key is missing or null."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def unprocessed(files: DataFrame, processed: DataFrame) -> DataFrame:
    return files.join(processed.select("file_path"), "file_path", "left_anti")


def embed_text(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("vector", V.hash_embedding(F.col(text), unit=True))


def embed_distinct(rows: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct text is encoded once and joined back."""
    return rows.join(embed_text(rows.select(text).distinct(), text), text)


def predict_embeddings(rows: DataFrame, make_predict_fn, batch_size: int = 32, text: str = "text") -> DataFrame:
    """A model's vectors, in batches, loaded once a Python worker; a failed batch is tried one by one, failed rows are null."""

    @F.pandas_udf("array<float>")
    def encode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for texts in it:
            out = []
            for a in range(0, len(texts), batch_size):
                some = texts.iloc[a : a + batch_size].tolist()
                try:
                    out += [list(map(float, v)) for v in predict(some)]
                except Exception:
                    for one in some:
                        try:
                            out.append(list(map(float, predict([one])[0])))
                        except Exception:
                            out.append(None)
            yield pd.Series(out)

    return rows.withColumn("vector", encode(text))


def storable(rows: DataFrame) -> DataFrame:
    return rows.where("vector IS NOT NULL AND size(vector) > 0")


def vector_dim_check(rows: DataFrame) -> DataFrame:
    """One row: rows, empty vectors, distinct dimensions of the others, and whether the table may be stored."""
    d = F.when(F.size("vector") > 0, F.size("vector"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce(F.size("vector"), F.lit(0)) > 0, 0).otherwise(1)).alias("empty"), F.count_distinct(d).alias("dimensions"), (F.count_distinct(d) == 1).alias("ok"))


def stored_hashes(store: DataFrame) -> DataFrame:
    """Distinct hashes, from the column or the nested metadata."""
    h = F.coalesce(F.nullif("text_hash", F.lit("")), F.get_json_object("metadata", "$.text_hash"))
    return store.select(h.alias("text_hash")).where("text_hash IS NOT NULL AND text_hash <> ''").distinct()


def store_preview(store: DataFrame, limit: int = 20) -> DataFrame:
    return store.orderBy("id").limit(limit).select("id", T.preview(F.col("text"), 200).alias("preview"))


def write_store(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).partitionBy("language").parquet(path)


def append_vectors(rows: DataFrame, path: str, mode: str = "append") -> int:
    """Rows with a vector are written to the store, by language; returns how many were skipped for having none.

    Rows of unlike dimensions, or of another than the store's, are an error and nothing is written. mode
    "overwrite" is the forced rebuild: what the store holds goes and sets no dimension.
    """
    rows = rows.persist(StorageLevel.DISK_ONLY)  # checked and written from one computation; a lost part is computed again
    try:
        return _checked_append(rows, path, mode)
    finally:
        rows.unpersist()


def _checked_append(rows: DataFrame, path: str, mode: str) -> int:
    one = vector_dim_check(rows).first()
    if one.dimensions > 1:
        raise ValueError(f"vectors of {one.dimensions} dimensions")
    if one.dimensions:
        old = None if mode == "overwrite" else saved(rows.sparkSession, path, {"vector": "array<double>"})
        sizes = (storable(old).limit(1) if old else rows.limit(0)).select(F.size("vector").alias("d")).collect()
        if sizes and storable(rows).where(F.size("vector") != sizes[0].d).limit(1).count():
            raise ValueError(f"the store's vectors have {sizes[0].d} dimensions")
        write_store(storable(rows), path, mode)
    return one.empty or 0


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def saved(spark: SparkSession, path: str, columns: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame | None:
    """The Parquet table at path; None if there is none, one of the columns is missing or of another type, or a key is null."""
    if not exists(spark, path):
        return None
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise
    types = dict(found.dtypes)
    if any(types.get(c) != t for c, t in columns.items()):
        return None
    blank = F.lit(False)
    for key in keys:
        blank |= F.col(key).isNull()
    return None if keys and found.where(blank).limit(1).count() else found


def saved_or_built(spark: SparkSession, path: str, built: DataFrame, keys: tuple[str, ...] = (), rebuild: bool = False) -> DataFrame:
    """The table at path if it has built's columns and no null keys; else, or for a forced rebuild, built, written there first."""
    found = None if rebuild else saved(spark, path, dict(built.dtypes), keys)
    if found is None:
        built.write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found.select(*built.columns)


def build_store(spark: SparkSession, folder: str, documents: DataFrame | None = None, mode: str = "full", rebuild: bool = False) -> DataFrame | None:
    """Nested documents to JSON ("json"), JSON chunks to stored vectors ("vectors"), or both ("full"): the store, None after "json".

    Chunks whose hash the store has are not added again, unless it is rebuilt.
    """
    if mode not in ("json", "vectors", "full"):
        raise ValueError(f"no mode {mode}")
    docs, store = f"{folder}/json", f"{folder}/store"
    if mode != "vectors":
        documents.write.mode("overwrite").json(docs)
    if mode == "json":
        return None
    new = read_json_docs(spark, docs, one_a_file=False)
    old = None if rebuild else saved(spark, store, {"text_hash": "string"})
    if old is not None:
        new = new.join(old.select("text_hash").distinct(), "text_hash", "left_anti")
    append_vectors(embed_distinct(new), store, "overwrite" if rebuild else "append")
    return saved(spark, store, {"vector": "array<double>"})


def section_index(chunk_rows: DataFrame) -> DataFrame:
    """(filename, section_title): its pages and its tokens, sorted; blank titles go, page 0 is no page."""
    t = chunk_rows.withColumn("section_title", F.col("section_title")).where(T.strip(F.col("section_title")) != "")
    page = F.nullif(F.col("page_number").try_cast("int"), F.lit(0))
    grouped = t.groupBy("filename", "section_title").agg(F.array_sort(F.collect_set(page)).alias("pages"), F.first("language").alias("language"))
    return grouped.select("filename", "section_title", "pages", T.token_set(F.col("section_title"), F.col("language")).alias("tokens"))


def section_vectors(index: DataFrame) -> DataFrame:
    """Valid section titles, numbered within their file, with vectors."""
    n = F.row_number().over(Window.partitionBy("filename").orderBy("section_title")) - 1
    valid = index.where(T.valid_section_title(F.col("section_title"))).select("filename", n.alias("section_no"), "section_title")
    return embed_text(valid, "section_title")


def file_vectors(files: DataFrame) -> DataFrame:
    return embed_text(files.select("file_no", "filename"), "filename")
