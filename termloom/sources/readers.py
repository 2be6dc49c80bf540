"""Reading text, markdown, JSON and graph files as tables. Paths are whatever Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import after_first_line, first_line_title, squeeze_blank_lines
from termloom.sources.npz import NpzSource


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """One row for a file: text."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def _markdown(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return found.select(F.col("_metadata.file_name").alias("filename"), F.col("content").alias("raw"), F.is_valid_utf8(F.col("content").cast("string")).alias("fine"))


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename and content of the *.md files of a folder, not of those below it, that are UTF-8; unreadable_files() has the
    others, and a file without any bytes gives no row. Order by filename for a fixed order."""
    return _markdown(spark, folder).where("fine").select("filename", F.regexp_replace(F.col("raw").cast("string"), "\r\n?", "\n").alias("content"))


def unreadable_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename and n_bytes of the *.md files of a folder that markdown_files() leaves out."""
    return _markdown(spark, folder).where("NOT fine").select("filename", F.length("raw").alias("n_bytes"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """title, content and filename: a file's first line and its rest."""
    return markdown_files(spark, folder).select(first_line_title(F.col("content")).alias("title"), after_first_line(F.col("content")).alias("content"), "filename")


def terms(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of an analysis file, {"unknown_words": [{"word": ...}]}."""
    own = spark.read.schema("unknown_words array<struct<word string>>").json(path, multiLine=True)
    return own.select(F.explode("unknown_words.word").alias("word")).where("word IS NOT NULL").distinct()


def string_map(spark: SparkSession, path: str, key: str, value: str, kind: str = "string") -> DataFrame:
    """The entries of a file with one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias(key, value))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    return string_map(spark, path, "term", "definition")


def graph(spark: SparkSession, nodes: str, edges: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON files of a term graph; without an edges file there are none."""
    n = string_map(spark, nodes, "term", "own", "struct<definition string>").select("term", "own.definition")
    schema = "source string, target string, type string, weight double"
    if edges is None:
        return n, spark.createDataFrame([], schema)
    out = string_map(spark, edges, "source", "out", "array<struct<target string, type string, weight double>>")
    return n, out.select("source", F.explode("out").alias("e")).select("source", "e.*")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """term and embedding of an npz file (or a folder of them) with arrays of terms and embeddings, or of a JSON file that maps each
    term to its vector."""
    if path.endswith(".npz"):
        spark.dataSource.register(NpzSource)
        return spark.read.format("npz").load(path).select(F.col("terms").alias("term"), F.col("embeddings").alias("embedding"))
    return string_map(spark, path, "term", "embedding", "array<double>")


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """term and context of a file that maps each term to a list."""
    return string_map(spark, path, "term", "all", "array<string>").select("term", F.explode("all").alias("context"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a document's JSON file: doc, block and its fields."""
    schema = "array<struct<page int, section int, section_name string, subsection int, subsection_name string, content string>>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.posexplode(F.from_json("value", schema)).alias("block", "b"))
    return whole.select("doc", "block", "b.*")


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) that have text, with runs of blank lines as one."""
    return pages.where("text IS NOT NULL").withColumn("text", squeeze_blank_lines(F.col("text"))).where("text <> ''")


def graphml(spark: SparkSession, path: str, separator: str = "<SEP>") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an entity graph's XML file, multiple values as arrays and clusters as structs."""
    head = spark.read.format("xml").option("rowTag", "key").load(path)
    rows = head.collect()  # a file's few attribute declarations
    data = "data array<struct<_VALUE string, _key string>>"
    values = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"])))
    read = lambda tag, more: spark.read.format("xml").option("rowTag", tag).schema(f"{more}, {data}").load(path).withColumn("v", values)
    by_name = lambda kind: {r["_attr.name"]: F.col("v")[r["_id"]] for r in rows if r["_for"] == kind}
    many = lambda c: F.split(c, separator)
    n, e = by_name("node"), by_name("edge")
    nodes = read("node", "_id string").select(F.col("_id").alias("id"), n["entity_type"].alias("entity_type"), many(n["description"]).alias("description"), many(n["source_id"]).alias("source_id"), F.from_json(n["clusters"], "array<struct<level int, cluster int>>").alias("clusters"))
    edges = read("edge", "_source string, _target string").select(F.col("_source").alias("source"), F.col("_target").alias("target"), e["weight"].cast("double").alias("weight"), many(e["description"]).alias("description"), many(e["source_id"]).alias("source_id"), e["order"].cast("long").alias("order"))
    return nodes, edges
