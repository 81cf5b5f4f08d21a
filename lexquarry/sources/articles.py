"""Reading article files: one JSON array or document per law, in four shapes, and the catalog that goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunker, first_text, labelled

ARTICLE = (
    "doc_id string, jurisdiction string, law_id string, law_type string, law_name string, article_number string, article_title string, chapter string, "
    "chunk_index int, text_zh string, text_pt string, text_en string, chunk_type string, is_substantive boolean, passing_date string, effective_date string, "
    "publication_date string, topics array<string>"
)
_INNER = f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in ARTICLE.split(', ')))}>>"
#: The four shapes: an array of articles; structure.parts; chapters; articles.
SHAPES = f"doc_id string, law_id string, law_name string, jurisdiction string, articles {_INNER}, chapters array<struct<chapter:string,articles:{_INNER}>>, structure struct<parts:array<struct<title:string,articles:{_INNER}>>>"
SKIPPED = r"/(recycle_bin|chroma_db|__pycache__|\.[^/]*)/"


def _law_from(id: Column, file: Column) -> Column:
    """The law id: from a doc_id before its article suffix, else from the file's name."""
    return F.coalesce(F.nullif(F.regexp_extract(id, r"^(.+)_ART_", 1), F.lit("")), F.nullif(F.regexp_replace(F.regexp_extract(file, r"([^/]+)\.json$", 1), "_cleaned$", ""), F.lit("")))


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """All articles under folder/*/*.json; a missing jurisdiction is the folder's name. Each file is read twice, once as an array and
    once as an object, with explicit schemas; the one that doesn't fit gives nothing."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    at = F.col("_metadata.file_path")
    flat = reader.schema(ARTICLE).json(folder).select("*", at.alias("file")).filter(F.col("doc_id").isNotNull() & F.coalesce("text_zh", "text_pt", "text_en", "article_number").isNotNull())
    nested = reader.schema(SHAPES).json(folder).select("*", at.alias("file"))
    none = F.expr(f"cast(array() as {_INNER})")
    lists = F.array(F.coalesce("articles", none), F.coalesce(F.flatten(F.col("chapters.articles")), none), F.coalesce(F.flatten(F.col("structure.parts.articles")), none))
    inner = nested.select("file", F.col("law_id").alias("__law"), F.col("law_name").alias("__name"), F.col("jurisdiction").alias("__j"), F.explode(F.flatten(lists)).alias("a"))
    inner = inner.select("a.*", "file", "__law", "__name", "__j")
    inner = inner.withColumns({"law_id": F.coalesce("law_id", "__law"), "law_name": F.coalesce("law_name", "__name"), "jurisdiction": F.coalesce("jurisdiction", "__j")}).drop("__law", "__name", "__j")
    every = flat.unionByName(inner).filter(~F.col("file").rlike(SKIPPED))
    parent = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return every.withColumns({"jurisdiction": F.coalesce("jurisdiction", parent), "law_id": F.coalesce("law_id", _law_from(F.col("doc_id"), F.col("file")))})


def chunks(articles: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """Chunk rows with ids {doc_id}_sub_{n}; the law-wide chunk_index is numbered anew over all chunks of a law."""
    from ..operators.ranking import ranked

    text = first_text("text_zh", "text_pt", "text_en")
    title = F.concat_ws(" ", F.nullif(F.trim("article_number"), F.lit("")), F.nullif(F.trim("article_title"), F.lit("")))
    parts = articles.filter(text.isNotNull()).select("law_id", "jurisdiction", "doc_id", "article_number", "topics", F.posexplode(chunker(size, overlap)(labelled(title, text))).alias("n", "content"))
    numbered = ranked(parts, ["law_id"], [F.col("doc_id"), F.col("n")], "place")
    return numbered.select(F.concat(F.col("doc_id"), F.lit("_sub_"), F.col("n").cast("string")).alias("id"), "law_id", "jurisdiction", "doc_id", "article_number", "topics", (F.col("place") - 1).alias("chunk_index"), "content")


def catalog(chunk_rows: DataFrame, most: int = 10) -> DataFrame:
    """One row per law: distinct non-blank articles, chunks, up to ten topics."""
    articles = F.countDistinct(F.when(F.trim("article_number") != "", F.col("article_number"))).alias("total_articles")
    rolled = chunk_rows.groupBy("law_id", "jurisdiction").agg(articles, F.count("*").alias("total_chunks"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))), 1, most).alias("topics"))
    return rolled.withColumn("status", F.lit("active"))


def changed_files(spark: SparkSession, folder: str, manifest: DataFrame | None) -> DataFrame:
    """Files (path, size, modified) that the manifest does not have as they are now."""
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return now if manifest is None else now.join(manifest, ["path", "size", "modified"], "left_anti")


def write_result_csv(results: DataFrame, path: str) -> None:
    """Result rows by strategy; a strategy that is written again replaces its rows only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("strategy").csv(path)


def read_result_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
