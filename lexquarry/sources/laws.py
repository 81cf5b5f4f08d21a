"""Laws kept as JSON files, one array of articles a law: created, replaced and deleted as rewrites of just their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .articles import ARTICLE

FIELDS = [x.split(" ")[0] for x in ARTICLE.split(", ")]


def write_laws(articles: DataFrame, folder: str) -> None:
    """Writes the laws that articles has, whole, and leaves the files of others as they are: folder/jurisdiction=../law_id=../ with one
    array, in the order of chunk_index and doc_id. Columns of ARTICLE that are missing are null, further ones are left out. A law
    without jurisdiction or law_id is an error. A law is one file, so it has to fit into a task, as when it is read."""
    need = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.raise_error(F.lit(f"a law needs its {c}")))
    kinds = dict(x.split(" ", 1) for x in ARTICLE.split(", "))
    fields = F.struct(*((F.col(c) if c in articles.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in FIELDS))
    rows = articles.select(need("jurisdiction").alias("jurisdiction"), need("law_id").alias("law_id"), F.struct(fields["chunk_index"].alias("at"), fields["doc_id"].alias("id"), fields.alias("article")).alias("a"))
    laws = rows.groupBy("jurisdiction", "law_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["article"])).alias("value"))
    _overwritten(laws, folder)


def delete_laws(laws: DataFrame, folder: str) -> None:
    """Empties the files of laws (jurisdiction, law_id)."""
    _overwritten(laws.select("jurisdiction", "law_id").distinct().withColumn("value", F.lit("[]")), folder)


def _overwritten(laws: DataFrame, folder: str) -> None:
    laws.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("jurisdiction", "law_id").text(folder)


def read_laws(spark: SparkSession, folder: str) -> DataFrame:
    """All articles that write_laws() wrote, and not delete_laws() deleted, with the columns of ARTICLE."""
    texts = spark.read.schema("value string, jurisdiction string, law_id string").option("wholetext", True).text(folder)
    return texts.select(F.explode(F.from_json("value", f"array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in ARTICLE.split(', '))}>>")).alias("a")).select("a.*")


def with_new_ids(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """Articles of new laws (jurisdiction, draft, ...) with a law_id in place of draft: the jurisdiction and the highest number that
    a known law_id (jurisdiction, law_id) there ends in, plus one for the first draft, two for the next, by name."""
    number = F.regexp_extract("law_id", r"(\d+)$", 1).try_cast("long")
    top = known.groupBy("jurisdiction").agg(F.coalesce(F.max(number), F.lit(0)).alias("top"))
    from ..operators.ranking import ranked

    laws = ranked(drafts.select("jurisdiction", "draft").distinct(), ["jurisdiction"], [F.col("draft")], "place").join(top, "jurisdiction", "left")
    ids = laws.select("jurisdiction", "draft", F.concat_ws("_", "jurisdiction", (F.coalesce("top", F.lit(0)) + F.col("place")).cast("string")).alias("law_id"))
    return drafts.drop("law_id").join(ids, ["jurisdiction", "draft"]).drop("draft")
