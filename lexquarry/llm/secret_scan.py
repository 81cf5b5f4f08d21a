"""Secret scans: regular spans, and multipart credentials linked by an interval join within scopes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import normal_text, table

#: Fixed values: (kind, pattern, group with the value, least length of that value). The first three are the base kinds.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Weak parts: alone they are no secret.
WEAK = (
    ("ident", r"((?i:user(?:name)?|login|client_?id|account_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]+)", 2, 3),
    ("opaque", r"[A-Za-z0-9+/]+", 0, 20),
    ("endpoint", r"[a-z][a-z0-9+]{0,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0, 8),
)
KINDS = [k for k, *_ in BASE + WEAK]
#: How far apart, in code points, parts of one credential may lie.
SCOPE = 200
PARTS = "array<struct<no:int,i:int,gap:bigint,long:bigint,good:boolean>>"
#: Strings of which a text with such a part has one at least (in lower case): most texts need no pattern.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "ident": ("user", "login", "client", "account"), "endpoint": ("://",)}
#: Patterns of a run of one class of characters: only whole runs of the least length match, so other words are passed over at once.
RUNS = {"hex": "[0-9a-f]", "opaque": "[A-Za-z0-9+/]"}


def _pattern(no: int) -> str:
    kind, pattern, _, least = (BASE + WEAK)[no]
    return f"(?<!{RUNS[kind]}){RUNS[kind]}{{{least},}}+" if kind in RUNS else pattern


def _matches(text: Column, low: Column, no: int) -> Column:
    """All leftmost non-overlapping matches of one kind; null where no hint is in the text."""
    some = F.lit(False)
    for hint in HINTS.get(KINDS[no], ("",)):
        some = some | F.contains(low, F.lit(hint))
    return F.when(some, F.regexp_extract_all(text, F.lit(_pattern(no)), F.lit(0)))


def _found(text: Column, whole: Column, no: int) -> Column:
    """The matches with the text length before each; failing ones are marked, as they too take up text."""
    kind, pattern, group, least = (BASE + WEAK)[no]

    def good(m: Column) -> Column:
        if kind == "opaque":
            return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
        return F.length(F.regexp_extract(m, pattern, group) if group else m) >= least

    both = F.arrays_zip(F.slice(F.split(text, _pattern(no), -1), 1, F.size(whole)).alias("g"), whole.alias("m"))
    part = lambda x, i: F.struct(F.lit(no).alias("no"), i.alias("i"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("long"), good(x["m"]).alias("good"))
    return F.when(F.size(whole) > 0, F.transform(both, part))


def secret_parts(docs: DataFrame) -> DataFrame:
    """One row per part found (all base parts, and weak parts with the verdict of the join) and at least one per document.

    Columns: rid, doc_id, no, start, end (code points, end exclusive), kept. no is null for documents without any part.
    Parts of one credential are disjoint: an identifier that overlaps a base part, an endpoint that overlaps one of these, and an
    opaque string that overlaps any of the three are no parts of their own, neither reported nor evidence.
    The interval join: every weak part [s, e) meets the parts whose interval lies within SCOPE of it in the same document.
    As only existence counts, the nearest part of a class on each side decides: the largest end before and the least start
    after, which one sort a direction gives, with no pairs. A weak part counts if its complement is there: an identifier needs a
    secret, an opaque string needs an identifier, an endpoint needs both.
    One shuffle, of parts without text, by row. Null texts are empty; repeated rows are scanned each for itself."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", normal_text(F.col("text")).alias("text")).withColumn("low", F.lower("text"))
    rows = rows.select("rid", "doc_id", "text", *(_matches(F.col("text"), F.col("low"), no).alias(f"m{no}") for no in range(len(KINDS))))
    found = F.concat(*(F.coalesce(_found(F.col("text"), F.col(f"m{no}"), no), F.array().cast(PARTS)) for no in range(len(KINDS))))
    parts = rows.select("rid", "doc_id", F.explode_outer(found).alias("p")).select("rid", "doc_id", "p.*").repartition("rid")
    by_kind = Window.partitionBy("rid", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(by_kind)).withColumn("start", F.col("end") - F.col("long"))
    parts = parts.filter(F.col("no").isNull() | F.col("good") | (F.col("i") == 0))
    good, never = F.coalesce(F.col("good"), F.lit(False)), F.lit(False)
    before = Window.partitionBy("rid").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("no")).rowsBetween(Window.unboundedPreceding, -1)

    def extremes(parts: DataFrame, of: dict[str, Column]) -> DataFrame:
        for name, which in of.items():
            parts = parts.withColumn(f"{name}_end", F.max(F.when(which, F.col("end"))).over(before))
        for name, which in of.items():
            parts = parts.withColumn(f"{name}_start", F.min(F.when(which, F.col("start"))).over(after))
        return parts

    no = F.col("no")
    parts = extremes(parts, {"base": good & (no < len(BASE)), "id": good & (no == 3), "url": good & (no == 5)})
    over = {k: F.coalesce(F.col(f"{k}_end") > F.col("start"), never) | F.coalesce(F.col(f"{k}_start") < F.col("end"), never) for k in ("base", "id", "url")}
    part_of = F.when(no == 3, over["base"]).when(no == 5, over["base"] | over["id"]).when(no == 4, over["base"] | over["id"] | over["url"]).otherwise(never)
    parts = parts.withColumn("good", good & ~part_of)
    parts = extremes(parts, {"ident": F.col("good") & no.isin(1, 3), "secret": F.col("good") & no.isin(0, 2, 4)})
    near = {k: F.coalesce(F.col(f"{k}_end") >= F.col("start") - SCOPE, never) | F.coalesce(F.col(f"{k}_start") <= F.col("end") + SCOPE, never) for k in ("ident", "secret")}
    linked = F.when(no == 3, near["secret"]).when(no == 4, near["ident"]).otherwise(near["ident"] & near["secret"])
    return parts.select("rid", "doc_id", "no", "start", "end", (F.col("good") & ((no < len(BASE)) | linked)).alias("kept"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked. A document without spans has zeros and the empty string."""
    names = F.array(*map(F.lit, KINDS))
    kept = F.col("kept")
    span = F.when(kept, F.struct("start", "no", F.concat_ws(":", names[F.col("no")], F.col("start"), F.col("end")).alias("said")))
    got = secret_parts(docs).groupBy("rid", "doc_id").agg(
        *(F.count_if(kept & (F.col("no") == i)).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)),
        F.count_if(kept & (F.col("no") >= len(BASE))).alias("n_linked"),
        F.array_sort(F.collect_list(span)).alias("all"),
    )
    said = lambda a: F.array_join(F.transform(a, lambda x: x["said"]), ",")
    base = said(F.filter("all", lambda x: x["no"] < len(BASE)))
    return got.select("doc_id", *(f"n_{k}" for k, *_ in BASE), F.sha2(base, 256).alias("base_sha256"), said(F.col("all")).alias("spans"), "n_linked")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
