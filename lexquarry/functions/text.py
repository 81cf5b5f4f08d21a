"""Scalar text functions as column expressions; Arrow UDFs only where a loop carries state or NFKC is needed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keywords import occurring

NUMERALS = "零〇一二三四五六七八九十百千万两"  # fixed values
FULL_WIDTH = "０１２３４５６７８９"


def first_text(*columns: str) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns))


def labelled(prefix: Column, text: Column, most: int = 100) -> Column:
    return F.when(F.trim(prefix) != "", F.concat(F.lit("【"), F.substring(prefix, 1, most), F.lit("】"), text)).otherwise(text)


def padded_article(article: Column) -> Column:
    """Pad a leading number to three digits, never cutting longer ones: 32BA to 032BA."""
    digits, rest = F.regexp_extract(article, r"^(\d+)([A-Za-z]*)$", 1), F.regexp_extract(article, r"^(\d+)([A-Za-z]*)$", 2)
    return F.when(digits == "", article).otherwise(F.concat(F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), rest))


def best_date(*columns: str) -> Column:
    """The first usable date among the columns: a bare year becomes its first of January, 0000-00-00 and blanks are none."""
    def usable(c: str) -> Column:
        v = F.substring(F.trim(F.col(c)), 1, 10)
        return F.when((v == "") | v.startswith("0000"), None).when(v.rlike(r"^\d{4}$"), F.concat(v, F.lit("-01-01"))).otherwise(v)

    return F.coalesce(*(F.when(F.try_to_timestamp(usable(c), F.lit("yyyy-MM-dd")).isNotNull(), usable(c)) for c in columns))


def years_in_effect(begin: Column, end: Column) -> Column:
    day = lambda c: F.coalesce(*(F.try_to_timestamp(c, F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")))
    return F.round(F.datediff(day(end), day(begin)) / 365.25, 2)


def keywords(df: DataFrame, by: Sequence[str], text: Column, n: int, stop: Sequence[str] = (), least: int = 3) -> DataFrame:
    """The n most frequent words (runs of two or more CJK characters, or of `least` letters) of each group, ties by word."""
    from ..operators.ranking import top_k

    words = df.select(*by, F.explode(F.regexp_extract_all(F.lower(text), F.lit(rf"[一-鿿]{{2,}}|\p{{L}}{{{least},}}"), F.lit(0))).alias("word"))
    counts = words.filter(~F.col("word").isin(*stop)).groupBy(*by, "word").agg(F.count("*").alias("n"))
    return top_k(counts, by, [F.desc("n"), F.col("word")], n)


def entity_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w]+", "_"), r"^_+|_+$", "")


def numeral_signature(name: Column) -> Column:
    """Runs of digits and runs of numerals, sorted and joined: names that differ here are different things."""
    return F.array_join(F.array_sort(F.regexp_extract_all(name, F.lit(f"[0-9]+|[{FULL_WIDTH}]+|[{NUMERALS}]+"), F.lit(0))), "|")


def chinese_number(text: Column) -> Column:
    """Numerals up to 99,999, in Chinese, full-width or plain digits, as a number; null if anything else is there."""
    plain = F.translate(text, FULL_WIDTH + "零〇一二三四五六七八九两", "0123456789" + "00123456789"[0:11] + "2")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(-1).alias("digit"))
    units = {"十": 10, "百": 100, "千": 1000}

    def step(acc: Column, c: Column) -> Column:
        one = F.greatest(acc["digit"], F.lit(0))
        count = F.when(acc["digit"] < 0, 1).otherwise(acc["digit"])
        unit = F.coalesce(*(F.when(c == u, F.lit(v)) for u, v in units.items()))
        made = lambda t, s, d: F.struct(t.cast("int").alias("total"), s.cast("int").alias("section"), d.cast("int").alias("digit"))
        return (
            F.when(unit.isNotNull(), made(acc["total"], acc["section"] + count * unit, F.lit(-1)))
            .when(c == "万", made((acc["total"] + acc["section"] + one) * 10000, F.lit(0), F.lit(-1)))
            .otherwise(made(acc["total"], acc["section"], F.coalesce(c.try_cast("int"), F.lit(0))))
        )

    folded = F.aggregate(F.split(plain, ""), start, step, lambda a: a["total"] + a["section"] + F.greatest(a["digit"], F.lit(0)))
    return F.when(plain.rlike(r"^\d+$"), plain.try_cast("int")).when(plain.rlike("^[0-9十百千万]+$"), folded)


def script_variants(text: Column, simple: str, traditional: str) -> Column:
    """The text as it is, in one script and in the other; each once."""
    return F.array_distinct(F.array(text, F.translate(text, traditional, simple), F.translate(text, simple, traditional)))


def routed_regions(text: Column, regions: dict[str, Sequence[str]]) -> Column:
    """The members of every region whose name a text has, each once, in the order of regions; empty if none."""
    none = F.array().cast("array<string>")
    named = [F.when(F.contains(F.lower(text), F.lit(k.lower())), F.array(*map(F.lit, v))).otherwise(none) for k, v in regions.items()]
    return F.array_distinct(F.concat(*named))


def canonical_group(name: Column, aliases: dict[str, str]) -> Column:
    """An alias's canonical name; else the name itself, in upper case unless it has CJK characters."""
    bare = F.trim(name)
    known = F.coalesce(*(F.when(F.lower(bare) == k.lower(), F.lit(v)) for k, v in aliases.items()))
    return F.coalesce(known, F.when(bare.rlike("[\u4e00-\u9fff]"), bare).otherwise(F.upper(bare)))


def cut_text(text: Column, most: int, mark: str = "...(cut)") -> Column:
    """At most `most` characters, marked if more were there."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def step_text(a: Column, relation: Column, b: Column, forward: Column) -> Column:
    """A hop with an arrow that shows its direction."""
    return F.when(forward, F.concat(a, F.lit(" —"), relation, F.lit("→ "), b)).otherwise(F.concat(a, F.lit(" ←"), relation, F.lit("— "), b))


def summary_text(side: Column, laws: Column, clauses: Column, titles: Column) -> Column:
    """A sentence from counts and the first three titles."""
    named = F.array_join(F.transform(F.slice(titles, 1, 3), lambda x: F.concat(F.lit("《"), x, F.lit("》"))), "、")
    return F.when(laws > 0, F.format_string("%s: %s, %d laws, %d clauses", side, named, laws, clauses)).otherwise(F.concat(side, F.lit(": nothing found")))


def normalised_query(text: Column, names: Sequence[str], phrases: Sequence[str]) -> Column:
    """Without jurisdiction names, scaffold phrases, punctuation and doubled spaces; left as it is if nothing remains."""
    drop = "|".join(re.escape(x) for x in sorted([*names, *phrases], key=len, reverse=True))
    bare = F.regexp_replace(text, f"(?i){drop}", " ") if drop else text
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[\p{P}\p{S}]+", " "), r"\s+", " "))
    return F.when(bare == "", text).otherwise(bare)


def detected_one(text: Column, names: dict[str, Sequence[str]]) -> Column:
    """The one name (of canonical to triggers) the text has, or null if none or several. Latin triggers need word boundaries."""
    def has(triggers: Sequence[str]) -> Column:
        parts = [rf"(?<![a-z0-9]){re.escape(x.lower())}(?![a-z0-9])" if x.isascii() else re.escape(x) for x in triggers]
        return F.lower(text).rlike("|".join(parts))

    found = F.filter(F.array(*(F.when(has(v), F.lit(k)) for k, v in names.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, found[0])


def retrieval_mode(text: Column, names: dict[str, Sequence[str]], conjunctions: Sequence[str]) -> Column:
    """How a query is to be run: several names are routed, conjunctions decomposed, one name filters, else global."""
    count = sum((F.lower(text).contains(v[0].lower()).cast("int") for v in names.values()), F.lit(0))
    joined = F.lower(text).rlike("|".join(re.escape(c) for c in conjunctions))
    return F.when(count > 1, "route").when(joined, "decompose").when(count == 1, "detected").otherwise("global")


def complexity(text: Column, triggers: Sequence[str], long: int = 400, short: int = 40) -> Column:
    """complex: long, several questions, or a trigger; simple: short; else standard."""
    several = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))) > 1
    asked = F.lit(False)
    for x in triggers:
        asked = asked | F.contains(F.lower(text), F.lit(x))
    return F.when((F.length(text) > long) | several | asked, "complex").when(F.length(text) < short, "simple").otherwise("standard")


def decomposed(text: Column, conjunctions: Sequence[str]) -> Column:
    """The parts between conjunctions, the first word shared by all of them."""
    parts = F.filter(F.split(text, "|".join(re.escape(c) for c in conjunctions)), lambda x: F.trim(x) != "")
    head = F.split(F.trim(text), " ")[0]
    return F.transform(parts, lambda x, i: F.when(i == 0, F.trim(x)).otherwise(F.concat_ws(" ", head, F.trim(x))))


def named_law(text: Column) -> Column:
    """A law's name: in title marks, else in quotes, else capitalised words that end in Act, Law, Code or Ordinance."""
    tries = [r"《([^》]+)》", r"\"([^\"]+)\"", r"((?:[A-Z][a-z]+ )+(?:Act|Law|Code|Ordinance))"]
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in tries))


def protection_score(text: Column, strong: Sequence[str], weak: Sequence[str]) -> Column:
    count = lambda words: sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.least(F.greatest(50 + 15 * count(strong) - 10 * count(weak), F.lit(20)), F.lit(100))


def kind_by_keywords(text: Column, kinds: dict[str, Sequence[str]], sure: int = 2) -> Column:
    """The first kind with `sure` keywords or more, else the one with most (first of ties), else null."""
    count = {k: sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in ws), F.lit(0)) for k, ws in kinds.items()}
    certain = F.coalesce(*(F.when(n >= sure, F.lit(k)) for k, n in count.items()))
    most = F.greatest(*count.values()) if len(count) > 1 else next(iter(count.values()))
    likely = F.coalesce(*(F.when((n == most) & (n > 0), F.lit(k)) for k, n in count.items()))
    return F.coalesce(certain, likely)


def char_overlap(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    return F.round(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)), 6)


def bigram_overlap(a: Column, b: Column) -> Column:
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    x, y = grams(a), grams(b)
    return F.round(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)), 6)


def first_sentences(text: Column, n: int = 2) -> Column:
    """The first n sentences, whole."""
    parts = F.filter(F.split(text, r"(?<=[。.!?！？])"), lambda x: F.trim(x) != "")
    return F.trim(F.array_join(F.slice(parts, 1, n), ""))


def midpoint_split(text: Column, mark: str = "。") -> Column:
    """Two halves at the middle sentence mark."""
    parts = F.filter(F.split(text, re.escape(mark)), lambda x: F.trim(x) != "")
    half = F.ceil(F.size(parts) / 2).cast("int")
    rest = F.greatest(F.size(parts) - half, F.lit(0))
    said = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x, F.lit(mark))), "")
    return F.struct(said(F.slice(parts, F.lit(1), F.greatest(half, F.lit(0)))).alias("first"), said(F.slice(parts, F.greatest(half, F.lit(0)) + 1, rest)).alias("second"))


def classified(docs: DataFrame, taxonomy: DataFrame, doc: str, text: str, least: float = 1.0) -> DataFrame:
    """(doc, topic, score, matched): weights of the keywords (topic, keyword, kind) that occur, 1 for strong and 0.3 for weak; a topic
    goes if an `exclude` keyword of it occurs or the sum is under `least`. Texts are read once, whatever the number of keywords."""
    rules = taxonomy.withColumn("__word", F.lower("keyword"))
    hits = occurring(docs.select(doc, F.lower(text).alias("__t")), F.col("__t"), rules, "__word").drop("__t").join(rules, "__word")
    weight = F.when(F.col("kind") == "strong", 1.0).when(F.col("kind") == "weak", 0.3).otherwise(0.0)
    got = hits.groupBy(doc, "topic").agg(F.round(F.sum(weight), 2).alias("score"), F.array_sort(F.collect_set(F.when(F.col("kind") != "exclude", F.col("keyword")))).alias("matched"), F.bool_or(F.col("kind") == "exclude").alias("veto"))
    return got.filter(~F.col("veto") & (F.col("score") >= least)).drop("veto")


def tolerant_json(text: Column, schema: str) -> Column:
    """The outermost braces of a text, fenced or not, read permissively; null where nothing can be read."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def _entity_names(names: pd.Series) -> pd.Series:
    clean = re.compile(r"[\W_]+")
    return names.map(lambda x: None if x is None else clean.sub("", unicodedata.normalize("NFKC", x).lower()))


def entity_name(name: Column) -> Column:
    """NFKC, lower case, no punctuation or space."""
    return F.pandas_udf(_entity_names, "string")(name)


def _windows(text: str, size: int, overlap: int, marks: str) -> list[str]:
    """Windows of `size`, cut at the last mark in a window's second half if there is one. At most half a window overlaps."""
    out, at, overlap = [], 0, max(0, min(overlap, size // 2))
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = max((text.rfind(m, at + size // 2, end) for m in marks), default=-1)
            end = cut + 1 if cut >= 0 else end
        out.append(text[at:end])
        if end == len(text):
            break
        if end <= at + overlap:
            out[-1], end = text[at : at + size], at + size
        at = end - overlap
    return out


def chunker(size: int = 800, overlap: int = 150, marks: str = "。！？；\n.!?"):
    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else _windows(t, size, overlap, marks))

    return chunks


def _packed(text: str, heading: re.Pattern, size: int, short: int) -> list[str]:
    """Sections at headings, packed while they fit; a short tail joins the piece before."""
    cuts = [m.start() for m in heading.finditer(text)]
    edges = sorted({0, *cuts, len(text)})
    out: list[str] = []
    for a, b in zip(edges, edges[1:], strict=False):
        if out and len(out[-1]) + b - a <= size:
            out[-1] += text[a:b]
        else:
            out.append(text[a:b])
    if len(out) > 1 and len(out[-1]) < short:
        tail = out.pop()
        out[-1] += tail
    return out


def section_packer(heading: str = r"(?m)^(?:第.{1,8}[章节節条條]|Article \d+|Section \d+)", size: int = 800, short: int = 300):
    pattern = re.compile(heading)

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else _packed(t, pattern, size, short))

    return packed


def merged_lines(text: Column) -> Column:
    """Lines of one character are joined to what follows on the same line: (, a, ) over three lines is (a)."""
    def step(acc: Column, line: Column) -> Column:
        short = F.length(F.trim(line)) <= 1
        glue = acc["short"] & short & (acc["text"] != "")
        text = F.when(acc["text"] == "", line).when(glue, F.concat(acc["text"], F.trim(line))).otherwise(F.concat(acc["text"], F.lit("\n"), line))
        return F.struct(text.alias("text"), short.alias("short"))

    return F.aggregate(F.split(text, "\n"), F.struct(F.lit("").alias("text"), F.lit(False).alias("short")), step, lambda a: a["text"])


#: Fixed values of the domain: numerals, the kinds of law whose number an article may follow, marks that end a reference.
_REF = re.compile(r"第\s*([0-9０-９]{1,4}|[零〇一二三四五六七八九十百千兩两]{1,8})\s*[條条]")
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2, "兩": 2}
_FOREIGN = re.compile(r"號\s*(?:法律|法令|行政法規|行政命令|批示|訓令|決議|規章)[^。；;]{0,60}$")
_MACAU = re.compile(r"第\s*(\d{1,4})\s*/\s*(\d{4})\s*號\s*(法律|行政法規)")
_KIND = {"法律": "LEI", "行政法規": "REG"}
_CHAPTER = re.compile(r"第\s*(\d{1,4})\s*章")
_BREAK = re.compile("[，,、。；;：:！？!?…]")


def number_of(s: str) -> int:
    """A numeral as int."""
    s = unicodedata.normalize("NFKC", s)
    if s.isdigit():
        return int(s)
    total, digit = 0, None
    for c in s:
        unit = {"十": 10, "百": 100, "千": 1000}.get(c)
        if unit:
            total, digit = total + (digit or 1) * unit, None
        else:
            digit = int(c) if c.isdigit() else _DIGITS.get(c, 0)
    return total + (digit or 0)


def own_references(text: str, article: int | None) -> list[int]:
    """Articles of the same law that a text names, each once: not its own number, and none that belongs to another law, as its
    number stands in an open title, just after a closed one, or in the clause after another law's number."""
    found: dict[int, None] = {}
    seen = depth = 0
    for m in _REF.finditer(text):
        depth += text.count("《", seen, m.start()) - text.count("》", seen, m.start())
        seen = m.start()
        before = text[max(0, seen - 200) : seen].rstrip()
        if depth <= 0 and not before.endswith("》") and not _FOREIGN.search(before[-80:]):
            found[number_of(m[1])] = None
    return [n for n in found if n > 0 and n != article]


def cross_references(text: str, law: str = "", article: int | None = None, gap: int = 8) -> list[tuple[str, int]]:
    """(law id, article), each once, for a numbered law or chapter that an article follows within `gap` characters without a mark
    between. A law's references to itself, and to the number of the article they stand in, are none."""
    laws = [(m.end(), f"MAC_{_KIND[m[3]]}_{int(m[1])}_{m[2]}") for m in _MACAU.finditer(text)]
    laws += [(m.end(), f"HK_CAP_{int(m[1])}") for m in _CHAPTER.finditer(text)]
    found: dict[tuple[str, int], None] = {}
    for at, target in laws:
        r = _REF.search(text, at, at + gap)
        if r and target != law and not _BREAK.search(text, at, r.start()) and number_of(r[1]) not in (0, article):
            found[target, number_of(r[1])] = None
    return list(found)


def _own_lists(texts: pd.Series, articles: pd.Series) -> pd.Series:
    return pd.Series([own_references(t or "", None if pd.isna(a) else int(a)) for t, a in zip(texts, articles, strict=True)])


def own_reference_list(text: Column, article: Column) -> Column:
    return F.pandas_udf(_own_lists, "array<int>")(text, article)


def _cross_lists(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [f"{a}::{n}" for a, n in cross_references(t or "")])


def cross_reference_list(text: Column) -> Column:
    """law_id::article of each reference to another law."""
    return F.pandas_udf(_cross_lists, "array<string>")(text)
