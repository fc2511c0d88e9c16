"""Extraction from landed pages and payloads, cleaning and masking of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that tell credits from story text.
CREDIT_PATTERNS = [
    r"scanlat", r"translat(?:ed|or|ion)\s+by", r"typeset(?:ting|ter)\s+by", r"proofread(?:er|ing)?\s+by", r"redraw(?:n|er|ing)?\s+by", r"clean(?:er|ing)\s+by",
    r"raw\s+(?:provider|by)", r"discord(?:\.gg)?", r"patreon", r"paypal", r"ko-?fi", r"buymeacoffee", r"donate", r"support\s+(?:us|the\s+(?:team|scanlat))",
    r"join\s+(?:our\s+)?(?:discord|server)", r"follow\s+(?:us|me)\s+(?:on|at)\b", r"@[\w-]+\s*(?:on\s+)?(?:twitter|insta|tiktok|youtube)", r"website\s*:",
    r"visit\s+(?:our\s+)?(?:site|website)", r"please\s+(?:wait|don.?t\s+re-?upload|do\s+not\s+re-?upload)", r"re-?upload", r"aggregator", r"chapter\s+end",
    r"end\s+of\s+chapter", r"next\s+chapter", r"coming\s+soon", r"credit\s+(?:to|goes)", r"special\s+thanks", r"powered\s+by",
]
#: Phrases that narration must not have.
FORBIDDEN = [r"\bchapter\s*\d*\b", r"\bwelcome back\b", r"\bin this (chapter|episode|part)\b", r"\b(chapter|episode)\s*(title|recap)\b", r"^\s*(chapter|episode)\s*\d+"]
#: Fixed value: text that is nothing but such marks.
PUNCTUATION_ONLY = r"^[\s.,!?…\-–—~*'\"()\[\]]+$"
CREDITS = "(?i)" + "|".join(CREDIT_PATTERNS)
#: Every match of a credit pattern has one of these in small letters, so texts without them need no pattern.
CREDIT_STEMS = (
    "scanlat translat typeset proofread redraw clean raw discord patreon paypal kofi ko-fi buymeacoffee donate support join follow @ website visit please upload aggregator chapter coming "
    "credit special powered"
).split()


def is_credit(text: Column) -> Column:
    low = F.lower(text)
    stem = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in CREDIT_STEMS])
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & F.when(stem, text.rlike(CREDITS)).otherwise(F.lit(False))


def is_junk(text: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & F.trim(text).rlike(PUNCTUATION_ONLY)


def masked(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with narration and removed: credits, then junk, become empty; no row is dropped."""
    removed = F.when(is_credit(F.col(text)), "credit").when(is_junk(F.col(text)), "junk")
    return rows.withColumn("removed", removed).withColumn("narration", F.when(F.col("removed").isNotNull(), "").otherwise(F.coalesce(text, F.lit(""))))


def without_forbidden(text: Column) -> Column:
    for pattern in FORBIDDEN:
        text = F.regexp_replace(text, "(?im)" + pattern, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def matches(pages: DataFrame, key: str, html: str, pattern: str, group: int = 1, limit: int | None = None) -> DataFrame:
    """Different matches of a pattern's group in each page, with their first place."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)))
    if limit:
        found = F.slice(found, 1, limit)
    return pages.select(key, F.posexplode(found).alias("pos", "value")).select(key, (F.col("pos") + 1).cast("bigint").alias("place"), "value")


def first_that_matches(html: Column, *patterns: tuple[str, int]) -> Column:
    """All matches of the first pattern that has any."""
    out = None
    for pattern, group in patterns:
        found = F.regexp_extract_all(html, F.lit(pattern), F.lit(group))
        out = F.when(F.size(found) > 0, found) if out is None else out.when(F.size(found) > 0, found)
    return F.coalesce(out, F.array().cast("array<string>"))


def reply_items(raw: DataFrame, key: str, text: str) -> DataFrame:
    """Items of a JSON reply: code fences and prose around it go, the outermost array is read, items may be objects or bare strings.

    raw: key, text, expected. A reply that is no array gives no items.
    """
    body = F.regexp_extract(F.col(text), r"(?s)(\[.*\])", 1)
    value = F.try_parse_json(F.when(body != "", body))
    rows = raw.withColumn("_v", F.try_variant_get(value, "$", "array<variant>")).select(key, "expected", F.posexplode("_v").alias("place", "item"))
    bare = F.schema_of_variant("item") == "STRING"
    return rows.select(
        F.col(key).alias("reply"), "expected", F.col("place").cast("bigint").alias("place"),
        F.when(~bare, F.try_variant_get("item", "$.index", "bigint")).alias("index"),
        F.when(bare, F.try_variant_get("item", "$", "string")).otherwise(F.try_variant_get("item", "$.text", "string")).alias("text"),
    )
