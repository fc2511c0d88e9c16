"""Column functions: rounding, text, time and geometry rules of the content pipeline, all JVM-side."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Job states by class.
ACTIVE = ("pending", "scraping", "transcribing", "translating", "narrating", "rendering")
RETRYABLE = ("error", "cancelled", "done")


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def ratio(a: Column, b: Column) -> Column:
    """a / b with a divisor of 1 at least."""
    return a.cast("double") / F.greatest(F.lit(1.0), b.cast("double"))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == ""


def or_default(x: Column, default) -> Column:
    """Empty counts as missing."""
    return F.coalesce(F.when(x != "", x), F.lit(default))


def any_contains(needle: str, *columns: Column) -> Column:
    """Whether any column has the needle, without regard to case."""
    tests = [F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def slug_title(slug: Column) -> Column:
    """Words of a slug with a capital first letter; the rest of each word stays as it is."""
    words = F.split(F.translate(slug, "_-", "  "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def strip_html(html: Column) -> Column:
    """Tags first, then four entities, then white space."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without accents makes of a character, by rule from the Unicode tables: characters that become one
    letter or digit, these, and those that become several (a space for anything else)."""
    one, to, many = [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)
        if plain == c and not "\u0300" <= c <= "\u036f":
            continue
        parts = "".join(x if x.isascii() and (x.islower() or x.isdigit()) else " " for x in plain if not "\u0300" <= x <= "\u036f")
        if len(parts) == 1 and parts != " ":
            one.append(c)
            to.append(parts)
        elif parts.strip():
            many[c] = parts
    return "".join(one), "".join(to), many


#: Marks that go without a trace; translate drops what it has no answer for.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _class(characters: Iterable[str]) -> str:
    """A pattern for any of the characters, neighbours as ranges."""
    codes = sorted(map(ord, characters))
    first = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    last = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(first, last)) + "]"


def title_key(title: Column) -> Column:
    """Lower case, compatibility decomposition (NFKD), no accents, anything else than a-z and 0-9 as one space.

    Characters are replaced by tables made from the Unicode ones, so no letter that has a plain form is lost; the few that become several
    letters (ligatures, units) are looked up one by one, in titles that have any. Lower case is Java's, for the whole of Unicode.
    """
    one, to, many = _decompositions()
    low = F.lower(title)
    names = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    # Most texts have nothing beyond Latin-1, of which only three fractions become several characters: a short look decides for them.
    wide = F.when(low.rlike("[^\\x00-\\xBB\\xBF-\\xFF]") & low.rlike(_class(many)), spelled).otherwise(low)
    plain = F.when(low.rlike("[^\\x00-\\x7F]"), F.translate(wide, one + MARKS, to)).otherwise(low)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def last_sentences(text: Column, n: int = 2) -> Column:
    parts = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), F.lit(n)), " ")


def padded(text: Column, width: int, fill: str = "0") -> Column:
    """Padded on the left; longer text stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def unpadded(text: Column) -> Column:
    """Without leading zeros; nothing left is 0."""
    return or_default(F.regexp_replace(text, "^0+", ""), "0")


def shortened(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def safe_name(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9 _-]", ""), " +", "_"), F.lit(80))


def short_voice(voice: Column) -> Column:
    """From the third dash-separated part on, with two suffixes shortened (first occurrence)."""
    rest = F.array_join(F.slice(F.split(voice, "-"), F.lit(3), F.lit(1000)), "-")
    return F.regexp_replace(F.regexp_replace(rest, "^(.*?)Neural", "$1"), "^(.*?)Multilingual", "$1ML")


def redacted(text: Column) -> Column:
    """Key-like text keeps its first 8 characters."""
    return F.when(F.rlike(text, F.lit("^(gsk_|sk-)")), F.concat(F.left(text, F.lit(8)), F.lit("***"))).otherwise(text)


def extension(path: Column) -> Column:
    """Lower-case extension of the last path element, jpg if it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return or_default(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), "jpg")


def content_key(version: str, path: Column) -> Column:
    """16 hex digits of a versioned content key."""
    return F.left(F.sha2(F.concat(F.lit(version + ":"), path), 256), F.lit(16))


#: Error classes with the words that tell them, in the order in which they are tried.
ERROR_CLASSES = [
    ("TIMEOUT", ["timeout", "timed out"]),
    ("CORRUPT_ARTIFACT", ["corrupt", "ffprobe", "moov atom"]),
    ("PROVIDER_UNAVAILABLE", ["no such file", "not found", "missing binary"]),
    ("RESOURCE", ["disk", "memory", "resource", "oom"]),
    ("QUALITY", ["quality", "silence", "silent", "uncertain"]),
    ("INVALID_INPUT", ["invalid", "empty input"]),
]


def error_class(text: Column) -> Column:
    out = None
    for name, words in ERROR_CLASSES:
        test = F.contains(F.lower(text), F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(F.lower(text), F.lit(w))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("TRANSIENT")


def retryable(text: Column) -> Column:
    """Error text of a call that is worth another try."""
    return F.rlike(F.lower(text), F.lit(r"\b(408|425|429|500|502|503|504)\b|timeout|timed out|rate limit|overloaded|econnreset|temporarily"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def age_text(then: Column, now: Column, week_cap: bool = False, months: bool = False) -> Column:
    """just now, minutes, hours, days; optionally a date from a week on, or 30-day months."""
    s = seconds_between(then, now)
    unit = lambda n, suffix: F.concat(F.floor(s / n).cast("string"), F.lit(suffix))
    out = F.when(s < 60, "just now").when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago"))
    if week_cap:
        return out.when(s < 604800, unit(86400, "d ago")).otherwise(F.date_format(then, "yyyy-MM-dd"))
    if months:
        return out.when(s < 86400 * 30, unit(86400, "d ago")).otherwise(unit(86400 * 30, "mo ago"))
    return out.otherwise(unit(86400, "d ago"))


def duration_text(s: Column, drop_zero: bool = False) -> Column:
    """Seconds as 5s, 2m 5s or 3h 2m; with drop_zero a second unit of 0 is left out, else below zero is a dash."""
    m, h = F.floor(s / 60), F.floor(s / 3600)
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), b.cast("string"), F.lit(y))
    one = lambda a, x: F.concat(a.cast("string"), F.lit(x))
    rs, rm = s % 60, m % 60
    if drop_zero:
        return F.when(s < 60, one(s, "s")).when(m < 60, F.when(rs > 0, two(m, "m ", rs, "s")).otherwise(one(m, "m"))).otherwise(F.when(rm > 0, two(h, "h ", rm, "m")).otherwise(one(h, "h")))
    return F.when(s < 0, "—").when(s < 60, one(s, "s")).when(m < 60, two(m, "m ", rs, "s")).otherwise(two(h, "h ", rm, "m"))


def clock(s: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def leading_number(text: Column) -> Column:
    """The number that a text begins with, or null."""
    return F.try_cast(F.regexp_extract(text, r"^\s*([0-9]+(\.[0-9]+)?)", 1), "double") if hasattr(F, "try_cast") else F.regexp_extract(text, r"^\s*([0-9]+(\.[0-9]+)?)", 1).try_cast("double")


def natural_key(text: Column) -> Column:
    """Sorts digit runs by value and letters without case: digit runs padded to 20."""
    padded_runs = F.regexp_replace(F.lower(text), "([0-9]+)", "00000000000000000000$1")
    return F.regexp_replace(padded_runs, "0*([0-9]{20})(?![0-9])", "$1")


def inside_share(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Share of box a that lies in box b."""
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return (w * h).cast("double") / F.greatest(F.lit(1), aw * ah)
