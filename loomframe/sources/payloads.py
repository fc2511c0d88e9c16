"""Landed search payloads of different shapes as one catalog schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.exprs import capitalised, slug_title, strip_html

CATALOG = ["source", "id", "title", "cover", "language", "year", "tags", "arrival"]
ITEM = ["id", "title", "cover", "language", "year", "tags", "rating"]
ITEMS = "array<struct<id:string,title:string,cover:string,language:string,year:bigint,tags:string,rating:string>>"
#: Where from_json keeps a text that it could not read.
BROKEN = "_broken"


def _json(schema: str) -> Column:
    """The payload by its schema, with the text itself in BROKEN where it is malformed."""
    return F.from_json("body", f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})


def _item(**columns: Column) -> Column:
    return F.struct(*[columns.get(c, F.lit(None)).cast("bigint" if c == "year" else "string").alias(c) for c in ITEM])


def tags_of(*arrays: Column) -> Column:
    """Several arrays of names as one comma-joined text without empty or missing names."""
    every = F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
    return F.array_join(F.filter(every, lambda t: t.isNotNull() & (t != "")), ",")


def rating_class(rating: Column) -> Column:
    """The class of an audience rating's text, the strictest word first; safe where there is none."""
    low = F.lower(F.coalesce(rating, F.lit("")))
    return F.when(low.contains("erotica"), "erotica").when(low.contains("hentai"), "pornographic").when(low.contains("mature") | low.contains("17"), "suggestive").otherwise("safe")


NAMES = "array<struct<name:string>>"
#: The JSON schemas, by source, and the field that has the list.
SCHEMAS = {
    "as": (f"data array<struct<slug:string,title:string,cover:string,genres:{NAMES},country:string>>", "data"),
    "md": ("data array<struct<id:string,attributes:struct<title:map<string,string>,year:int,tags:array<string>>,relationships:array<struct<type:string,file:string>>>>", "data"),
    "mal": (f"data array<struct<mal_id:bigint,title:string,year:int,genres:{NAMES},themes:{NAMES},demographics:{NAMES},rating:string>>", "data"),
    "al": ("media array<struct<id:bigint,title:struct<english:string,romaji:string>,country:string,description:string,status:string>>", "media"),
}


def flat_list(r: Column) -> Column:
    """{slug, title, cover, genres: [{name}], country}; a country code stands for the language."""
    language = F.when(r["country"] == "KR", "ko").when(r["country"] == "CN", "zh").when(r["country"] == "JP", "ja")
    return _item(id=r["slug"], title=r["title"], cover=r["cover"], language=language, tags=tags_of(r["genres"]["name"]))


def localized(r: Column) -> Column:
    """{id, attributes: {title: {lang: text}, year, tags}, relationships: [{type, file}]}; the English title, else the first."""
    a = r["attributes"]
    title = F.coalesce(F.try_element_at(a["title"], F.lit("en")), F.get(F.map_values(a["title"]), F.lit(0)))
    cover = F.get(F.filter(r["relationships"], lambda x: x["type"] == "cover_art"), F.lit(0))["file"]
    return _item(id=r["id"], title=title, cover=cover, year=a["year"], tags=tags_of(a["tags"]))


def three_tag_lists(r: Column) -> Column:
    """{mal_id, title, year, genres, themes, demographics, rating}: three lists of names, and a rating's class."""
    return _item(id=r["mal_id"], title=r["title"], year=r["year"], tags=tags_of(r["genres"]["name"], r["themes"]["name"], r["demographics"]["name"]), rating=rating_class(r["rating"]))


def graph(r: Column) -> Column:
    """{id, title: {english, romaji}, country, description, status}; descriptions lose their tags."""
    title = F.coalesce(F.when(r["title"]["english"] != "", r["title"]["english"]), r["title"]["romaji"])
    return _item(id=r["id"], title=title, language=F.lower(r["country"]), tags=F.concat_ws(",", capitalised(r["status"]), F.nullif(strip_html(r["description"]), F.lit(""))))


LISTS = {"as": flat_list, "md": localized, "mal": three_tag_lists, "al": graph}


#: Where search pages of each source hold ids, titles and covers.
SLUG_LINK = r'(?i)href="/manga/([a-z0-9_]+)/"'
CHAPTER_SLUG = r"^c[0-9]"
NUMBERED_LINK = r'(?i)href="([^"]*/en/([^"]+)/list\?title_no=([0-9]+))"'
TITLED_LINKS = {
    "mp": (r'href="/manga/([^"]+)"[^>]*>[\s\S]*?<h3[^>]*>([^<]+)</h3>[\s\S]*?(?:src="([^"]+)")?', 1, 2, 3),
    "tl": (r'href="https://toonily\.com/serie/([^/]+)/?"[^>]*>[\s\S]*?(?:src="([^"]+)")?[\s\S]*?<h3[^>]*>\s*<a[^>]*>([^<]+)</a>', 1, 3, 2),
}


def slug_links(limit: int = 10) -> Column:
    """Search pages that link to titles by slug: different slugs in order, without those of chapters, the first so many; titles from slugs."""
    slugs = F.array_distinct(F.regexp_extract_all("body", F.lit(SLUG_LINK), F.lit(1)))
    return F.transform(F.slice(F.filter(slugs, lambda s: ~s.rlike(CHAPTER_SLUG)), 1, limit), lambda s: _item(id=s, title=slug_title(s), tags=F.lit("")))


def numbered_links(limit: int = 10) -> Column:
    """Search pages that link to titles by number: the first link of each number; titles from the last part of its path."""
    group = lambda n: F.regexp_extract_all("body", F.lit(NUMBERED_LINK), F.lit(n))
    items = F.arrays_zip(group(2).alias("path"), F.transform(group(3), lambda n: n.cast("bigint")).alias("number"))
    first = F.filter(items, lambda x, i: (F.array_position(F.transform(items, lambda y: y["number"]), x["number"]) == i + 1) & (F.element_at(F.split(x["path"], "/"), -1) != ""))
    return F.transform(F.slice(first, 1, limit), lambda x: _item(id=x["number"], title=slug_title(F.element_at(F.split(x["path"], "/"), -1)), language=F.lit("ko"), tags=F.lit("")))


def titled_links(source: str, limit: int = 10) -> Column:
    """Search pages whose links are followed by a heading with the title: the first so many, repeated ones too."""
    pattern, slug, title, cover = TITLED_LINKS[source]
    group = lambda n, name: F.regexp_extract_all("body", F.lit(pattern), F.lit(n)).alias(name)
    found = F.slice(F.arrays_zip(group(slug, "slug"), group(title, "title"), group(cover, "cover")), 1, limit)
    return F.transform(found, lambda x: _item(id=x["slug"], title=F.trim(x["title"]), cover=F.nullif(x["cover"], F.lit("")), language=F.lit("ko" if source == "tl" else None), tags=F.lit("")))


PAGES = {"mh": slug_links, "ff": slug_links, "wt": numbered_links, "mp": lambda: titled_links("mp"), "tl": lambda: titled_links("tl")}


def read(payloads: DataFrame) -> DataFrame:
    """payloads (payload_id, source, body) with items, an array in the one shape of all sources, and broken, whether the payload could not be read.

    One pass over the payloads: each is read by the rule of its source. A malformed payload, and one of a source that is not known, has no
    items; a null body is broken. Items without an id are among them, as they count for the others' places.
    """
    items, broken = None, F.col("body").isNull()
    for source, rule in PAGES.items():
        items = (items if items is not None else F).when(F.col("source") == source, rule())
    for source, (schema, field) in SCHEMAS.items():
        parsed = _json(schema)
        items = items.when(F.col("source") == source, F.transform(parsed[field], LISTS[source]))
        broken = broken | ((F.col("source") == source) & parsed[BROKEN].isNotNull())
    return payloads.withColumns({"items": F.coalesce(items, F.array().cast(ITEMS)), "broken": broken})


def _named(item: Column) -> Column:
    return F.coalesce(item["id"], F.lit("")) != ""


def every_source(payloads: DataFrame, *more: str) -> DataFrame:
    """All shapes as one relation (CATALOG, and more columns of ITEM); a source without a payload, or with a broken one, adds nothing."""
    rows = read(payloads).select("source", "payload_id", F.posexplode("items").alias("pos", "r")).filter(_named(F.col("r")))
    columns = {"tags": F.coalesce("r.tags", F.lit("")), "arrival": (F.col("payload_id") * 1000 + F.col("pos")).cast("bigint"), "source": F.col("source")}
    return rows.select(*[columns.get(c, F.col(f"r.{c}")).alias(c) for c in (*CATALOG, *more)])


def failures(payloads: DataFrame, shown: int = 100) -> DataFrame:
    """For each source: payloads, items, broken payloads, those that could be read but have no item, and the begin of a broken one (the smallest)."""
    rows = read(payloads).withColumn("n", F.size(F.filter("items", _named)).cast("bigint"))
    empty = ~F.col("broken") & (F.col("n") == 0)
    return rows.groupBy("source").agg(
        F.count("*").alias("payloads"), F.sum("n").alias("items"), F.count_if("broken").alias("broken"), F.count_if(empty).alias("without_items"),
        F.min(F.when(F.col("broken"), F.left("body", F.lit(shown)))).alias("sample"),
    )
