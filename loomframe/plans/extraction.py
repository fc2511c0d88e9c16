"""Queries: extraction from pages and payloads, cleaning, masking, sinks that are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import exprs as X
from loomframe.operators import aggregates as A
from loomframe.operators import extract as E
from loomframe.plans.base import query
from loomframe.sources import adapters as V
from loomframe.sources import files as S

HREF = r'href="([^"]+)"'
ENTITIES = "replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
STRIP_SQL = "trim(regexp_replace(" + ENTITIES.format("regexp_replace(html, '<[^>]*>', ' ', 'g')") + ", '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS value, generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) AS i FROM pages), d AS (SELECT page_id, value, min(i) AS i FROM p GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place, value FROM d""")
def href_extract_distinct(spark, sf_dir):
    """Different links of each page in the order of their first places."""
    return E.matches(V.table(spark, sf_dir, "pages"), "page_id", "html", HREF)


@query(f"SELECT page_id, {STRIP_SQL} AS body, length({STRIP_SQL}) AS n FROM pages")
def strip_html(spark, sf_dir):
    body = X.strip_html(F.col("html"))
    return V.table(spark, sf_dir, "pages").select("page_id", body.alias("body"), F.length(body).cast("bigint").alias("n"))


@query("""WITH t AS (SELECT page_id, CASE WHEN len(regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1)) > 0 THEN regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1) ELSE regexp_extract_all(html, '<title>([^<]*)</title>', 1) END AS f FROM pages)
SELECT page_id, coalesce(f[1], '') AS title, len(f) AS n FROM t""")
def primary_or_fallback(spark, sf_dir):
    """Matches of a primary pattern, or of the fallback where it has none."""
    found = E.first_that_matches(F.col("html"), (r"<h1[^>]*>([^<]*)</h1>", 1), (r"<title>([^<]*)</title>", 1))
    return V.table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("title"), F.size(found).cast("bigint").alias("n"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS slug FROM pages) SELECT page_id, slug, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(translate(slug, '_-', '  '), ' ')], ' ') AS title FROM u""")
def slug_titles(spark, sf_dir):
    """Titles from the last part of addresses."""
    slug = F.regexp_extract("url", "([^/]*)$", 1)
    return V.table(spark, sf_dir, "pages").select("page_id", slug.alias("slug"), X.slug_title(slug).alias("title"))


CREDITS_SQL = E.CREDITS.replace("'", "''")


@query(f"""WITH r AS (SELECT doc_id, text, CASE WHEN trim(text) <> '' AND regexp_matches(text, '{CREDITS_SQL}') THEN 'credit' WHEN trim(text) <> '' AND regexp_matches(trim(text), '^[\\s.,!?…\\-–—~*''"()\\[\\]]+$') THEN 'junk' END AS removed FROM documents)
SELECT doc_id, removed, CASE WHEN removed IS NOT NULL THEN '' ELSE text END AS narration FROM r""")
def credit_mask(spark, sf_dir):
    """Masked, never dropped: credits first, then punctuation alone."""
    return E.masked(V.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "removed", "narration")


@query(f"""WITH r AS (SELECT lang, regexp_matches(text, '{CREDITS_SQL}') AS credit FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (credit) AS credits FROM r GROUP BY 1""")
def removed_counters(spark, sf_dir):
    rows = E.masked(V.table(spark, sf_dir, "documents").select("lang", "text"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("removed") == "credit").alias("credits"))


FORBIDDEN_SQL = "text || ' Welcome back. In this chapter 12: title'"
for _p in E.FORBIDDEN:
    FORBIDDEN_SQL = f"regexp_replace({FORBIDDEN_SQL}, '(?im){_p}', '', 'g')"


@query(f"SELECT doc_id, trim(regexp_replace({FORBIDDEN_SQL}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS narration FROM documents")
def forbidden_strip(spark, sf_dir):
    text = F.concat("text", F.lit(" Welcome back. In this chapter 12: title"))
    return V.table(spark, sf_dir, "documents").select("doc_id", E.without_forbidden(text).alias("narration"))


@query("SELECT p_partkey AS id FROM part WHERE coalesce(CASE WHEN p_size % 3 = 0 THEN 'http://x' WHEN p_size % 3 = 1 THEN '' END, '') = ''")
def hosted_elsewhere(spark, sf_dir):
    """Rows without an external address."""
    url = F.when(F.col("p_size") % 3 == 0, "http://x").when(F.col("p_size") % 3 == 1, "")
    return V.table(spark, sf_dir, "part").filter(F.coalesce(url, F.lit("")) == "").select(F.col("p_partkey").alias("id"))


@query(f"""WITH {V.TURNS}, t AS (SELECT chapter * 1000 + pos AS reply, (chapter + pos) % 6 AS form, coalesce(text, '') AS text, coalesce(role, '') AS role FROM turns)
SELECT reply, CAST(0 AS BIGINT) AS slot, CASE form WHEN 5 THEN '' ELSE text END AS text FROM t WHERE form <> 4
UNION ALL SELECT reply, 1, CASE form WHEN 3 THEN 'none' ELSE role END FROM t WHERE form IN (0, 1, 3) UNION ALL SELECT reply, 2, CASE form WHEN 1 THEN 'z' ELSE 'bare' END FROM t WHERE form IN (1, 2)""")
def json_slots(spark, sf_dir):
    """Items of mixed JSON replies at their slots: fenced, in prose, bare, out of range, without a text, and none at all."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    item = lambda index, value: F.to_json(F.struct(*([F.lit(index).alias("index")] if index is not None else []), *([value.alias("text")] if value is not None else [])))
    quoted = lambda value: F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    listed = lambda *items: F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    forms = F.array(
        F.concat(F.lit("```json\n"), listed(item(1, text), item(2, role)), F.lit("\n```")), F.concat(F.lit("Here: "), listed(quoted(text), quoted(role), F.lit('"z"')), F.lit(" done")),
        listed(item(0, F.lit("zero")), item(1, text), F.lit('"bare"')), listed(item(9, text), item(None, F.lit("none"))), F.lit("no array here"), listed(item(1, None), F.lit('"s"')),
    )
    form = ((F.col("chapter") + F.col("pos")) % 6).cast("int")
    raw = V.turns(spark, sf_dir).select((F.col("chapter") * 1000 + F.col("pos")).alias("reply"), F.element_at(forms, form + 1).alias("raw"), V.pick([2, 3, 3, 2, 2, 1], form).alias("expected"))
    return A.reply_slots(E.reply_items(raw, "reply", "raw"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.a.b') AS VARCHAR), 'none') AS deep FROM events")
def json_paths(spark, sf_dir):
    """Null-safe paths into JSON text."""
    v = F.try_parse_json("props")
    return V.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get(v, "$.a.b", "string"), F.lit("none")).alias("deep"))


@query("SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_nationkey % 2 = 0 THEN 'fr:' || n_name END, 'de:' || n_name) AS title FROM nation")
def localized_pick(spark, sf_dir):
    """The English title, else the first that is there."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    m = F.map_from_entries(F.filter(F.array(F.when(k % 3 == 0, entry("en", name)), F.when(k % 2 == 0, entry("fr", F.concat(F.lit("fr:"), name))), entry("de", F.concat(F.lit("de:"), name))), lambda e: e.isNotNull()))
    return V.table(spark, sf_dir, "nation").select(k.alias("id"), F.coalesce(F.try_element_at(m, F.lit("en")), F.get(F.map_values(m), F.lit(0))).alias("title"))


def scratch(spark) -> str:
    """A folder of our own below the shared one; it goes when the application ends."""
    return S.own_folder(spark)


@query(f"WITH {V.JOBS} SELECT job_id, status, voice || ', \"' || status || '\"' AS note, total_images FROM jobs")
def csv_round_trip(spark, sf_dir):
    """CSV export with doubled quotes, read back."""
    note = F.concat("voice", F.lit(', "'), "status", F.lit('"'))
    return S.csv_round_trip(V.jobs(spark, sf_dir).select("job_id", "status", note.alias("note"), "total_images"), scratch(spark))


@query(f"WITH {V.JOBS} SELECT job_id, status || ', \"' || voice || '\"' AS note, total_images FROM jobs")
def csv_with_mark(spark, sf_dir):
    """CSV export whose files begin with a byte-order mark, read back."""
    note = F.concat("status", F.lit(', "'), "voice", F.lit('"'))
    rows, path = V.jobs(spark, sf_dir).select("job_id", note.alias("note"), "total_images"), scratch(spark)
    S.csv_export(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, quote='"', escape='"')


@query(f"WITH {V.TURNS} SELECT chapter, 'p' || pos || '.jpg' AS image, arg_max(text, pos) AS text FROM turns GROUP BY 1, 2")
def narration_json(spark, sf_dir):
    """Narration files written per chapter, read back and checked item by item; of equal images the last wins."""
    rows = V.turns(spark, sf_dir).select("chapter", "pos", F.concat(F.lit("p"), F.col("pos").cast("string"), F.lit(".jpg")).alias("image"), "text")
    path = scratch(spark)
    S.write_narrations(rows, path)
    return S.read_narrations(spark, path)


@query(f"WITH {V.OCR} SELECT status = 'SUCCESS' AND regions > 0 AS accepted, count(*) AS n, CAST(sum(regions) AS BIGINT) AS regions FROM ocr GROUP BY 1")
def quarantine(spark, sf_dir):
    """Rows split by a check into an accepted and a quarantined table."""
    path = scratch(spark)
    rows = V.ocr(spark, sf_dir)
    S.quarantine(rows, (F.col("status") == "SUCCESS") & (F.col("regions") > 0), path)
    both = spark.read.parquet(path)
    return both.groupBy(F.col("accepted").cast("boolean").alias("accepted")).agg(F.count("*").alias("n"), F.sum("regions").cast("bigint").alias("regions"))


@query(f"""WITH {V.TURNS}, m AS (SELECT chapter, count(*) AS n FROM turns GROUP BY 1), t AS (SELECT chapter, pos, row_number() OVER (PARTITION BY chapter ORDER BY pos) AS place FROM turns)
SELECT chapter, place, 'frame_' || lpad(CAST(place AS VARCHAR), 4, '0') || '.jpg' AS frame, pos // 2 AS source FROM t WHERE chapter % 5 > 0""")
def manifest_rows(spark, sf_dir):
    """Frames and sources of manifests, written and read back; those of unequal lengths do not count."""
    pos = F.array_sort(F.collect_list("pos"))
    names = F.transform(pos, lambda _, i: F.concat(F.lit("frame_"), F.lpad((i + 1).cast("string"), 4, "0"), F.lit(".jpg")))
    sources = F.transform(pos, lambda p: F.floor(p / 2))
    # Every fifth chapter's list of sources lacks its last.
    short = F.when(F.col("chapter") % 5 == 0, F.slice(sources, F.lit(1), F.size(sources) - 1)).otherwise(sources)
    path = scratch(spark)
    V.turns(spark, sf_dir).groupBy("chapter").agg(names.alias("frames"), short.alias("sources")).write.json(path)
    return S.manifest(spark.read.schema("chapter bigint, frames array<string>, sources array<bigint>").json(path))


LISTING_SQL = f"""{V.LOGS}, files AS (SELECT job_id, 'Chapter ' || (log_id % 12) AS chapter, CASE WHEN log_id % 12 < 5 AND log_id % 7 < 4 THEN 'Frame_' || log_id || '.JPG' WHEN log_id % 7 = 6 THEN 'notes' || log_id || '.txt' ELSE 'page ' || log_id || '.png' END AS name, log_id * 10 AS length FROM logs)"""


def listed_files(spark, sf_dir):
    """A listing of image folders, one file for each log row: root/chapter/name."""
    k = F.col("log_id")
    name = F.when((k % 12 < 5) & (k % 7 < 4), F.format_string("Frame_%d.JPG", k)).when(k % 7 == 6, F.format_string("notes%d.txt", k)).otherwise(F.format_string("page %d.png", k))
    path = F.concat(F.lit("store/job"), F.col("job_id").cast("string"), F.lit("/Chapter "), (k % 12).cast("string"), F.lit("/"), name)
    return V.logs(spark, sf_dir).select(path.alias("path"), (k * 10).alias("length"))


@query(f"""WITH {LISTING_SQL}, i AS (SELECT * FROM files WHERE name NOT LIKE '%.txt'), c AS (SELECT job_id, chapter, row_number() OVER (PARTITION BY job_id ORDER BY CAST(regexp_extract(chapter, '[0-9]+') AS INT)) AS idx FROM (SELECT DISTINCT job_id, chapter FROM i))
SELECT 'job' || job_id AS root, chapter, CAST(idx AS BIGINT) AS idx, CAST(row_number() OVER (PARTITION BY job_id, chapter ORDER BY lower(name)[1], CAST(regexp_extract(name, '[0-9]+') AS INT)) AS BIGINT) AS place, name, length FROM i JOIN c USING (job_id, chapter) WHERE idx <= 5""")
def chapter_folders(spark, sf_dir):
    """Chapter folders in natural order, the first five of each root, with their images in natural order; folders without images give nothing."""
    return S.chapters_of(listed_files(spark, sf_dir), limit=5).select("root", "chapter", "idx", "place", "name", "length")


@query(f"""WITH {LISTING_SQL}, i AS (SELECT *, regexp_matches(name, '^(?i)frame_[0-9]+[.]jpe?g$') AS f FROM files WHERE name NOT LIKE '%.txt'), a AS (SELECT *, bool_or(f) OVER (PARTITION BY job_id, chapter) AS any_frame FROM i)
SELECT 'job' || job_id AS root, chapter, name FROM a WHERE f OR NOT any_frame""")
def frame_listing(spark, sf_dir):
    """Frame files of each chapter folder, or its page images where it has none."""
    return S.frames(S.chapters_of(listed_files(spark, sf_dir))).select("root", "chapter", "name")


@query(f"""WITH {LISTING_SQL} SELECT 'job' || job_id AS root, lower(regexp_extract(name, '[.]([A-Za-z0-9]+)$', 1)) AS kind, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM files WHERE name NOT LIKE '%.txt' GROUP BY 1, 2""")
def folder_sizes(spark, sf_dir):
    """Sizes of listed files by kind."""
    rows = S.listed(listed_files(spark, sf_dir))
    return rows.groupBy("root", "kind").agg(F.count("*").alias("n"), F.sum("length").cast("bigint").alias("bytes"))


@query("SELECT event_id, CAST(value - 100 AS DOUBLE) AS conf, event_type AS text FROM events WHERE value - 100 >= 0 AND event_id % 7 > 0")
def word_table(spark, sf_dir):
    """Recognised words of a tab-separated table, written and read back; those without confidence or text are dropped."""
    path = scratch(spark)
    rows = V.table(spark, sf_dir, "events").select("event_id", (F.col("value") - 100).alias("conf"), F.when(F.col("event_id") % 7 > 0, F.col("event_type")).otherwise("  ").alias("text"))
    rows.write.csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.word_table(spark, path).select(F.col("event_id").cast("bigint").alias("event_id"), F.col("conf").cast("double").alias("conf"), "text")


@query(f"WITH {V.JOBS} SELECT status, count(*) AS n, CAST(sum(total_images) AS BIGINT) AS images FROM jobs GROUP BY 1")
def promoted_snapshot(spark, sf_dir):
    """A snapshot that appears at once after its digest is checked, read back."""
    rows = S.promote(V.jobs(spark, sf_dir).select("job_id", "status", "total_images"), f"{scratch(spark)}-snapshot")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("total_images").cast("bigint").alias("images"))


@query("SELECT s_suppkey AS id, CAST(s_suppkey * 1024 + 7 AS BIGINT) // 1024 AS total_mb, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_nationkey * 2048 AS BIGINT) // 1024 END AS available_mb FROM supplier")
def memory_figures(spark, sf_dir):
    """Figures of a machine's memory report by key, in MB; one that the report lacks is null."""
    k = F.col("s_suppkey")
    report = F.concat(F.format_string("MemTotal:       %d kB\n", k * 1024 + 7), F.when(k % 3 > 0, F.format_string("MemAvailable: %d kB\n", F.col("s_nationkey") * 2048)).otherwise(""), F.lit("SwapMemTotal: 5 kB\n"))
    rows = S.key_figures(V.table(spark, sf_dir, "supplier").select(k.alias("id"), report.alias("report")), "report", "MemTotal", "MemAvailable")
    return rows.select("id", F.floor(F.col("MemTotal") / 1024).alias("total_mb"), F.floor(F.col("MemAvailable") / 1024).alias("available_mb"))
