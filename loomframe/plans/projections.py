"""Queries: projections, filters, sorts, ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions import exprs as X
from loomframe.operators import search as R
from loomframe.operators import places as N
from loomframe.plans.base import query
from loomframe.sources import adapters as V

W = Window


@query(f"WITH {V.JOBS} SELECT job_id, status, voice, created_at, updated_at, total_chapters, total_images, CASE WHEN status = 'done' THEN 100 ELSE CAST(least(99, total_chapters * 10) AS INTEGER) END AS progress FROM jobs")
def job_api_view(spark, sf_dir):
    """The public columns of a job: the credential-like ones (customer, price) are not among them."""
    rows = V.jobs(spark, sf_dir).withColumn("progress", F.when(F.col("status") == "done", 100).otherwise(F.least(F.lit(99), F.col("total_chapters") * 10)).cast("int"))
    return rows.select("job_id", "status", "voice", "created_at", "updated_at", "total_chapters", "total_images", "progress")


@query("SELECT p_partkey AS id, array_to_string([x FOR x IN string_split(p_type, ' ') || [CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END] IF x <> ''], ',') AS tags FROM part")
def tag_arrays(spark, sf_dir):
    """Several tag arrays as one, without empty tags."""
    tags = F.flatten(F.array(F.split("p_type", " "), F.array(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")))))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.filter(tags, lambda t: t != ""), ",").alias("tags"))


@query("SELECT r_name AS region, n_name AS nation, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def denormalised_groups(spark, sf_dir):
    """Nested groups flattened with their parent's columns."""
    nations, regions = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    groups = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("items"))
    return groups.select(F.col("r_name").alias("region"), F.posexplode("items").alias("pos", "nation")).select("region", "nation", (F.col("pos") + 1).cast("bigint").alias("place"))


#: Place of each status and of each stage in the progress bar; done is the last.
STATUS_PLACE = {"pending": 0, "scraping": 1, "transcribing": 2, "rendering": 4}
STAGE_PLACE = {"search": 0, "scrape": 1, "transcribe": 2, "translate": 2, "slice": 3, "narrate": 4, "tts": 4, "captions": 4, "render": 4, "merge": 4, "bgm": 4}
STAGES = ["search", "scrape", "transcribe", "slice", "tts", "none"]
CASES = lambda d, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " ELSE -1 END"


@query(f"""WITH {V.JOBS}, j AS (SELECT job_id, status, (['search', 'scrape', 'transcribe', 'slice', 'tts', 'none'])[job_id % 6 + 1] AS stage FROM jobs)
SELECT job_id, CAST(CASE WHEN status = 'done' THEN 5 WHEN status IN ('error', 'cancelled') THEN -1 ELSE greatest({CASES(STATUS_PLACE, "status")}, {CASES(STAGE_PLACE, "stage")}) END AS BIGINT) AS place FROM j""")
def stage_index(spark, sf_dir):
    """Progress-bar place: the greater of the status's and the stage's, unless the job is over."""
    look = lambda d, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c), F.lit(-1))
    stage = V.pick(STAGES, F.col("job_id") % 6)
    place = F.when(F.col("status") == "done", 5).when(F.col("status").isin("error", "cancelled"), -1).otherwise(F.greatest(look(STATUS_PLACE, F.col("status")), look(STAGE_PLACE, stage)))
    return V.jobs(spark, sf_dir).select("job_id", place.cast("bigint").alias("place"))


@query("""WITH e AS (SELECT event_id, (['scrape', 'transcribe', 'slice', 'render', 'merge', 'bgm', 'done', 'other'])[event_id % 8 + 1] AS stage, event_id % 13 AS i, event_id % 4 AS n FROM events)
SELECT event_id, least(100, greatest(0, CAST(floor(CASE stage WHEN 'scrape' THEN 5 + 25 * (i / greatest(1, n)) WHEN 'transcribe' THEN 30 + 15 * (i / greatest(1, n)) WHEN 'slice' THEN 40 + 5 * (i / greatest(1, n))
  WHEN 'render' THEN 45 + 50 * (i / greatest(1, n)) WHEN 'merge' THEN 95 WHEN 'bgm' THEN 97 WHEN 'done' THEN 100 ELSE 40 END + 0.5) AS BIGINT))) AS pct FROM e""")
def progress_remap(spark, sf_dir):
    """Progress of a stage as progress of the whole, rounded and clamped."""
    stage = V.pick(["scrape", "transcribe", "slice", "render", "merge", "bgm", "done", "other"], F.col("event_id") % 8)
    r = X.ratio(F.col("event_id") % 13, F.col("event_id") % 4)
    # Where each stage begins and how much of the whole it is.
    pct = (
        F.when(stage == "scrape", 5 + 25 * r).when(stage == "transcribe", 30 + 15 * r).when(stage == "slice", 40 + 5 * r).when(stage == "render", 45 + 50 * r)
        .when(stage == "merge", 95.0).when(stage == "bgm", 97.0).when(stage == "done", 100.0).otherwise(40.0)
    )
    return V.table(spark, sf_dir, "events").select("event_id", F.least(F.lit(100), F.greatest(F.lit(0), X.js_round(pct))).cast("bigint").alias("pct"))


@query(f"""WITH {V.JOBS}, p AS (SELECT * FROM jobs WHERE job_id IN (1, 2)), u AS (UNPIVOT (SELECT job_id, status, voice, CAST(total_chapters AS VARCHAR) AS chapters, CAST(total_images AS VARCHAR) AS images FROM p) ON status, voice, chapters, images INTO NAME attribute VALUE v)
SELECT attribute, max(v) FILTER (job_id = 1) AS left_value, max(v) FILTER (job_id = 2) AS right_value, max(v) FILTER (job_id = 1) = max(v) FILTER (job_id = 2) AS same FROM u GROUP BY 1""")
def comparison_unpivot(spark, sf_dir):
    """Two rows side by side, an attribute a row."""
    two = V.jobs(spark, sf_dir).filter("job_id in (1, 2)").select("job_id", "status", "voice", F.col("total_chapters").cast("string").alias("chapters"), F.col("total_images").cast("string").alias("images"))
    long = two.unpivot(["job_id"], ["status", "voice", "chapters", "images"], "attribute", "v")
    side = lambda n: F.max(F.when(F.col("job_id") == n, F.col("v")))
    return long.groupBy("attribute").agg(side(1).alias("left_value"), side(2).alias("right_value")).withColumn("same", F.col("left_value") == F.col("right_value"))


@query(f"""WITH {V.JOBS} SELECT job_id, CASE status WHEN 'done' THEN 'Completed — ' || total_chapters || ' chapters, ' || total_images || ' images' WHEN 'error' THEN 'Failed: ' || coalesce(nullif(voice, ''), 'Unknown error')
  WHEN 'cancelled' THEN 'Cancelled' WHEN 'pending' THEN 'Waiting to start...' ELSE 'In progress — ' || least(99, total_chapters * 10) || '%' END AS description FROM jobs""")
def notifications(spark, sf_dir):
    s = F.col("status")
    text = (
        F.when(s == "done", F.format_string("Completed — %d chapters, %d images", "total_chapters", "total_images")).when(s == "error", F.concat(F.lit("Failed: "), X.or_default(F.col("voice"), "Unknown error")))
        .when(s == "cancelled", "Cancelled").when(s == "pending", "Waiting to start...").otherwise(F.format_string("In progress — %d%%", F.least(F.lit(99), F.col("total_chapters") * 10)))
    )
    return V.jobs(spark, sf_dir).select("job_id", text.alias("description"))


SETTINGS_SQL = "s AS (SELECT c_nationkey AS owner, (['voice', 'limit', 'archive', 'language'])[c_custkey % 4 + 1] AS id, max(CASE c_custkey % 4 WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN 'bad' ELSE CAST(c_custkey AS VARCHAR) END WHEN 2 THEN CASE WHEN c_custkey % 8 = 2 THEN 'true' ELSE 'no' END ELSE c_mktsegment END) AS value FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1, 2)"


@query(f"""WITH {SETTINGS_SQL} SELECT owner, coalesce(max(value) FILTER (id = 'voice'), 'default') AS voice, coalesce(nullif(try_cast(max(value) FILTER (id = 'limit') AS BIGINT), 0), 10) AS chapter_limit,
  coalesce(max(value) FILTER (id = 'archive') = 'true', false) AS archive, coalesce(max(value) FILTER (id = 'language'), 'en') AS language FROM s GROUP BY 1""")
def settings_record(spark, sf_dir):
    """Key and value rows as one typed record with defaults."""
    k = F.col("c_custkey")
    value = F.when(k % 4 == 1, F.when(k % 8 == 1, "bad").otherwise(k.cast("string"))).when(k % 4 == 2, F.when(k % 8 == 2, "true").otherwise("no")).otherwise(F.col("c_mktsegment"))
    rows = V.table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_nationkey").alias("owner"), V.pick(["voice", "limit", "archive", "language"], k % 4).alias("id"), value.alias("value"))
    rows = rows.groupBy("owner", "id").agg(F.max("value").alias("value"))
    own = lambda i: F.max(F.when(F.col("id") == i, F.col("value")))
    return rows.groupBy("owner").agg(
        F.coalesce(own("voice"), F.lit("default")).alias("voice"), F.coalesce(F.nullif(own("limit").try_cast("bigint"), F.lit(0)), F.lit(10)).cast("bigint").alias("chapter_limit"),
        F.coalesce(own("archive") == "true", F.lit(False)).alias("archive"), F.coalesce(own("language"), F.lit("en")).alias("language"),
    )


@query("SELECT c_custkey AS id, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), 'default') AS voice, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 2 = 1 END, true) AS translate, coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END, 5) AS chapter_limit FROM customer")
def config_defaults(spark, sf_dir):
    """Empty, missing and false are three things: each default treats them its own way."""
    k = F.col("c_custkey")
    return V.table(spark, sf_dir, "customer").select(
        k.alias("id"), X.or_default(F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), "default").alias("voice"),
        F.coalesce(F.when(k % 2 == 0, k % 2 == 1), F.lit(True)).alias("translate"), F.coalesce(F.when(k % 5 != 0, F.col("c_nationkey")), F.lit(5)).alias("chapter_limit"),
    )


@query(f"WITH {V.CATALOG}, i AS (SELECT arrival, coalesce(source, 'q') || '-' || lower(replace(title, ' ', '-')) AS id FROM catalog) SELECT arrival, nullif(regexp_extract(id, '^(mh|ff|wt|as|md|mp|tl)-', 1), '') AS code, regexp_replace(id, '^(mh|ff|wt|as|md|mp|tl)-', '') AS slug FROM i")
def id_split(spark, sf_dir):
    """Source code and slug of prefixed ids; unknown prefixes have no code and stay."""
    pattern = "^(mh|ff|wt|as|md|mp|tl)-"
    i = F.concat(F.coalesce("source", F.lit("q")), F.lit("-"), F.lower(F.replace("title", F.lit(" "), F.lit("-"))))
    return V.catalog(spark, sf_dir).select("arrival", F.nullif(F.regexp_extract(i, pattern, 1), F.lit("")).alias("code"), F.regexp_replace(i, pattern, "").alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS title, array_to_string((string_split(lower(text), ' '))[1:20], ',') AS tags FROM documents")
def metadata_bundle(spark, sf_dir):
    """Title cut at 100 with an ellipsis, the first 20 tags."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.shortened(F.col("text")).alias("title"), F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 20), ",").alias("tags"))


@query(f"WITH {V.CATALOG} SELECT arrival FROM catalog WHERE coalesce(source, 'mh') = 'mh' AND lower(status) = 'ongoing'")
def source_status_filter(spark, sf_dir):
    return V.catalog(spark, sf_dir).filter((F.coalesce("source", F.lit("mh")) == "mh") & (F.lower("status") == "ongoing")).select("arrival")


@query(f"WITH {V.CATALOG} SELECT arrival FROM catalog WHERE contains(lower(title), 'red') OR contains(lower(brand), 'red') OR contains(lower(kind), 'red') OR contains(lower(coalesce(source, '')), 'red')")
def contains_any(spark, sf_dir):
    return V.catalog(spark, sf_dir).filter(X.any_contains("RED", F.col("title"), F.col("brand"), F.col("kind"), F.col("source"))).select("arrival")


@query(f"WITH {V.BOXES} SELECT page, box FROM boxes WHERE w * h BETWEEN 0.03 * 10000 AND 0.85 * 10000 AND w >= 8 AND h >= 5 AND w / h BETWEEN 0.15 AND 8.0")
def box_validity(spark, sf_dir):
    area, aspect = F.col("w") * F.col("h"), F.col("w").cast("double") / F.col("h")
    return V.boxes(spark, sf_dir).filter(area.between(0.03 * 10000, 0.85 * 10000) & (F.col("w") >= 8) & (F.col("h") >= 5) & aspect.between(0.15, 8.0)).select("page", "box")


@query("SELECT page_id, regexp_matches(url, '^https?://[a-z0-9./_-]+$') AND NOT contains(url, '..') AS safe, NOT (contains(lower(url), 'logo') OR contains(lower(url), 'icon') OR contains(lower(url), 'avatar')) AS content FROM pages")
def safe_names(spark, sf_dir):
    """Names that match the whitelist and climb no folders; image addresses that are no decoration."""
    url = F.col("url")
    return V.table(spark, sf_dir, "pages").select("page_id", (url.rlike("^https?://[a-z0-9./_-]+$") & ~url.contains("..")).alias("safe"), (~X.any_contains("logo", url) & ~X.any_contains("icon", url) & ~X.any_contains("avatar", url)).alias("content"))


@query(f"WITH {V.JOBS} SELECT job_id FROM jobs WHERE status IN ('pending', 'scraping', 'transcribing', 'translating', 'narrating', 'rendering') AND updated_at < TIMESTAMP '1998-08-01' - INTERVAL 1 HOUR")
def stuck_rows(spark, sf_dir):
    """Active rows not changed for an hour before a given time."""
    now = F.lit("1998-08-01").cast("timestamp_ntz")
    return V.jobs(spark, sf_dir).filter(F.col("status").isin(*X.ACTIVE) & (F.col("updated_at") < now - F.expr("INTERVAL 1 HOUR"))).select("job_id")


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 1000 THEN 'free disk ' || CAST(floor(s_acctbal) AS BIGINT) || ' below threshold 1000' WHEN s_nationkey < 5 THEN 'available RAM ' || s_nationkey || ' below threshold 5' ELSE '' END AS reason FROM supplier")
def resource_reason(spark, sf_dir):
    """The first threshold that is not met."""
    reason = F.when(F.col("s_acctbal") < 1000, F.format_string("free disk %d below threshold 1000", F.floor("s_acctbal"))).when(F.col("s_nationkey") < 5, F.format_string("available RAM %d below threshold 5", "s_nationkey")).otherwise("")
    return V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), reason.alias("reason"))


#: Words that a short title leaves out.
STOP_WORDS = ["the", "a", "an", "of", "and", "or", "in", "on", "at", "to"]


@query(f"WITH t AS (SELECT doc_id, string_split(replace(replace(text, 'ß', 's'), chr(10), ' '), ' ') AS w FROM documents) SELECT doc_id, upper(array_to_string(([x FOR x IN w IF x <> '' AND lower(x) NOT IN ({', '.join(repr(s) for s in STOP_WORDS)})])[1:3], ' ')) AS short FROM t")
def stop_word_title(spark, sf_dir):
    words = F.split(F.translate("text", "ß\n", "s "), " ")  # capitals of ß differ between engines
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.upper(F.array_join(F.slice(kept, 1, 3), " ")).alias("short"))


@query(f"WITH {V.CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY arrival) AS k FROM catalog WHERE source IS NOT NULL), l AS (SELECT 'mh' AS source, 0 AS lim UNION ALL SELECT 'ff', 5 UNION ALL SELECT 'wt', 500) SELECT source, arrival FROM r JOIN l USING (source) WHERE lim = 0 OR k <= least(25, greatest(1, lim))")
def clamped_limits(spark, sf_dir):
    """Limits are clamped to 1..25; a limit of 0 means all."""
    limits = spark.createDataFrame([("mh", 0), ("ff", 5), ("wt", 500)], "source string, lim int")
    k = F.row_number().over(W.partitionBy("source").orderBy("arrival"))
    rows = V.catalog(spark, sf_dir).join(F.broadcast(limits), "source").withColumn("k", k)
    return rows.filter((F.col("lim") == 0) | (F.col("k") <= F.least(F.lit(25), F.greatest(F.lit(1), F.col("lim"))))).select("source", "arrival")


SEARCH_KEY = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


def search_sql(q: str) -> str:
    return f"""WITH {V.CATALOG}, k AS (SELECT *, {SEARCH_KEY} AS key FROM catalog),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cover IS NULL, arrival) AS k, min(arrival) OVER (PARTITION BY key) AS first_at FROM k WHERE key <> ''),
r AS (SELECT *, CASE WHEN key = '{q}' THEN 0 WHEN starts_with(key, '{q}') THEN 1 WHEN contains(key, '{q}') THEN 2 ELSE 3 END AS relevance, coalesce(list_position({V.SOURCES[:9]}, coalesce(source, 'mh')) - 1, 99) AS prio FROM d WHERE k = 1)
SELECT title, arrival, source, cover, first_at, row_number() OVER (ORDER BY relevance, prio, first_at) AS place FROM r ORDER BY place LIMIT 225"""


@query(search_sql("red"))
def federated_search(spark, sf_dir):
    """All sources' hits as one list: duplicates by title, the first with a cover wins, ranked by relevance and source."""
    return R.federated([V.catalog(spark, sf_dir)], "Red").select("title", "arrival", "source", "cover", "first_at", "place")


@query(f"""WITH {V.CATALOG}, n AS (SELECT arrival, title, source, year, try_cast(nullif(regexp_extract(last_chapter, '^\\s*([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS chapters FROM catalog)
SELECT arrival, chapters, row_number() OVER (PARTITION BY source ORDER BY lower(title), arrival) AS by_title, row_number() OVER (PARTITION BY source ORDER BY coalesce(year, 0) DESC, arrival) AS newest, row_number() OVER (PARTITION BY source ORDER BY coalesce(year, 9999), arrival) AS oldest, row_number() OVER (PARTITION BY source ORDER BY coalesce(chapters, 0.0) DESC, arrival) AS longest FROM n""")
def catalog_sorts(spark, sf_dir):
    """Places in the sort orders within each source; missing years come last both ways, chapter numbers are read from text."""
    rows = V.catalog(spark, sf_dir).withColumn("chapters", X.leading_number(F.col("last_chapter")))
    at = lambda *keys: F.row_number().over(W.partitionBy("source").orderBy(*keys, "arrival")).cast("bigint")
    return rows.select("arrival", "chapters", at(F.lower("title")).alias("by_title"), at(F.coalesce("year", F.lit(0)).desc()).alias("newest"), at(F.coalesce("year", F.lit(9999))).alias("oldest"), at(F.coalesce("chapters", F.lit(0.0)).desc()).alias("longest"))


NATURAL = "regexp_replace(regexp_replace(lower(n), '([0-9]+)', '00000000000000000000\\1', 'g'), '0*([0-9]{20})([^0-9]|$)', '\\1\\2', 'g')"


@query(f"WITH x AS (SELECT s_suppkey AS id, s_nationkey, 'Page ' || s_suppkey || '.' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '.JPG' ELSE '.jpg' END AS n FROM supplier) SELECT id, n AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY {NATURAL}, id) AS place FROM x")
def natural_sort_rank(spark, sf_dir):
    """Numbers in names sort by value."""
    name = F.concat(F.lit("Page "), F.col("s_suppkey").cast("string"), F.lit("."), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".JPG").otherwise(".jpg"))
    rows = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", name.alias("name"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("s_nationkey").orderBy(X.natural_key(F.col("name")), "id")).cast("bigint")).drop("s_nationkey")


@query(f"""WITH {V.CATALOG}, n AS (SELECT arrival, title, source, year, try_cast(nullif(regexp_extract(last_chapter, '^\\s*([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS chapters FROM catalog)
SELECT arrival, row_number() OVER (ORDER BY lower(title), arrival) AS by_title, row_number() OVER (ORDER BY lower(title) DESC, arrival) AS from_z, row_number() OVER (ORDER BY coalesce(year, 0) DESC, arrival) AS newest, row_number() OVER (ORDER BY coalesce(chapters, 0.0) DESC, arrival) AS longest FROM n""")
def catalog_places(spark, sf_dir):
    """Places of the whole catalog in the sort orders of its list; titles compare by the collation of the Unicode root, whatever their case."""
    rows = V.catalog(spark, sf_dir).select("arrival", F.collate("title", "UNICODE_CI").alias("title"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(X.leading_number(F.col("last_chapter")), F.lit(0.0)).alias("chapters"))
    out = rows.select("arrival")
    for name, column, key in (("by_title", "title", F.asc), ("from_z", "title", F.desc), ("newest", "year", F.desc), ("longest", "chapters", F.desc)):
        out = out.join(N.numbered(rows.select("arrival", column), [key(column), F.col("arrival")], name).select("arrival", name), "arrival")
    return out


@query(f"WITH x AS (SELECT s_suppkey AS id, 'Page ' || s_suppkey || '.' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '.JPG' ELSE '.jpg' END AS n FROM supplier) SELECT id, n AS name, row_number() OVER (ORDER BY {NATURAL}, id) AS place FROM x")
def natural_places(spark, sf_dir):
    """Places of all names in natural order."""
    name = F.concat(F.lit("Page "), F.col("s_suppkey").cast("string"), F.lit("."), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".JPG").otherwise(".jpg"))
    rows = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"))
    return N.numbered(rows, [X.natural_key(F.col("name")), F.col("id")])


@query(f"WITH {V.JOBS} SELECT job_id, status, created_at FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 100")
def top_recent_jobs(spark, sf_dir):
    return V.jobs(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("job_id")).limit(100).select("job_id", "status", "created_at")
