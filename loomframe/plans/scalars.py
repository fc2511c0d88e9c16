"""Queries: scalar rules of text, time, numbers and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import exprs as X
from loomframe.functions import sql as Q
from loomframe.plans.base import query
from loomframe.sources import adapters as V

KEY_SQL = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {KEY_SQL.format('text')} AS key FROM documents")
def title_normalize(spark, sf_dir):
    """Lower case without accents, other characters as one space."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.title_key(F.col("text")).alias("key"))


#: Letters of Latin-1, Latin Extended-A and the first half of Extended-B, one put behind each title, and the few that SQL's accents don't cover.
LETTERS = "".join(map(chr, range(0xC0, 0x250)))
COMPOUND = {"ĳ": "ij", "ŀ": "l ", "ŉ": " n", "ſ": "s", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz"}
LETTER_SQL = "lower(p_name || ' x' || chr(CAST(192 + p_partkey % 400 AS INTEGER)) || 'y')"
for letter, plain in COMPOUND.items():
    LETTER_SQL = f"replace({LETTER_SQL}, '{letter}', '{plain}')"


@query(f"SELECT p_partkey AS id, {KEY_SQL.format(LETTER_SQL)} AS key FROM part")
def title_keys_latin(spark, sf_dir):
    """Keys of titles with letters from all over the Latin blocks: none is lost that has a plain form."""
    letter = F.substring(F.lit(LETTERS), (F.col("p_partkey") % 400 + 1).cast("int"), F.lit(1))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.title_key(F.concat("p_name", F.lit(" x"), letter, F.lit("y"))).alias("key"))


@query("SELECT n_nationkey AS id, upper(n_name[1]) || lower(n_name[2:]) AS name, CASE WHEN length(CAST(n_nationkey * 77 AS VARCHAR)) >= 3 THEN CAST(n_nationkey * 77 AS VARCHAR) ELSE lpad(CAST(n_nationkey * 77 AS VARCHAR), 3, '0') END AS padded, coalesce(nullif(ltrim(lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), '0'), ''), '0') AS unpadded FROM nation")
def pad_and_case(spark, sf_dir):
    k = F.col("n_nationkey")
    return V.table(spark, sf_dir, "nation").select(k.alias("id"), X.capitalised(F.col("n_name")).alias("name"), X.padded((k * 77).cast("string"), 3).alias("padded"), X.unpadded(F.lpad(k.cast("string"), 4, "0")).alias("unpadded"))


@query("SELECT p_partkey AS id, left(regexp_replace(regexp_replace(p_name || '!? (' || p_brand || ')', '[^a-zA-Z0-9 _-]', '', 'g'), ' +', '_', 'g'), 80) AS file FROM part")
def safe_filenames(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.safe_name(F.concat("p_name", F.lit("!? ("), "p_brand", F.lit(")"))).alias("file"))


@query("WITH v AS (SELECT o_orderkey AS id, 'en-US-' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN 'MultilingualNeural' ELSE 'Neural' END AS v FROM orders) SELECT id, regexp_replace(regexp_replace(array_to_string((string_split(v, '-'))[3:], '-'), 'Neural', ''), 'Multilingual', 'ML') AS voice FROM v")
def short_voices(spark, sf_dir):
    v = F.concat(F.lit("en-US-"), "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "MultilingualNeural").otherwise("Neural"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.short_voice(v).alias("voice"))


@query("WITH s AS (SELECT c_custkey AS id, (['sk-', 'gsk_', 'plain-', ''])[c_custkey % 4 + 1] || c_mktsegment || c_custkey AS v FROM customer) SELECT id, CASE WHEN regexp_matches(v, '^(gsk_|sk-)') THEN left(v, 8) || '***' ELSE v END AS shown FROM s")
def redacted_secrets(spark, sf_dir):
    v = F.concat(V.pick(["sk-", "gsk_", "plain-", ""], F.col("c_custkey") % 4), "c_mktsegment", F.col("c_custkey").cast("string"))
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.redacted(v).alias("shown"))


@query("WITH s AS (SELECT s_suppkey AS id, '/a/b.c/' || s_name || (['.JPG', '.png', '', '.tar.gz'])[s_suppkey % 4 + 1] AS p FROM supplier) SELECT id, coalesce(nullif(lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '\\.([A-Za-z0-9]+)$', 1)), ''), 'jpg') AS ext, regexp_extract(p, '([^/]*)$', 1) AS name FROM s")
def extensions(spark, sf_dir):
    p = F.concat(F.lit("/a/b.c/"), "s_name", V.pick([".JPG", ".png", "", ".tar.gz"], F.col("s_suppkey") % 4))
    return V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), X.extension(p).alias("ext"), F.element_at(F.split(p, "/"), -1).alias("name"))


CLASS_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + f" THEN '{name}'" for name, words in X.ERROR_CLASSES) + " ELSE 'TRANSIENT' END"
ERRORS = ["operation timed out", "piper binary not found", "audio silence quality failure", "ffprobe corrupt artifact", "moov atom not found", "disk full", "invalid input", "HTTP 503", "rate limit", "fine"]


@query(f"WITH e AS (SELECT event_id, ({ERRORS!r})[event_id % 10 + 1] || ' ' || event_type AS t FROM events) SELECT event_id, {CLASS_SQL} AS class, regexp_matches(lower(t), '\\b(408|425|429|500|502|503|504)\\b|timeout|timed out|rate limit|overloaded|econnreset|temporarily') AS again FROM e")
def error_class(spark, sf_dir):
    """Error texts by class; the order of the tests matters."""
    t = F.concat(V.pick(ERRORS, F.col("event_id") % 10), F.lit(" "), "event_type")
    return V.table(spark, sf_dir, "events").select("event_id", X.error_class(t).alias("class"), X.retryable(t).alias("again"))


NOW = "2024-02-15 12:00:00"
AGE_SQL = "CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' {more} END"


@query(f"""WITH a AS (SELECT event_id, ts, date_diff('microsecond', ts, TIMESTAMP '{NOW}') // 1000000 AS s FROM events)
SELECT event_id, {AGE_SQL.format(more="ELSE s // 86400 || 'd ago'")} AS plain, {AGE_SQL.format(more="WHEN s < 604800 THEN s // 86400 || 'd ago' ELSE strftime(ts, '%Y-%m-%d')")} AS week, {AGE_SQL.format(more="WHEN s < 2592000 THEN s // 86400 || 'd ago' ELSE s // 2592000 || 'mo ago'")} AS months FROM a""")
def relative_age(spark, sf_dir):
    """Age texts at a given time, in their variants."""
    now, ts = F.lit(NOW).cast("timestamp"), F.col("ts").cast("timestamp")
    return V.table(spark, sf_dir, "events").select("event_id", X.age_text(ts, now).alias("plain"), X.age_text(ts, now, week_cap=True).alias("week"), X.age_text(ts, now, months=True).alias("months"))


DUR = "(l_partkey * 37 + l_suppkey * l_linenumber) % 20000 - 50"


@query(f"""WITH d AS (SELECT DISTINCT {DUR} AS s FROM lineitem), e AS (SELECT s, s // 60 AS m, s // 3600 AS h FROM d)
SELECT s, CASE WHEN s < 0 THEN '—' WHEN s < 60 THEN s || 's' WHEN m < 60 THEN m || 'm ' || s % 60 || 's' ELSE h || 'h ' || m % 60 || 'm' END AS both_units,
CASE WHEN s < 60 THEN s || 's' WHEN m < 60 THEN m || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || s % 60 || 's' ELSE '' END ELSE h || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || m % 60 || 'm' ELSE '' END END AS shortest,
CASE WHEN s >= 0 THEN CASE WHEN s >= 3600 THEN h || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(m AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock FROM e""")
def duration_texts(spark, sf_dir):
    s = ((F.col("l_partkey") * 37 + F.col("l_suppkey") * F.col("l_linenumber")) % 20000 - 50).alias("s")
    rows = V.table(spark, sf_dir, "lineitem").select(s).distinct()
    c = F.col("s")
    return rows.select("s", X.duration_text(c).alias("both_units"), X.duration_text(c, drop_zero=True).alias("shortest"), F.when(c >= 0, X.clock(c)).alias("clock"))


@query("SELECT c_custkey AS id, CAST(floor(c_acctbal / 100 + 0.5) AS BIGINT) AS js, CAST(round_even(c_acctbal / 100, 0) AS BIGINT) AS even, round(c_acctbal / greatest(1, c_nationkey), 6) AS share, CAST(greatest(1, floor(3 * (c_nationkey / 4) + 0.5)) AS BIGINT) AS minutes FROM customer")
def rounding_rules(spark, sf_dir):
    """Half up and half to even, divisors of one at least, estimates of one at least."""
    b, k = F.col("c_acctbal"), F.col("c_nationkey")
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.js_round(b / 100).cast("bigint").alias("js"), F.bround(b / 100, 0).cast("bigint").alias("even"), F.round(X.ratio(b, k), 6).alias("share"), F.greatest(F.lit(1), X.js_round(3 * (k / 4))).cast("bigint").alias("minutes"))


@query(f"""WITH {V.BOXES}, n AS (SELECT *, lead(x) OVER v AS bx, lead(y) OVER v AS by_, lead(w) OVER v AS bw, lead(h) OVER v AS bh FROM boxes WINDOW v AS (PARTITION BY page ORDER BY box))
SELECT page, box, round(greatest(0, least(x + w, bx + bw) - greatest(x, bx)) * greatest(0, least(y + h, by_ + bh) - greatest(y, by_)) / greatest(1, w * h), 6) AS inside, round(least(1920 / w, 1080 / h), 6) AS scale, CAST(floor((1920 - w * least(1920 / w, 1080 / h)) / 2) AS BIGINT) AS offset_x FROM n WHERE bx IS NOT NULL""")
def box_geometry(spark, sf_dir):
    """Share of a box in its neighbour, scale to fit a canvas and the centred offset."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("page").orderBy("box")
    rows = V.boxes(spark, sf_dir).withColumns({"b" + c: F.lead(c).over(own) for c in ("x", "y", "w", "h")}).filter("bx is not null")
    c = F.col
    scale = F.least(1920 / c("w"), 1080 / c("h"))
    return rows.select("page", "box", F.round(X.inside_share(*map(c, ("x", "y", "w", "h", "bx", "by", "bw", "bh"))), 6).alias("inside"), F.round(scale, 6).alias("scale"), F.floor((1920 - c("w") * scale) / 2).alias("offset_x"))


@query(f"WITH {V.OCR} SELECT page, round_even(least(1.0, greatest(0.0, conf)) * CAST(regions > 0 AS INTEGER), 4) AS quality, CASE WHEN regions > 0 AND trim(coalesce(text, '')) <> '' AND conf >= 0.55 THEN 'SUCCESS' ELSE 'UNCERTAIN' END AS verdict FROM ocr")
def quality_status(spark, sf_dir):
    quality = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("conf"))) * (F.col("regions") > 0).cast("int"), 4)
    good = (F.col("regions") > 0) & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0.55)
    return V.ocr(spark, sf_dir).select("page", quality.alias("quality"), F.when(good, "SUCCESS").otherwise("UNCERTAIN").alias("verdict"))


@query("SELECT s_suppkey AS id, CASE s_nationkey % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'ko' WHEN 2 THEN 'zh' END AS language, CASE WHEN s_suppkey % 2 = 0 THEN 'https://h/' || s_suppkey ELSE 'https://base/' || 'p/' || s_suppkey END AS url FROM supplier")
def code_maps(spark, sf_dir):
    """Countries to languages; relative addresses under a base."""
    k, path = F.col("s_nationkey") % 4, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://h/"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("p/"), F.col("s_suppkey").cast("string")))
    url = F.when(path.startswith("http"), path).otherwise(F.concat(F.lit("https://base/"), path))
    return V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(k == 0, "ja").when(k == 1, "ko").when(k == 2, "zh").alias("language"), url.alias("url"))


@query(f"WITH {V.LOGS} SELECT job_id, min(list_position(['purchase', 'click', 'view'], stage)) AS best, arg_min(stage, (coalesce(nullif(list_position(['purchase', 'click', 'view'], stage), 0), 99), ts)) AS primary_stage FROM logs GROUP BY 1")
def priority_failover(spark, sf_dir):
    """The member of the best priority in each group."""
    place = F.array_position(F.array(*map(F.lit, ["purchase", "click", "view"])), F.col("stage"))
    rows = V.logs(spark, sf_dir).withColumn("place", place)
    return rows.groupBy("job_id").agg(F.min(F.when(F.col("place") > 0, F.col("place"))).cast("int").alias("best"), F.min_by("stage", F.struct(F.when(F.col("place") > 0, F.col("place")).otherwise(99), "ts")).alias("primary_stage"))


@query("""WITH p AS (SELECT event_id, value / 10 AS dur, 5.0 + event_id % 3 AS expected, event_id % 5 > 0 AS video, event_id % 7 > 0 AS audio, CAST(floor(value * 40) AS BIGINT) AS s, event_type FROM events)
SELECT event_id, CASE WHEN NOT video THEN 'no video stream' WHEN NOT audio THEN 'no audio stream' WHEN abs(dur - expected) > 2.0 THEN 'duration differs' ELSE '' END AS reason,
  CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
  CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN event_type || ' items' ELSE event_type || '!' END AS shown FROM p""")
def sql_functions(spark, sf_dir):
    """Checks and formats as SQL functions, one replaced by a user's own."""
    own = {"lf_shown(value STRING, format STRING)": ("STRING", "CASE format WHEN 'upper' THEN upper(value) WHEN 'count' THEN concat(value, ' items') ELSE concat(value, '!') END")}
    Q.register(spark, scalars=own)
    return spark.sql(
        """SELECT event_id, lf_media_check(value / 10, 5.0D + event_id % 3, event_id % 5 > 0, event_id % 7 > 0) AS reason, lf_clock(CAST(floor(value * 40) AS BIGINT)) AS clock,
        lf_shown(event_type, CASE event_id % 3 WHEN 0 THEN 'upper' WHEN 1 THEN 'count' ELSE 'pct' END) AS shown FROM {events}""",
        events=V.table(spark, sf_dir, "events"),
    )


@query("""WITH d AS (SELECT doc_id, n_chars, regexp_extract_all(text, '[0-9]+') AS m FROM documents)
SELECT doc_id, 'match' AS kind, CAST(i AS BIGINT) AS place, m[i] AS value FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM d)
UNION ALL SELECT doc_id, 'window', i * 1000, CAST(least(n_chars, (i + 1) * 1000) AS VARCHAR) FROM (SELECT *, unnest(range(greatest(0, (n_chars - 1) // 1000) + 1)) AS i FROM d WHERE n_chars > 0)""")
def sql_table_functions(spark, sf_dir):
    """Table functions, joined laterally: all matches of a pattern, and stretches of a length."""
    Q.register(spark)
    return spark.sql(
        """SELECT doc_id, 'match' AS kind, CAST(place AS BIGINT) AS place, value FROM {docs}, LATERAL lf_matches(text, '[0-9]+')
        UNION ALL SELECT doc_id, 'window', lo, CAST(hi AS STRING) FROM {docs}, LATERAL lf_windows(n_chars, 1000)""",
        docs=V.table(spark, sf_dir, "documents"),
    )
