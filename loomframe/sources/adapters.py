"""The content-pipeline relations as views over the star-schema tables, each with its SQL twin.

Every view carries an explicit order column where order matters: nothing relies on scan order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
#: Source codes by search priority, then one that is unknown.
SOURCES = ["mh", "ff", "wt", "as", "md", "mp", "tl", "mal", "al", "zz"]
LANGS = ["en", "fr", "de", "es"]
#: Boxes that one task folds, about: sorts and folds hold no more at any size of the input.
TASK_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    """values[index] with a 0-based column index."""
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("updated_at"), F.count("*").alias("total_chapters"), F.sum("l_quantity").cast("bigint").alias("total_images")
    )
    orders = table(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "pending")
        .otherwise(pick(["error", "cancelled", "scraping", "transcribing", "rendering"], F.col("o_orderkey") % 5))
    )
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("customer_id"), status.alias("status"),
        F.col("o_orderpriority").alias("voice"), F.col("o_orderdate").alias("created_at"), "updated_at",
        F.coalesce("total_chapters", F.lit(0)).cast("bigint").alias("total_chapters"), F.coalesce("total_images", F.lit(0)).cast("bigint").alias("total_images"),
        F.col("o_totalprice").alias("price"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS customer_id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'pending' ELSE (['error', 'cancelled', 'scraping', 'transcribing', 'rendering'])[o_orderkey % 5 + 1] END AS status,
  o_orderpriority AS voice, o_orderdate AS created_at, updated_at, CAST(coalesce(n, 0) AS BIGINT) AS total_chapters, CAST(coalesce(q, 0) AS BIGINT) AS total_images, o_totalprice AS price
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS updated_at, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_KEY)
    status = (
        F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "done")
        .otherwise(pick(["scraped", "scraping", "transcribing", "transcribed", "rendering", "pending"], F.col("l_partkey") % 6))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.row_number().over(order).cast("bigint").alias("idx"), status.alias("status"),
        (F.col("l_discount") > 0.05).alias("rendered"), (F.col("l_tax") > 0.04).alias("transcribed"),
        F.col("l_quantity").cast("bigint").alias("images"), pick(LANGS, F.col("l_suppkey") % 4).alias("language"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"), F.col("l_shipdate").alias("shipped_at"),
    )


CHAPTERS = """chapters AS (SELECT l_orderkey AS job_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS idx,
  CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'done' ELSE (['scraped', 'scraping', 'transcribing', 'transcribed', 'rendering', 'pending'])[l_partkey % 6 + 1] END AS status,
  l_discount > 0.05 AS rendered, l_tax > 0.04 AS transcribed, CAST(l_quantity AS BIGINT) AS images, (['en', 'fr', 'de', 'es'])[l_suppkey % 4 + 1] AS language,
  l_partkey AS part_id, l_suppkey AS supp_id, l_shipdate AS shipped_at FROM lineitem)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts", "value", "props",
        pick(["info", "warn", "error", "success"], F.col("event_id") % 4).alias("level"),
        F.concat_ws(":", "event_type", "props").alias("message"),
    )


LOGS = """logs AS (SELECT event_id AS log_id, user_id AS job_id, event_type AS stage, ts, value, props,
  (['info', 'warn', 'error', 'success'])[event_id % 4 + 1] AS level, event_type || ':' || props AS message FROM events)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("arrival"), F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 13 != 0, pick(SOURCES, F.col("p_partkey") % 10)).alias("source"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("cover/"), F.col("p_partkey").cast("string"))).alias("cover"),
        F.when(F.col("p_size") % 7 != 0, 1990 + F.col("p_size")).cast("bigint").alias("year"),
        F.when(F.col("p_partkey") % 11 != 0, F.concat(F.round(F.col("p_retailprice")).cast("bigint").cast("string"), F.lit(".5 (end)"))).alias("last_chapter"),
        F.when(F.col("p_size") % 2 == 0, "Ongoing").otherwise("completed").alias("status"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
    )


CATALOG = """catalog AS (SELECT p_partkey AS arrival, p_name AS title,
  CASE WHEN p_partkey % 13 <> 0 THEN (['mh', 'ff', 'wt', 'as', 'md', 'mp', 'tl', 'mal', 'al', 'zz'])[p_partkey % 10 + 1] END AS source,
  CASE WHEN p_size > 25 THEN 'cover/' || p_partkey END AS cover, CASE WHEN p_size % 7 <> 0 THEN CAST(1990 + p_size AS BIGINT) END AS year,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(round(p_retailprice) AS BIGINT) || '.5 (end)' END AS last_chapter,
  CASE WHEN p_size % 2 = 0 THEN 'Ongoing' ELSE 'completed' END AS status, p_brand AS brand, p_type AS kind FROM part)"""


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("page"), F.floor(F.col("doc_id") / 25).alias("chapter"), "text", "lang", "source", "n_chars",
        F.when(F.col("quality") == 1, "SUCCESS").when(F.col("quality") == 0, "UNCERTAIN").otherwise("FAILED").alias("status"),
        F.floor(F.col("n_chars") / 400).alias("regions"), ((F.col("doc_id") * 37 % 101) / 100).alias("conf"),
    )


OCR = """ocr AS (SELECT doc_id AS page, doc_id // 25 AS chapter, text, lang, source, n_chars,
  CASE quality WHEN 1 THEN 'SUCCESS' WHEN 0 THEN 'UNCERTAIN' ELSE 'FAILED' END AS status, n_chars // 400 AS regions, (doc_id * 37 % 101) / 100 AS conf
  FROM documents LEFT JOIN labels USING (doc_id))"""


def boxes(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Boxes of pages. dealt: by page, in partitions whose number goes by the rows, not by a setting, so that what goes on by page needs no other
    exchange; not for what needs no numbers of boxes and sums before an exchange.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page").select("page", *LINE_KEY)
    order = Window.partitionBy("page").orderBy(*LINE_KEY)
    if dealt:
        lines = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS)), "page")
    return lines.withColumn("box", F.row_number().over(order).cast("bigint")).select(
        "page", "box", (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 100).alias("y"),
        (1 + F.col("l_quantity")).cast("bigint").alias("w"), (1 + F.col("l_linenumber") * 7).cast("bigint").alias("h"),
    )


BOXES = """boxes AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS box,
  l_partkey % 100 AS x, l_suppkey % 100 AS y, CAST(1 + l_quantity AS BIGINT) AS w, CAST(1 + l_linenumber * 7 AS BIGINT) AS h FROM lineitem)"""


def extent(spark: SparkSession, sf_dir: str) -> tuple[int, object, int]:
    """Of the row signal: its pages, whose number grows with the users, so that a page's rows do not; its first hour; its last row."""
    users, first, last = table(spark, sf_dir, "events").agg(F.max("user_id"), F.date_trunc("hour", F.min("ts")).alias("first"), F.max("ts")).first()
    rows = 0 if first is None else int((last - first).total_seconds() // 3600)
    return max(10, ((users or 0) + 1) // 15), first, rows


PAGES = "pages_of AS (SELECT greatest(10, (max(user_id) + 1) // 15) AS pages, date_trunc('hour', min(ts)) AS first FROM events)"


def signal(spark: SparkSession, sf_dir: str, found: tuple | None = None) -> DataFrame:
    """Rows of pages: events by hour, on a dense grid from the first hour to the last that any event has. found: extent(), where it is known."""
    pages, first, last = found or extent(spark, sf_dir)
    row = F.floor(F.timestamp_diff("SECOND", F.lit(first).cast("timestamp"), F.col("ts").cast("timestamp")) / 3600)
    hours = table(spark, sf_dir, "events").select((F.col("user_id") % pages).alias("page"), row.alias("row"), "value")
    counts = hours.groupBy("page", "row").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 4).cast("double").alias("mass"))
    grid = spark.range(pages).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("row"))
    return grid.join(counts, ["page", "row"], "left").select("page", "row", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("mass", F.lit(0.0)).alias("mass"))


SIGNAL = PAGES + """, hours AS (SELECT user_id % (SELECT pages FROM pages_of) AS page, CAST(floor(date_diff('second', (SELECT first FROM pages_of), date_trunc('second', ts)) / 3600) AS BIGINT) AS row, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 4) AS DOUBLE) AS mass FROM events GROUP BY 1, 2),
ends AS (SELECT max(row) AS last FROM hours),
signal AS (SELECT g.page, g.row, CAST(coalesce(c.n, 0) AS BIGINT) AS n, coalesce(c.mass, 0.0) AS mass
  FROM (SELECT page, unnest(range((SELECT last FROM ends) + 1)) AS row FROM (SELECT unnest(range((SELECT pages FROM pages_of))) AS page)) g LEFT JOIN hours c ON g.page = c.page AND g.row = c.row)"""


RATINGS = ["R - 17+ (violence)", "Rx - Hentai", "PG-13 - Teens", "Erotica 17", "", "For Mature readers"]


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed search payload of each part, in the shape of one of nine sources; every tenth is broken JSON."""
    k, name = F.col("p_partkey"), F.col("p_name")
    low, dash, key = F.replace(name, F.lit(" "), F.lit("_")), F.replace(name, F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string")
    text = lambda form, *c: F.format_string(form, *c)
    named = lambda c: F.array(F.struct(c.alias("name")))
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    slugs = text('<a href="/manga/%1$s/">x</a><a href="/manga/%1$s/">y</a><A HREF="/manga/c%2$s/">c</a><a href="/manga/x%2$s/">z</a>', low, key)
    numbered = text('<a href="https://w/en/drama/%1$s-%2$s/list?title_no=%2$s">a</a><a href="/en/x/again/list?title_no=%2$s">b</a><a href="/en/y/second-%1$s/list?title_no=0%3$s">c</a>', dash, key, (k + 1).cast("string"))
    titled = text('<a href="/manga/%1$s/%2$s" class="c"><div>\n<h3 class="t"> %3$s </h3>', key, dash, name)
    titled = F.concat(titled, F.when(k % 20 == 5, text('src="c/%s.jpg">', key)).otherwise(text('<img src="c/%s.jpg">', key)), text('<a href="/manga/%s">b<h3>Second</h3>', key))
    theme = text('<div><a href="https://toonily.com/serie/%2$s/" title="t">src="c/%1$s.jpg"<b></b>\n<h3 class="h5"> <a href="u">%3$s </a></h3></div>', key, dash, name)
    flat = F.to_json(F.struct(F.array(F.struct(dash.alias("slug"), name.alias("title"), F.lit("c1").alias("cover"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("").alias("name"))).alias("genres"), pick(["KR", "CN", "JP", "US"], F.floor(k / 10) % 4).alias("country")), F.struct(F.lit(None).cast("string").alias("slug"), F.lit("no id").alias("title"), F.lit("c").alias("cover"), named(F.lit("g")).alias("genres"), F.lit("KR").alias("country"))).alias("data")))
    title = F.map_from_entries(F.when(k % 20 == 4, F.array(entry("ko", F.lit("K")), entry("en", name))).otherwise(F.array(entry("fr", F.concat(F.lit("fr "), name)))))
    related = F.array(F.struct(F.lit("author").alias("type"), F.lit(None).cast("string").alias("file")), F.struct(F.lit("cover_art").alias("type"), F.concat(key, F.lit(".jpg")).alias("file")))
    localized = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("d"), key).alias("id"), F.struct(title.alias("title"), F.col("p_size").alias("year"), F.array(F.col("p_type"), F.lit(None).cast("string")).alias("tags")).alias("attributes"), related.alias("relationships"))).alias("data")))
    lists = F.to_json(F.struct(F.array(F.struct(k.alias("mal_id"), name.alias("title"), (F.col("p_size") + 1990).alias("year"), named(F.col("p_type")).alias("genres"), named(F.col("p_brand")).alias("themes"), F.array().cast("array<struct<name:string>>").alias("demographics"), pick(RATINGS, F.floor(k / 10) % 6).alias("rating"))).alias("data")))
    graph = F.to_json(F.struct(F.array(F.struct(k.alias("id"), F.struct(F.when(k % 20 == 8, "").otherwise(name).alias("english"), F.concat(F.lit("R "), name).alias("romaji")).alias("title"), F.lit("JP").alias("country"), text("<p>A &amp; %s</p>", name).alias("description"), F.lit("FINISHED").alias("status"))).alias("media")))
    body = F.element_at(F.array(slugs, slugs, numbered, flat, localized, titled, theme, lists, graph, F.lit('{"media": broken')), (k % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("payload_id"), pick(["mh", "ff", "wt", "as", "md", "mp", "tl", "mal", "al", "al"], k % 10).alias("source"), body.alias("body"))


_TITLED = "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split({0}, ' ')], ' ')"
#: What the payloads say, straight from the parts.
LANDED = f"""p AS (SELECT p_partkey AS k, p_partkey % 10 AS shape, p_name AS name, replace(p_name, ' ', '_') AS low, replace(p_name, ' ', '-') AS dash, p_type, p_brand, p_size FROM part),
landed(source, id, title, cover, language, year, tags, arrival) AS (
  SELECT CASE shape WHEN 0 THEN 'mh' ELSE 'ff' END, low, {_TITLED.format('name')}, NULL, NULL, NULL, '', k * 1000 FROM p WHERE shape < 2
  UNION ALL SELECT CASE shape WHEN 0 THEN 'mh' ELSE 'ff' END, 'x' || k, 'X' || k, NULL, NULL, NULL, '', k * 1000 + 1 FROM p WHERE shape < 2
  UNION ALL SELECT 'wt', CAST(k AS VARCHAR), {_TITLED.format("(name || ' ' || k)")}, NULL, 'ko', NULL, '', k * 1000 FROM p WHERE shape = 2
  UNION ALL SELECT 'wt', CAST(k + 1 AS VARCHAR), {_TITLED.format("('second ' || name)")}, NULL, 'ko', NULL, '', k * 1000 + 1 FROM p WHERE shape = 2
  UNION ALL SELECT 'as', dash, name, 'c1', ['ko', 'zh', 'ja', NULL][k // 10 % 4 + 1], NULL, p_type, k * 1000 FROM p WHERE shape = 3
  UNION ALL SELECT 'md', 'd' || k, CASE WHEN k % 20 = 4 THEN name ELSE 'fr ' || name END, k || '.jpg', NULL, p_size, p_type, k * 1000 FROM p WHERE shape = 4
  UNION ALL SELECT 'mp', k || '/' || dash, name, CASE WHEN k % 20 = 5 THEN 'c/' || k || '.jpg' END, NULL, NULL, '', k * 1000 FROM p WHERE shape = 5
  UNION ALL SELECT 'mp', CAST(k AS VARCHAR), 'Second', NULL, NULL, NULL, '', k * 1000 + 1 FROM p WHERE shape = 5
  UNION ALL SELECT 'tl', dash, name, 'c/' || k || '.jpg', 'ko', NULL, '', k * 1000 FROM p WHERE shape = 6
  UNION ALL SELECT 'mal', CAST(k AS VARCHAR), name, NULL, NULL, p_size + 1990, p_type || ',' || p_brand, k * 1000 FROM p WHERE shape = 7
  UNION ALL SELECT 'al', CAST(k AS VARCHAR), CASE WHEN k % 20 = 8 THEN 'R ' || name ELSE name END, NULL, 'jp', NULL, 'Finished,A & ' || name, k * 1000 FROM p WHERE shape = 8)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("pos"), "role", "text")


TURNS = "turns AS (SELECT conv_id AS chapter, turn AS pos, role, text FROM conversations)"
