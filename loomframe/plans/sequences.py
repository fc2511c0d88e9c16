"""Queries: numbering, runs, timelines, continuity, layout folds, top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions.exprs import clock, last_sentences
from loomframe.operators import joins as J
from loomframe.operators import sequences as S
from loomframe.operators import state as T
from loomframe.plans.base import query
from loomframe.sources import adapters as V

W = Window


@query(f"""WITH {V.CHAPTERS} SELECT job_id, idx, row_number() OVER (PARTITION BY job_id ORDER BY idx DESC) AS place, 'chapter_' || lpad(CAST(row_number() OVER (PARTITION BY job_id ORDER BY idx DESC) AS VARCHAR), 3, '0') AS folder FROM chapters""")
def reverse_numbering(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("idx"))).cast("bigint")
    return V.chapters(spark, sf_dir).select("job_id", "idx", place.alias("place"), F.format_string("chapter_%03d", place).alias("folder"))


@query(f"""WITH {V.LOGS}, b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, log_id DESC) AS back FROM logs)
SELECT job_id, log_id, message, row_number() OVER (PARTITION BY job_id ORDER BY back DESC) AS place FROM b WHERE back <= 50""")
def recent_logs(spark, sf_dir):
    return J.newest(V.logs(spark, sf_dir), "job_id", [F.col("ts"), F.col("log_id")], 50).select("job_id", "log_id", "message", "place")


@query(f"""WITH {V.LOGS}, b AS (SELECT *, row_number() OVER (ORDER BY ts DESC, log_id DESC) AS back FROM logs) SELECT log_id, job_id, level FROM b WHERE back <= 500""")
def tail_buffer(spark, sf_dir):
    return V.logs(spark, sf_dir).orderBy(F.desc("ts"), F.desc("log_id")).limit(500).select("log_id", "job_id", "level")


FLAG_SQL = f"""{V.SIGNAL}, f AS (SELECT page, row, last, n <= 1 AS flag FROM signal, ends),
x AS (SELECT f.page, f.row, avg(CASE WHEN g.flag THEN 1.0 ELSE 0.0 END) > 0.6 AS clear FROM f CROSS JOIN range(-2, 3) AS r(d)
  JOIN f g ON g.page = f.page AND g.row = CASE WHEN f.row + d < 0 THEN -(f.row + d) WHEN f.row + d > f.last THEN 2 * f.last - (f.row + d) ELSE f.row + d END GROUP BY 1, 2),
k AS (SELECT page, row, row - row_number() OVER (PARTITION BY page ORDER BY row) AS grp FROM x WHERE clear),
bands AS (SELECT page, min(row) AS lo, max(row) + 1 AS hi FROM k GROUP BY page, grp HAVING count(*) >= 4)"""


def bands(spark, sf_dir, found=None):
    rows = V.signal(spark, sf_dir, found).withColumn("flag", F.col("n") <= 1)
    return S.runs(S.smoothed(rows, "page", "row", "flag"), "page", "row", "clear", 4)


@query(f"WITH {FLAG_SQL} SELECT page, lo, hi FROM bands")
def gutter_bands(spark, sf_dir):
    """Moving average over a row signal, then stretches of clear rows."""
    return bands(spark, sf_dir)


COMPONENT_SQL = "components AS (SELECT page % (SELECT pages FROM pages_of) AS page, (page * 13 + box * 29) % 700 AS y1, (page * 13 + box * 29) % 700 + h AS y2, w * h AS area, page * 1000 + box AS place FROM boxes)"
OVERLAP_SQL = f"WITH {FLAG_SQL}, {V.BOXES}, {COMPONENT_SQL} SELECT b.page, lo, hi, place, y1, y2 FROM bands b JOIN components c ON b.page = c.page AND y1 < hi AND y2 > lo"


def components(boxes, pages):
    y = (F.col("page") * 13 + F.col("box") * 29) % 700
    return boxes.select(
        (F.col("page") % pages).alias("page"), y.alias("y1"), (y + F.col("h")).alias("y2"), (F.col("w") * F.col("h")).alias("area"), (F.col("page") * 1000 + F.col("box")).alias("place")
    )


@query(OVERLAP_SQL)
def overlap_bands(spark, sf_dir):
    """Interval-overlap join of all bands and boxes, by buckets."""
    found = V.extent(spark, sf_dir)
    return J.overlapping(bands(spark, sf_dir, found), components(V.boxes(spark, sf_dir), found[0]), "page", 64).select("page", "lo", "hi", "place", "y1", "y2")


@query(OVERLAP_SQL.replace("SELECT b.page, lo, hi, place, y1, y2", "SELECT b.page, lo, count(*) AS boxes, CAST(sum(least(hi, y2) - greatest(lo, y1)) AS BIGINT) AS covered") + " GROUP BY 1, 2")
def overlap_bands_whole(spark, sf_dir):
    """How many boxes reach into each band, and by how many rows in all."""
    found = V.extent(spark, sf_dir)
    rows = J.overlapping(bands(spark, sf_dir, found), components(V.boxes(spark, sf_dir), found[0]), "page", 64)
    return rows.groupBy("page", "lo").agg(F.count("*").alias("boxes"), F.sum(F.least("hi", "y2") - F.greatest("lo", "y1")).alias("covered"))


@query(f"""WITH {FLAG_SQL}, {V.BOXES}, {COMPONENT_SQL}, t AS (SELECT b.page, lo, hi, place, y1, y2, y1 - lo > hi - y2 AND y1 - lo > 4 AS up FROM bands b JOIN components c ON b.page = c.page AND y1 < hi AND y2 > lo AND area >= 40),
m AS (SELECT page, lo, hi, list({{'least': CASE WHEN NOT up AND hi - y2 > 4 THEN hi - greatest(2, (hi - y2) // 2) END, 'most': CASE WHEN up THEN lo + greatest(2, (y1 - lo) // 2) END}} ORDER BY place, y1, y2) AS moves FROM t GROUP BY 1, 2, 3),
r AS (SELECT page, lo, hi, list_reduce(moves, lambda s, c: {{'least': greatest(CASE WHEN s.least IS NOT NULL THEN least(s.least, c.most) END, c.least), 'most': least(s.most, c.most)}}) AS f FROM m)
SELECT b.page, b.lo, b.hi, greatest(least((b.lo + b.hi) // 2, f.most), f.least) AS cut FROM bands b LEFT JOIN r USING (page, lo, hi)""")
def band_cuts(spark, sf_dir):
    """Cut of each band, moved by the components that reach into it, one after the other."""
    found = V.extent(spark, sf_dir)
    return S.cut_points(bands(spark, sf_dir, found), components(V.boxes(spark, sf_dir), found[0]), "page")


@query(f"""WITH {FLAG_SQL}, b AS (SELECT page, (lo + hi) // 2 AS cut FROM bands UNION ALL SELECT DISTINCT page, 0 FROM signal UNION ALL SELECT page, max(row) + 1 FROM signal GROUP BY 1),
l AS (SELECT page, cut AS lo, lead(cut) OVER (PARTITION BY page ORDER BY cut) AS hi FROM b) SELECT page, lo, hi FROM l WHERE hi - lo >= 10""")
def cut_boundaries(spark, sf_dir):
    """Consecutive cuts as stretches, with the page's ends."""
    found = V.extent(spark, sf_dir)
    cuts = bands(spark, sf_dir, found).select("page", F.floor((F.col("lo") + F.col("hi")) / 2).alias("cut"))
    ends = V.signal(spark, sf_dir, found).groupBy("page").agg((F.max("row") + 1).alias("end"))
    ends = ends.select("page", F.explode(F.array(F.lit(0).cast("bigint"), F.col("end"))).alias("cut"))
    hi = F.lead("cut").over(W.partitionBy("page").orderBy("cut"))
    return cuts.union(ends).select("page", F.col("cut").alias("lo"), hi.alias("hi")).filter("hi - lo >= 10")


@query(f"""WITH {V.SIGNAL}, t AS (SELECT page, row FROM signal WHERE n = 0), p AS (SELECT page, row AS spot FROM signal WHERE row % 24 = 12),
d AS (SELECT p.page, p.spot, t.row, row_number() OVER (PARTITION BY p.page, p.spot ORDER BY abs(t.row - p.spot), t.row) AS k FROM p LEFT JOIN t ON t.page = p.page AND abs(t.row - p.spot) <= 24)
SELECT page, spot AS "at", coalesce(row, spot) AS snapped FROM d WHERE k = 1""")
def nearest_clear_row(spark, sf_dir):
    rows = V.signal(spark, sf_dir)
    return J.nearest(rows.filter("row % 24 = 12").select("page", F.col("row").alias("at")), rows.filter("n = 0"), "page", 24)


@query(f"""WITH {V.TURNS}, f AS (SELECT chapter, pos, len(regexp_extract_all(text, '[^ ]+')) AS words FROM turns),
e AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY chapter) AS n, sum(words) OVER (PARTITION BY chapter) AS total, sum(words) OVER w AS upto FROM f WINDOW w AS (PARTITION BY chapter ORDER BY pos)),
g AS (SELECT *, CASE WHEN total > 0 THEN upto / total ELSE i / n END * (total * 0.4) AS e FROM e),
h AS (SELECT *, 3.0 * i + greatest(0.0, max(e - 3.0 * i) OVER (PARTITION BY chapter ORDER BY pos)) AS stop FROM g)
SELECT chapter, pos, round(coalesce(lag(stop) OVER (PARTITION BY chapter ORDER BY pos), 0.0), 4) AS start, round(stop + CASE WHEN i = n THEN 0.5 ELSE 0.0 END, 4) AS "end" FROM h""")
def frame_timeline(spark, sf_dir):
    """Word-proportional timings with a least duration and push-out."""
    rows = V.turns(spark, sf_dir).withColumn("words", F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))))
    total = F.sum("words").over(W.partitionBy("chapter")) * 0.4
    return S.frame_timeline(rows, ["chapter"], "pos", "words", total).select("chapter", "pos", "start", "end")


TAIL_SQL = r"""array_to_string((regexp_split_to_array(trim(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')), chr(1)))[-2:], ' ')"""


@query(f"""WITH {V.TURNS}, t AS (SELECT chapter, pos, nullif({TAIL_SQL}, '') AS tail FROM turns)
SELECT chapter, pos, coalesce(last_value(tail IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev_tail FROM t""")
def prev_tail(spark, sf_dir):
    """The last two sentences of what came before."""
    return S.previous_tail(V.turns(spark, sf_dir), ["pos"], last_sentences(F.col("text")), ["chapter"]).select("chapter", "pos", "prev_tail")


#: Seven conversations make a job; every third turn of every other chapter has no narration, and some chapters have none at all.
CARRIED_SQL = f"""t AS (SELECT chapter // 7 AS job, chapter, pos, CASE WHEN chapter % 5 <> 0 AND (pos % 3 > 0 OR chapter % 2 = 0) THEN nullif({TAIL_SQL}, '') END AS tail FROM turns)"""


@query(f"""WITH {V.TURNS}, {CARRIED_SQL} SELECT chapter, pos, coalesce(last_value(tail IGNORE NULLS) OVER (PARTITION BY job ORDER BY chapter, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev_tail FROM t""")
def prev_tail_across(spark, sf_dir):
    """The last two sentences of what came before, in the chapter or in those of the job before it."""
    rows = V.turns(spark, sf_dir).withColumn("job", F.floor(F.col("chapter") / 7))
    told = (F.col("chapter") % 5 != 0) & ((F.col("pos") % 3 > 0) | (F.col("chapter") % 2 == 0))
    return S.carried_tail(rows, "job", "chapter", ["pos"], F.when(told, last_sentences(F.col("text")))).select("chapter", "pos", "prev_tail")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, 2 + doc_id % 7 AS n, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, CAST(-1 AS BIGINT) AS part, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS size FROM d
  UNION ALL SELECT doc_id, part + 1, least(len(words), done + size), CASE WHEN part + 2 = n THEN len(words) - least(len(words), done + size) ELSE greatest(1, CAST(round_even((len(words) - least(len(words), done + size)) / (n - part - 1), 0) AS BIGINT)) END FROM f JOIN d USING (doc_id) WHERE part + 1 < n)
SELECT doc_id, part, array_to_string(words[done + 1:done + greatest(0, size)], ' ') AS text FROM f JOIN d USING (doc_id) WHERE part >= 0""")
def word_segments(spark, sf_dir):
    """Texts in as many parts as their length asks for."""
    docs = V.table(spark, sf_dir, "documents")
    n = (2 + F.col("doc_id") % 7).cast("int")
    parts = docs.select("doc_id", F.posexplode(S.word_segments(F.filter(F.split("text", r"\s+"), lambda w: w != ""), n)).alias("part", "text"))
    return parts.select("doc_id", F.col("part").cast("bigint").alias("part"), "text")


#: A fold over each page's boxes in SQL: step i takes the box o numbered i by the order, from the start state on.
FOLD_SQL = """WITH RECURSIVE {boxes}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS i FROM {rows}),
f AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, {start} FROM o UNION ALL SELECT f.page, f.i + 1, {step} FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1)"""
_KEPT = "STRUCT(box BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]"
NESTED_SQL = FOLD_SQL.format(
    boxes=V.BOXES, rows="boxes", order="-w * h, box", start=f"CAST([] AS {_KEPT}) AS kept",
    step=f"""CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(o.x + o.w, k.x + k.w) - greatest(o.x, k.x)) * greatest(0, least(o.y + o.h, k.y + k.h) - greatest(o.y, k.y)) / greatest(1, o.w * o.h) >= 0.55)) > 0 THEN kept
    ELSE list_append(kept, CAST({{'box': o.box, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}} AS STRUCT(box BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT))) END""",
)


@query(NESTED_SQL + ", e AS (SELECT page, unnest(arg_max(kept, i)) AS b FROM f GROUP BY 1) SELECT page, b.box, b.x, b.y, b.w, b.h FROM e")
def suppress_nested(spark, sf_dir):
    """Greedy containment suppression."""
    return S.suppress_nested(V.boxes(spark, sf_dir), "page")


_OVER = "(least(o.y + o.h, r.hi) - greatest(o.y, r.lo)) / nullif(least(o.h, r.hi - r.lo), 0) > 0.4 AND least(o.h, r.hi - r.lo) > 0"
_FIRST = f"coalesce(list_position(list_transform(rows, lambda r: coalesce({_OVER}, false)), true), 0)"
READING_SQL = FOLD_SQL.format(
    boxes=V.BOXES, rows="boxes", order="y, box", start="CAST([] AS STRUCT(lo BIGINT, hi BIGINT)[]) AS rows, CAST(0 AS BIGINT) AS own, CAST(NULL AS BIGINT) AS box, CAST(NULL AS BIGINT) AS x",
    step=f"""CASE WHEN {_FIRST} > 0 THEN list_transform(rows, lambda r, n: CASE WHEN n = {_FIRST.replace('lambda r: coalesce', 'lambda q: coalesce').replace('r.', 'q.')} THEN {{'lo': least(r.lo, o.y), 'hi': greatest(r.hi, o.y + o.h)}} ELSE r END)
    ELSE list_append(rows, CAST({{'lo': o.y, 'hi': o.y + o.h}} AS STRUCT(lo BIGINT, hi BIGINT))) END, CAST(CASE WHEN {_FIRST} > 0 THEN {_FIRST} ELSE len(rows) + 1 END AS BIGINT), o.box, o.x""",
)


@query(READING_SQL + """, e AS (SELECT page, arg_max(rows, i) AS all_rows FROM f GROUP BY 1) SELECT page, box, row_number() OVER (PARTITION BY page ORDER BY all_rows[own].lo, own, x, box) AS place FROM f JOIN e USING (page) WHERE i > 0""")
def reading_order(spark, sf_dir):
    """Boxes in rows by overlap, then from the left."""
    return S.reading_order(V.boxes(spark, sf_dir), "page")


_SAME = "f.n > 0 AND abs(o.y - f.total / greatest(f.n, 1)) <= o.tol"
REGION_SQL = FOLD_SQL.format(
    boxes=V.BOXES, rows="(SELECT *, greatest(avg(h) OVER (PARTITION BY page) * 0.4, 10.0) AS tol FROM boxes)", order="y, box",
    start="CAST(0 AS BIGINT) AS line, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS box, CAST(NULL AS BIGINT) AS x",
    step=f"CASE WHEN {_SAME} THEN f.line ELSE f.line + 1 END, CASE WHEN {_SAME} THEN f.total + o.y ELSE CAST(o.y AS DOUBLE) END, CASE WHEN {_SAME} THEN f.n + 1 ELSE 1 END, o.box, o.x",
)


@query(REGION_SQL + " SELECT page, box, line, row_number() OVER (PARTITION BY page ORDER BY line, x, box) AS place FROM f WHERE i > 0")
def region_order(spark, sf_dir):
    """Text regions in lines around a running mean."""
    return S.region_order(V.boxes(spark, sf_dir), "page")


@query(f"""WITH {V.BOXES}, g AS (SELECT *, y - lag(y) OVER w >= greatest(0.5 * (h + lag(h) OVER w) / 2, 10) AS brk FROM boxes WINDOW w AS (PARTITION BY page ORDER BY y, box)),
l AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, box) AS line FROM g)
SELECT page, CAST(line AS BIGINT) AS line, string_agg('w' || box, ' ' ORDER BY x, box) AS text, count(*) AS n FROM l GROUP BY page, line""")
def line_break_merge(spark, sf_dir):
    """Lines where the gap to the region before is small; words of a line by x."""
    own = W.partitionBy("page").orderBy("y", "box")
    gap, mean = F.col("y") - F.lag("y").over(own), (F.col("h") + F.lag("h").over(own)) / 2
    rows = V.boxes(spark, sf_dir).withColumn("brk", F.coalesce(gap >= F.greatest(0.5 * mean, F.lit(10)), F.lit(False)).cast("bigint"))
    rows = rows.withColumn("line", F.sum("brk").over(own))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "box"))), lambda r: F.concat(F.lit("w"), r["box"].cast("string")))
    return rows.groupBy("page", "line").agg(F.array_join(words, " ").alias("text"), F.count("*").alias("n"))


_SMALL = "f.n > 0 AND o.hi - o.lo < 150 AND f.hi - f.lo < 200"
FRAGMENT_SQL = FOLD_SQL.format(
    boxes=V.BOXES, rows="(SELECT page, e - 3 * h AS lo, e AS hi FROM (SELECT page, h, CAST(sum(3 * h) OVER (PARTITION BY page ORDER BY box) AS BIGINT) AS e FROM boxes))", order="lo, hi",
    start="CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lo, CAST(0 AS BIGINT) AS hi", step=f"CASE WHEN {_SMALL} THEN f.n ELSE f.n + 1 END, CASE WHEN {_SMALL} THEN f.lo ELSE o.lo END, o.hi",
)


@query(FRAGMENT_SQL + " SELECT page, min(lo) AS lo, max(hi) AS hi FROM f WHERE n > 0 GROUP BY page, n")
def merge_fragments(spark, sf_dir):
    """Small neighbouring stretches as one."""
    rows = V.boxes(spark, sf_dir).withColumn("hi", F.sum((F.col("h") * 3).cast("bigint")).over(W.partitionBy("page").orderBy("box")))
    return S.merge_fragments(rows.select("page", (F.col("hi") - F.col("h") * 3).alias("lo"), "hi"), "page")


_APART = "f.last IS NULL OR o.y - f.last >= 20"
SPACED_SQL = FOLD_SQL.format(boxes=V.BOXES, rows="boxes", order="y", start="CAST(NULL AS BIGINT) AS last, false AS kept", step=f"CASE WHEN {_APART} THEN o.y ELSE f.last END, {_APART}")


@query(SPACED_SQL + " SELECT page, last AS y FROM f WHERE kept")
def spaced_cuts(spark, sf_dir):
    """Accepted cuts at a least distance."""
    return S.spaced(V.boxes(spark, sf_dir), "page", "y", 20)


@query(f"""WITH {V.SIGNAL} SELECT page, row // 72 AS band, arg_min(row, (mass, row)) + CASE WHEN arg_min(row, (mass, row)) % 72 < 36 THEN 3 ELSE -3 END AS cut FROM signal GROUP BY 1, 2""")
def argmin_cut(spark, sf_dir):
    """Row of least mass in a band, moved three rows towards the middle."""
    best = F.min_by("row", F.struct("mass", "row"))
    return V.signal(spark, sf_dir).groupBy("page", F.floor(F.col("row") / 72).alias("band")).agg((best + F.when(best % 72 < 36, 3).otherwise(-3)).alias("cut"))


@query(f"""WITH {V.JOBS}, j AS (SELECT job_id, total_chapters AS n, total_images * 7 AS dur FROM jobs WHERE total_chapters > 0), t AS (SELECT job_id, i, CAST(floor(i * dur / n) AS BIGINT) AS s FROM j, LATERAL (SELECT unnest(range(n)) AS i))
SELECT job_id, i, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS stamp FROM t""")
def chapter_timestamps(spark, sf_dir):
    rows = V.jobs(spark, sf_dir).filter("total_chapters > 0").select("job_id", "total_chapters", (F.col("total_images") * 7).alias("dur"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total_chapters") - 1)).alias("i"))
    return rows.select("job_id", "i", clock(F.floor(F.col("i") * F.col("dur") / F.col("total_chapters"))).alias("stamp"))


@query(f"""WITH {V.LOGS} SELECT log_id, (row_number() OVER w - 1) // 20 AS batch, (row_number() OVER w - 1) % 20 AS local FROM logs WINDOW w AS (PARTITION BY job_id ORDER BY ts, log_id)""")
def batch_numbers(spark, sf_dir):
    at = F.row_number().over(W.partitionBy("job_id").orderBy("ts", "log_id")).cast("bigint") - 1
    return V.logs(spark, sf_dir).select("log_id", F.floor(at / 20).alias("batch"), (at % 20).alias("local"))


@query(f"""WITH {V.SIGNAL} SELECT page, greatest(0, min(row) FILTER (mass > 150) - 5) AS top, least(max(row), max(row) FILTER (mass > 150) + 5) AS bottom FROM signal GROUP BY 1""")
def trim_extent(spark, sf_dir):
    busy = F.when(F.col("mass") > 150, F.col("row"))
    return V.signal(spark, sf_dir).groupBy("page").agg(F.greatest(F.lit(0), F.min(busy) - 5).cast("bigint").alias("top"), F.least(F.max("row"), F.max(busy) + 5).cast("bigint").alias("bottom"))


@query(f"""WITH {V.LOGS}, l AS (SELECT job_id, lower(stage) AS item, max(ts) AS last_at, count(*) AS times FROM logs GROUP BY 1, 2)
SELECT job_id, item, last_at, times, row_number() OVER (PARTITION BY job_id ORDER BY last_at DESC, item) AS place FROM l QUALIFY place <= 3""")
def mru_topk(spark, sf_dir):
    """Move-to-front lists: the latest use of each item, newest first, a few kept."""
    items = V.logs(spark, sf_dir).groupBy("job_id", F.lower("stage").alias("item")).agg(F.max("ts").alias("last_at"), F.count("*").alias("times"))
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("last_at"), "item")).cast("bigint")
    return items.withColumn("place", place).filter("place <= 3")


@query(f"""WITH {V.CHAPTERS}, r AS (SELECT job_id, idx, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS a, row_number() OVER (PARTITION BY job_id ORDER BY idx DESC) AS b FROM chapters) SELECT job_id, idx, a <= 2 AS first_two, b <= 2 AS last_two FROM r WHERE a <= 2 OR b <= 2""")
def quick_select(spark, sf_dir):
    own = W.partitionBy("job_id")
    a, b = F.row_number().over(own.orderBy("idx")), F.row_number().over(own.orderBy(F.desc("idx")))
    rows = V.chapters(spark, sf_dir).select("job_id", "idx", (a <= 2).alias("first_two"), (b <= 2).alias("last_two"))
    return rows.filter("first_two or last_two")


STATE_SQL = "states AS (SELECT job_id, stage, (['PENDING', 'RUNNING', 'RETRYABLE', 'COMPLETE', 'RUNNING', 'FAILED'])[log_id % 6 + 1] AS state, ts, log_id, CASE WHEN log_id % 4 = 0 THEN 'p' || log_id % 5 END AS provider FROM logs)"


def changes(spark, sf_dir):
    return V.logs(spark, sf_dir).select(
        "job_id", "stage", V.pick(["PENDING", "RUNNING", "RETRYABLE", "COMPLETE", "RUNNING", "FAILED"], F.col("log_id") % 6).alias("state"), "ts", "log_id",
        F.when(F.col("log_id") % 4 == 0, F.concat(F.lit("p"), (F.col("log_id") % 5).cast("string"))).alias("provider"),
    )


@query(f"""WITH {V.LOGS}, {STATE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id, stage ORDER BY ts DESC, log_id DESC) AS back, count(*) FILTER (state IN ('RUNNING', 'RETRYABLE')) OVER (PARTITION BY job_id, stage) AS attempts FROM states)
SELECT job_id, stage, state, ts, log_id, provider, attempts FROM r WHERE back = 1""")
def attempts_snapshot(spark, sf_dir):
    """Current state rows after full replaces, with their attempts."""
    return T.snapshot(changes(spark, sf_dir), ["job_id", "stage"], ["ts", "log_id"])


@query(f"""WITH {V.LOGS}, s AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY job_id ORDER BY ts), (SELECT max(ts) FROM logs)) AS following FROM logs)
SELECT log_id, job_id, date_diff('microsecond', ts, following) // 1000000 AS gap FROM s WHERE stage = 'view' AND date_diff('microsecond', ts, following) // 1000000 >= 30""")
def stuck_gap(spark, sf_dir):
    logs = V.logs(spark, sf_dir)
    return T.stuck(logs, "job_id", "ts", F.col("stage") == "view", 30, logs.agg(F.max("ts")).scalar()).select("log_id", "job_id", "gap")


@query(f"""WITH {V.LOGS}, s AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts) AS before FROM logs) SELECT log_id, job_id, before, stage FROM s WHERE before <> stage OR (before IS NULL AND stage <> 'view')""")
def transitions(spark, sf_dir):
    return T.transitions(V.logs(spark, sf_dir), "job_id", ["ts"], "stage", quiet="view").select("log_id", "job_id", "before", "stage")
