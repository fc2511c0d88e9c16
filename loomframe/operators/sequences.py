"""Ordered-sequence operators: runs, timelines, continuity, folds over boxes and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.operators.joins import overlapping

MIN_FRAME, HOLD = 3.0, 0.5
#: Places, and then stretches of places, that one fold of a cut's moves takes.
BLOCK = 1 << 14
#: Rows of a page that meet as one bucket in a join by overlap.
BUCKET = 64


def smoothed(rows: DataFrame, key: str, order: str, flag: str, half: int = 2, above: float = 0.6) -> DataFrame:
    """rows with clear: whether the mean of the flag over 2 * half + 1 rows is above a share; edges mirror (without repeating the edge row)."""
    own = Window.partitionBy(key).orderBy(order)
    total, shares = F.count("*").over(Window.partitionBy(key)), F.lit(0.0)
    value = F.col(flag).cast("double")
    at = F.row_number().over(own) - 1
    rows = rows.withColumns({"_at": at, "_n": total})
    for d in range(-half, half + 1):
        # Row i + d, or its mirror image -(i + d), or 2 (n - 1) - (i + d): always within 2 * half rows.
        straight = F.lag(value, -d).over(own) if d else value
        mirror = F.lit(None).cast("double")
        for i in range(half):
            if i + d < 0:
                mirror = F.when(F.col("_at") == i, F.lag(value, i - -(i + d)).over(own)).otherwise(mirror)
            if d - i > 0:
                mirror = F.when(F.col("_n") - 1 - F.col("_at") == i, F.lag(value, d - i - i).over(own)).otherwise(mirror)
        shares = shares + F.coalesce(straight, mirror, F.lit(0.0))
    return rows.withColumn("clear", shares / (2 * half + 1) > above).drop("_at", "_n")


def runs(rows: DataFrame, key: str, order: str, flag: str, least: int) -> DataFrame:
    """Stretches of rows with a set flag, as [lo, hi), of at least so many rows."""
    own = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("_all", F.row_number().over(own))
    kept = numbered.filter(flag).withColumn("_group", F.col("_all") - F.row_number().over(own))
    found = kept.groupBy(key, "_group").agg(F.min(order).alias("lo"), (F.max(order) + 1).alias("hi"))
    return found.filter(F.col("hi") - F.col("lo") >= least).select(key, "lo", "hi")


def cut_points(bands: DataFrame, components: DataFrame, key: str, min_area: int = 40) -> DataFrame:
    """Cut of each band: its middle, moved away from components that reach into it, one after the other.

    bands: key, lo, hi; components: key, y1, y2, area, place. Components move the cut in the order of place. One that
    lowers it takes min(cut, v), one that raises it max(cut, v); any run of them is max(least, min(most, cut)). So
    stretches of BLOCK places are folded apart, then BLOCK of these at a time, and then what is left of a band.
    """
    touch = overlapping(bands, components.filter(F.col("area") >= min_area).select(key, "y1", "y2", "place"), key, BUCKET)
    top, bottom = F.col("y1") - F.col("lo"), F.col("hi") - F.col("y2")
    up = (top > bottom) & (top > 4)
    most = F.when(up, F.col("lo") + F.greatest(F.lit(2), F.floor(top / 2)))
    least = F.when(~up & (bottom > 4), F.col("hi") - F.greatest(F.lit(2), F.floor(bottom / 2)))
    order = F.struct("place", "y1", "y2").alias("_order")
    folded = touch.select(key, "lo", "hi", "place", order, least.cast("bigint").alias("least"), most.cast("bigint").alias("most")).filter("least is not null or most is not null")

    def then(s: Column, c: Column) -> Column:
        # greatest and least pass over nulls, which stand for no bound.
        bounded = F.when(s["least"].isNotNull(), F.least(s["least"], c["most"]))
        return F.struct(F.greatest(bounded, c["least"]).alias("least"), F.least(s["most"], c["most"]).alias("most"))

    none = F.struct(F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("bigint").alias("most"))
    for width in (BLOCK, BLOCK * BLOCK, None):
        block = F.floor(F.col("place") / width) if width else F.lit(0)
        moves = F.array_sort(F.collect_list(F.struct("_order", "least", "most")))
        folded = folded.groupBy(key, "lo", "hi", block.alias("_block")).agg(F.min("place").alias("place"), F.min("_order").alias("_order"), F.aggregate(moves, none, then).alias("_all"))
        folded = folded.select(key, "lo", "hi", "place", "_order", "_all.least", "_all.most")
    start = F.floor((F.col("lo") + F.col("hi")) / 2).cast("bigint")
    return bands.join(folded, [key, "lo", "hi"], "left").select(key, "lo", "hi", F.greatest(F.least(start, F.col("most")), F.col("least")).alias("cut"))


def frame_timeline(frames: DataFrame, segment: list[str], order: str, weight: str, total: Column, floor: float = MIN_FRAME, hold: float = HOLD) -> DataFrame:
    """frames with start and end: the segment's duration shared by weight (evenly if all weigh nothing), but no frame
    shorter than the floor; later frames are pushed out; the last is held a little longer.

    With proportional ends E, end i is floor * i + max(0, max over j <= i of E_j - floor * j).
    """
    own = Window.partitionBy(*segment)
    upto = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    i, n = F.row_number().over(own.orderBy(order)), F.count("*").over(own)
    all_weight = F.sum(weight).over(own)
    share = F.when(all_weight > 0, F.sum(weight).over(upto) / all_weight).otherwise(i / n)
    rows = frames.withColumns({"_i": i, "_n": n}).withColumn("_e", share * total)
    rows = rows.withColumn("_end", floor * F.col("_i") + F.greatest(F.lit(0.0), F.max(F.col("_e") - floor * F.col("_i")).over(upto)))
    start = F.coalesce(F.lag("_end").over(own.orderBy(order)), F.lit(0.0))
    end = F.col("_end") + F.when(F.col("_i") == F.col("_n"), hold).otherwise(0.0)
    return rows.withColumns({"start": F.round(start, 4), "end": F.round(end, 4)}).drop("_i", "_n", "_e", "_end")


def previous_tail(rows: DataFrame, order: list[str], tail: Column, key: list[str]) -> DataFrame:
    """rows with prev_tail: the tail of the last row before that has one, or an empty text."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(tail != "", tail)
    return rows.withColumn("prev_tail", F.coalesce(F.last(own, ignorenulls=True).over(before), F.lit("")))


def carried_tail(rows: DataFrame, job: str, chapter: str, order: list[str], tail: Column) -> DataFrame:
    """rows with prev_tail: the tail of the last row before that has one, in the chapter or in those of the job before it, or an empty text.

    Rows are put in order within chapters only. Of each chapter one row, its last tail, goes on to the job's chapters in order, and comes
    back to the rows in front of which their own chapter has none.
    """
    own = F.when(tail != "", tail)
    inside = Window.partitionBy(job, chapter).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_tail", own)
    last = rows.groupBy(job, chapter).agg(F.max_by("_tail", F.when(F.col("_tail").isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(job).orderBy(chapter).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(job, chapter, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = rows.withColumn("_inside", F.last("_tail", ignorenulls=True).over(inside)).join(carried, [job, chapter], "left")
    return found.withColumn("prev_tail", F.coalesce("_inside", "_carried", F.lit(""))).drop("_tail", "_inside", "_carried")


def word_segments(words: Column, n: Column) -> Column:
    """Words in n texts: each takes a rounded (half to even) even share of the words left, one at least; the last takes the rest."""

    def step(s: Column, k: Column) -> Column:
        left = F.size(words) - s["at"]
        size = F.when(k == n - 1, left).otherwise(F.greatest(F.lit(1), F.bround(left / (n - k)).cast("int")))
        part = F.array_join(F.slice(words, s["at"] + 1, F.greatest(F.lit(0), size)), " ")
        return F.struct(F.least(F.size(words), s["at"] + size).alias("at"), F.concat(s["out"], F.array(part)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["out"]


def stretches(rows: DataFrame, page: str, order: list[str], begins: Column | None = None, reach: Column | None = None, gap: Column | None = None) -> DataFrame:
    """rows with _part: stretches of each page, in the order of its rows, between which no fold looks back.

    A row begins one if begins holds, or if its order column is not below what the rows before reach to (the running maximum of reach),
    and by more than gap if that is given. Rows pass by in order; none are gathered.
    """
    own = Window.partitionBy(page).orderBy(*order)
    if reach is not None:
        far = F.max(reach).over(own.rowsBetween(Window.unboundedPreceding, -1))
        begins = F.col(order[0]) - far > gap if gap is not None else F.col(order[0]) >= far
    first = F.coalesce(begins, F.lit(True)).cast("bigint")
    return rows.withColumn("_part", F.sum(first).over(own.rowsBetween(Window.unboundedPreceding, 0)))


def counted_before(parts: DataFrame, page: str, size: Column) -> Column:
    """For a row for each stretch: the sum of size over the stretches of the page before it."""
    before = Window.partitionBy(page).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0))


def suppress_nested(boxes: DataFrame, page: str, share: float = 0.55) -> DataFrame:
    """Boxes by falling area, without those that lie by so much of their area in one kept before.

    A greedy fold over the boxes of each stretch that no box spans; boxes: page, box, x, y, w, h.
    """
    own = F.struct((-F.col("w") * F.col("h")).alias("order"), F.col("box"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    pages = stretches(boxes, page, ["y", "box"], reach=F.col("y") + F.col("h")).groupBy(page, "_part").agg(F.array_sort(F.collect_list(own)).alias("all"))

    def inside(c: Column, k: Column) -> Column:
        w = F.greatest(F.lit(0), F.least(c["x"] + c["w"], k["x"] + k["w"]) - F.greatest(c["x"], k["x"]))
        h = F.greatest(F.lit(0), F.least(c["y"] + c["h"], k["y"] + k["h"]) - F.greatest(c["y"], k["y"]))
        return w * h / F.greatest(F.lit(1), c["w"] * c["h"]) >= share

    kind = "array<struct<order:bigint,box:bigint,x:bigint,y:bigint,w:bigint,h:bigint>>"
    kept = F.aggregate("all", F.array().cast(kind), lambda kept, c: F.when(F.exists(kept, lambda k: inside(c, k)), kept).otherwise(F.concat(kept, F.array(c))))
    return pages.select(page, F.explode(kept).alias("b")).select(page, "b.box", "b.x", "b.y", "b.w", "b.h")


def reading_order(boxes: DataFrame, page: str, overlap: float = 0.4) -> DataFrame:
    """boxes with place: rows of boxes that overlap in height (the rows' extent grows), from the top, each from the left.

    A fold over the boxes of each stretch that no box spans, by y, then box; a box joins the first row that it overlaps by more
    than the share of the smaller height.
    """
    item = "struct<x:bigint,box:bigint>"
    parts = stretches(boxes, page, ["y", "box"], reach=F.col("y") + F.col("h"))
    pages = parts.groupBy(page, "_part").agg(F.array_sort(F.collect_list(F.struct("y", "box", "x", "h"))).alias("all"))

    def fits(c: Column, r: Column) -> Column:
        least = F.least(c["h"], r["hi"] - r["lo"])
        return (least > 0) & ((F.least(c["y"] + c["h"], r["hi"]) - F.greatest(c["y"], r["lo"])) / F.nullif(least, F.lit(0)) > overlap)

    def step(rows: Column, c: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(rows, lambda r: F.coalesce(fits(c, r), F.lit(False))), True), F.lit(0))
        own = F.struct(c["x"].alias("x"), c["box"].alias("box"))
        grown = F.transform(rows, lambda r, i: F.when(i + 1 == first, F.struct(F.least(r["lo"], c["y"]).alias("lo"), F.greatest(r["hi"], c["y"] + c["h"]).alias("hi"), F.concat(r["items"], F.array(own)).alias("items"))).otherwise(r))
        fresh = F.array(F.struct(c["y"].alias("lo"), (c["y"] + c["h"]).alias("hi"), F.array(own).alias("items")))
        return F.when(first > 0, grown).otherwise(F.concat(rows, fresh))

    rows = F.aggregate("all", F.array().cast(f"array<struct<lo:bigint,hi:bigint,items:array<{item}>>>"), step)
    by_top = F.array_sort(F.transform(rows, lambda r, i: F.struct(r["lo"].alias("lo"), i.alias("i"), r["items"].alias("items"))))
    flat = F.flatten(F.transform(by_top, lambda r: F.array_sort(r["items"])))
    pages = pages.withColumn("_before", counted_before(pages, page, F.size("all")))
    return pages.select(page, "_before", F.posexplode(flat).alias("pos", "b")).select(page, F.col("b.box").alias("box"), (F.col("_before") + F.col("pos") + 1).cast("bigint").alias("place"))


def region_order(regions: DataFrame, page: str) -> DataFrame:
    """regions with line and place: lines gather regions around a running mean of y, within 0.4 of the mean height (10 at least).

    A fold over the regions of each stretch by y, then id; a region further than that below the one before begins a line, whatever
    the mean, and so a stretch. regions: page, box, x, y, h.
    """
    tol = F.greatest(F.avg("h").over(Window.partitionBy(page)) * 0.4, F.lit(10.0))
    parts = stretches(regions.withColumn("_tol", tol), page, ["y", "box"], reach=F.col("y"), gap=F.col("_tol"))
    pages = parts.groupBy(page, "_part").agg(F.array_sort(F.collect_list(F.struct("y", "box", "x", "h"))).alias("all"), F.first("_tol").alias("tol"))
    start = F.struct(F.lit(0).cast("bigint").alias("line"), F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<line:bigint,x:bigint,box:bigint>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        same = (s["n"] > 0) & (F.abs(c["y"] - s["sum"] / F.greatest(s["n"], F.lit(1))) <= F.col("tol"))
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(
            line.alias("line"), F.when(same, s["sum"] + c["y"]).otherwise(c["y"].cast("double")).alias("sum"), F.when(same, s["n"] + 1).otherwise(1).alias("n"),
            F.concat(s["out"], F.array(F.struct(line.alias("line"), c["x"].alias("x"), c["box"].alias("box")))).alias("out"),
        )

    pages = pages.select(page, "_part", F.array_sort(F.aggregate("all", start, step)["out"]).alias("out"))
    lines = F.array_max(F.transform("out", lambda x: x["line"]))
    pages = pages.withColumns({"_lines": counted_before(pages, page, lines), "_before": counted_before(pages, page, F.size("out"))})
    placed = pages.select(page, "_lines", "_before", F.posexplode("out").alias("pos", "b"))
    return placed.select(page, F.col("b.box").alias("box"), (F.col("_lines") + F.col("b.line")).alias("line"), (F.col("_before") + F.col("pos") + 1).cast("bigint").alias("place"))


def merge_fragments(parts: DataFrame, key: str, below: int = 150, into: int = 200) -> DataFrame:
    """Stretches [lo, hi) with small ones merged into the one before while that, as merged so far, is small too.

    One that is not small is merged into none, so a fold begins at each of them.
    """
    cut = stretches(parts, key, ["lo", "hi"], begins=F.col("hi") - F.col("lo") >= below)
    pages = cut.groupBy(key, "_part").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("all"))

    def step(out: Column, c: Column) -> Column:
        last = F.element_at(out, -1)
        small = (c["hi"] - c["lo"] < below) & (last["hi"] - last["lo"] < into)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["lo"].alias("lo"), c["hi"].alias("hi"))))
        return F.when(F.size(out) == 0, F.array(c)).when(small, joined).otherwise(F.concat(out, F.array(c)))

    merged = F.aggregate("all", F.array().cast("array<struct<lo:bigint,hi:bigint>>"), step)
    return pages.select(key, F.explode(merged).alias("p")).select(key, "p.lo", "p.hi")


def spaced(points: DataFrame, key: str, at: str, least: int) -> DataFrame:
    """Points in order, each kept only if far enough from the one kept before.

    One that is so far from the point before is kept, whatever was, so a fold begins there.
    """
    cut = stretches(points.filter(F.col(at).isNotNull()), key, [at], reach=F.col(at) + least)
    pages = cut.groupBy(key, "_part").agg(F.array_sort(F.collect_list(at)).alias("all"))
    step = lambda out, c: F.when((F.size(out) == 0) | (c - F.try_element_at(out, F.lit(-1)) >= least), F.concat(out, F.array(c))).otherwise(out)
    return pages.select(key, F.explode(F.aggregate("all", F.array().cast("array<bigint>"), step)).alias(at))
