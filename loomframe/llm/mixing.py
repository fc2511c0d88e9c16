"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import discard, free_of, fresh, written

WHITE = " \t\n\x0b\x0c\r"
#: Raking rounds at least (one round fits every marginal once), how many more at a time while a marginal is too far off, and in all.
ROUNDS, MORE_ROUNDS, MOST_ROUNDS = 8, 4, 48
#: Target share of a category: its natural share to this power, rescaled (1 keeps the mix, 0 makes it even).
TEMPER = 0.7
#: Share of all tokens to sample.
BUDGET = 0.9
#: A larger relative distance of a marginal from its target is reported.
MAX_RESIDUAL = 0.01
MARGINS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by rule: tables, contacts, licences, short notes or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("@") | t.contains("+"), "contact")
        .when(t.contains("icensed under") | t.contains("All rights reserved"), "licence")
        .when(F.length(t) < 500, "note")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, column: str, power: float = TEMPER) -> DataFrame:
    """Target shares of the categories of a column: natural token shares to a power, rescaled to sum to 1."""
    totals = cells.groupBy(column).agg(F.sum("tokens").alias("t")).filter("t > 0")
    powers = totals.select(column, F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    every = powers.agg(F.sum("p")).first()[0] or 1.0  # one number
    return powers.select(column, (F.col("p") / F.lit(every)).alias("share"))


def given(spark: SparkSession, cells: DataFrame, column: str, target: DataFrame | dict) -> DataFrame:
    """Target shares of a column's categories from a table (the column, share) or a dict, of those that have tokens, rescaled to sum to 1.

    The categories of a dict are compared as text. Categories without a target, or with one that is null or not above 0, get no mass.
    """
    table = target if isinstance(target, DataFrame) else spark.createDataFrame([(str(k), float(v)) for k, v in target.items()], f"{column} string, share double")
    table = table.select(F.col(column).cast("string").alias(column), F.col("share").cast("double").alias("share")).filter("share > 0")
    table = table.join(cells.select(column).distinct(), column)
    every = table.agg(F.sum("share")).first()[0] or 1.0
    return table.select(column, (F.col("share") / F.lit(every)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells (the margin columns and tokens; mass too, to go on from it) with mass: tokens scaled so that every marginal has its target share.

    A category without a target gets no mass. Sums by category are grouped before they are joined back, so one large
    category is no single task. Each step is written, since its plan holds the one before twice, and the one before goes.
    """
    now, last = cells if "mass" in cells.columns else cells.withColumn("mass", F.col("tokens").cast("double")), None
    names = [c for c in cells.columns if c != "mass"]
    for column, target in [*targets.items()] * rounds:
        sums = now.groupBy(column).agg(F.sum("mass").alias("_have"))
        factor = sums.join(target, column, "left").select(F.col(column).alias("_c"), F.coalesce(F.try_divide("share", "_have"), F.lit(0.0)).alias("_f"))
        now = written(now.join(factor, F.col(column).eqNullSafe(F.col("_c"))).select(*names, (F.col("mass") * F.col("_f")).alias("mass")))
        if last is not None:
            discard(last)
        last = now
    return now


def residual(mass: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest relative distance of a category's share of the mass from its target, over all marginals (0 for no cells)."""
    far, total = None, mass.agg(F.sum("mass")).first()[0] or 1.0
    for column, target in targets.items():
        have = mass.groupBy(column).agg(F.sum("mass").alias("have")).join(target, column)
        have = have.select(F.abs(F.col("have") / F.lit(total) / F.col("share") - 1).alias("far"))
        far = have if far is None else far.union(have)
    return float(far.agg(F.max("far")).first()[0] or 0.0)


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, strict: bool = False) -> DataFrame:
    """rake(), with more rounds while a marginal is more than MAX_RESIDUAL off and they bring it nearer.

    Targets that contradict each other, or ask for what no cell has, cannot be met: that is a warning, or an error if strict.
    """
    mass, done = rake(cells, targets, rounds), rounds
    far = residual(mass, targets)
    while far > MAX_RESIDUAL and done < MOST_ROUNDS:
        before, last = far, mass
        mass, done = rake(mass.select(*cells.columns, "mass"), targets, MORE_ROUNDS), done + MORE_ROUNDS
        discard(last)
        far = residual(mass, targets)
        if far > 0.9 * before:
            break
    if far > MAX_RESIDUAL:
        said = f"raking has not converged: a marginal is off by {far:.1%}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=3)
    return mass


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, DataFrame | dict] | None = None, temper: float = TEMPER, budget: float = BUDGET, rounds: int = ROUNDS, strict: bool = False) -> DataFrame:
    """docs with topic, n_tokens, weight, probability and sampled.

    Tokens of the (source, lang, topic) cells are raked to target marginals: those of targets, by margin (source, lang, topic), as tables or
    dicts of shares; a margin that it leaves out has its natural shares to the power temper. The topic is that of topic_col, or else one by rule
    (topic_of). strict makes targets that cannot be met an error. A cell's weight is its target mass over its
    natural mass; its documents are kept with probability min(1, c * weight), c being such that the budgeted share of
    tokens is expected; each document's draw is a hash of its id, so equal ids are drawn alike. Null source or lang
    is a category like any other, as '(none)'; texts without words have weight 1 and are kept, since they weigh nothing. A very long text is a
    row like any other. An empty table gives an empty one. Columns of docs with the names of the added ones are replaced. Only DataFrame
    functions are used.
    """
    added = ["topic", "n_tokens", "weight", "probability", "sampled"]
    keep = fresh(docs, "_lf_topic")[0]
    topic = topic_of(F.col(text_col)) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit("(none)"))
    docs = free_of(docs.withColumn(keep, topic), *added)
    if unknown := set(targets or {}) - set(MARGINS):
        raise ValueError(f"no margin: {', '.join(sorted(unknown))}")
    source, lang, s, l, t, w, p = fresh(docs, "_lf_source", "_lf_lang", "_lf_s", "_lf_l", "_lf_t", "_lf_w", "_lf_p")  # noqa: E741
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    rows = docs.withColumns({"topic": F.col(keep), "n_tokens": n_tokens(F.col(text_col)), source: named(source_col), lang: named(lang_col)})
    keys = {source: "source", lang: "lang", "topic": "topic"}
    cells = written(rows.groupBy(*[F.col(k).alias(v) for k, v in keys.items()]).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    targets = {c: written(given(docs.sparkSession, cells, c, targets[c]) if targets and c in targets else tempered(cells, c, temper)) for c in MARGINS}
    mass = raked(cells, targets, rounds, strict)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    weights = written(mass.select(*MARGINS, "tokens", (F.col("mass") * F.lit(total) / F.col("tokens")).alias("weight")))

    # c from the breakpoints 1 / weight: below it a cell gives c * weight of its tokens, from it on all of them.
    at = weights.groupBy(F.round("weight", 9).alias("weight")).agg(F.sum("tokens").alias("tokens")).filter("weight > 0")
    scale = calibrated(at, budget * total)
    picked = weights.select(F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t), F.col("weight").alias(w), F.least(F.lit(1.0), F.lit(scale) * F.col("weight")).alias(p))
    out = rows.join(picked, (F.col(source) == F.col(s)) & (F.col(lang) == F.col(l)) & (F.col("topic") == F.col(t)), "left")
    empty = F.col("n_tokens") == 0
    out = out.withColumns({"weight": F.when(empty, 1.0).otherwise(F.coalesce(w, F.lit(0.0))), "probability": F.when(empty, 1.0).otherwise(F.coalesce(p, F.lit(0.0)))})
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return out.withColumn("sampled", draw < F.col("probability")).select(*[c for c in docs.columns if c != keep], *added)


def calibrated(at: DataFrame, wanted: float, rounds: int = 40) -> float:
    """The number c at which sampling with min(1, c * weight) gives the wanted tokens, by halving an interval.

    at: weight, tokens. Weights within a bin differ by less than one part in a thousand, and the bins' sums stand for them:
    one array of (weight, tokens), folded over in one row.
    """
    bins = at.groupBy(F.floor(F.log("weight") * 1000).alias("bin")).agg((F.sum(F.col("weight") * F.col("tokens")) / F.sum("tokens")).alias("w"), F.sum("tokens").cast("double").alias("n"))
    arrays = bins.agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("cells"))
    given = lambda c: F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["n"] * F.least(F.lit(1.0), c * x["w"]))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = given(mid) < wanted
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    top = F.coalesce(F.lit(1.0) / F.array_min(F.transform("cells", lambda x: x["w"])), F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("lo"), top.alias("hi"))
    return float(arrays.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["hi"].alias("c")).first()["c"])
