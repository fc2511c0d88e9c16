"""Cross-document line frequency: lines of too many documents of a host do not count, and depleted documents go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import free_of, fresh, row_key, written

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of its host if at least MIN_DOCS documents of the host, and more than MAX_SHARE of them, have it.
MIN_DOCS = 10
MAX_SHARE = 0.1
#: A document is depleted if more than this share of its words is in boilerplate lines.
MAX_REMOVED = 0.5
NGRAM = 5
#: Lines above the limits (two numbers each) that are broadcast at most, and parts into which the rows of one are dealt out where there are more.
MAX_BROADCAST, SALTS = 200_000, 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def repeated_words(words: Column) -> Column:
    """Words covered by NGRAM-word windows that the text has twice or more (windows as 64-bit hashes)."""

    def covered(keys: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            at = lambda i: F.get(s, i)["k"]
            twice = F.filter(F.transform(s, lambda x, i: F.when((x["k"] == at(i - 1)) | (x["k"] == at(i + 1)), x["i"])), lambda p: p.isNotNull())
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda a, p: F.struct((a["n"] + p + NGRAM - F.greatest(p, a["end"])).alias("n"), (p + NGRAM).alias("end"))
            return F.aggregate(F.array_sort(twice), start, step)["n"]

        pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(let(F.sort_array(pairs), of_sorted))

    def of_hashes(h: Column) -> Column:
        # Hashes of 2, then 4, then 5 words from neighbouring ones: fewer steps than from all five at each place.
        n = F.size(h)
        pair = lambda a, b: F.xxhash64(a, b)
        twos = F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), pair)
        fours = let(twos, lambda t: F.zip_with(F.slice(t, F.lit(1), n - 3), F.slice(t, F.lit(3), n - 3), pair))
        fives = F.zip_with(F.slice(fours, F.lit(1), n - 4), F.slice(h, F.lit(5), n - 4), pair)
        return let(fives, covered)

    return F.when(F.size(words) < NGRAM, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def line_frequency_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed, base_failed, kept and kept_text.

    A line is what stands between newlines, lower-cased, with white space runs as one space and digit runs as 0; lines
    without a word do not count. Its frequency is the number of documents of its host that have it, once or oftener; rows that repeat an id and
    a text are one document. n_removed is the number of words in lines above both limits; kept is false if
    base_failed, or if n_removed is more than max_removed of the words. kept_text is the text without the lines above both
    limits, its other lines (those without a word too) as they are; all other columns are of the whole text. A null or empty text has zeros, fails the base rule
    and is not kept, and its kept_text is itself; null hosts are one host; equal rows get equal verdicts. Columns of docs with the names of the
    added ones are replaced. An empty table gives an empty one, and a very long text is a row like any other. Only DataFrame functions are used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept", "kept_text"]
    docs = free_of(docs, *added)
    k1, k2, host, r1, r2, gone, removed_, counted = fresh(docs, "_lf_k1", "_lf_k2", "_lf_host", "_lf_r1", "_lf_r2", "_lf_gone", "_lf_removed", "_lf_words")
    bare = lambda c: F.translate(c, WHITE, "")
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(row_key(F.col(id_col), F.col(text_col)), (k1, k2))), F.xxhash64(host_col).alias(host))
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) != "")

    # Places are among all lines of the text.
    names = (F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(host).alias("host"))
    rows = keyed.select(*names, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(bare(F.col("line")) != "")
    rows = rows.withColumn("line", F.regexp_replace(F.regexp_replace(F.lower(F.btrim("line", F.lit(WHITE))), WHITE_RUN, " "), "[0-9]+", "0"))
    # Words stand between single spaces now.
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" ")))
    rows = rows.select("k1", "k2", "host", "pos", F.xxhash64("line").alias("line"), (spaces + 1).alias("n"))
    hosts = keyed.groupBy(F.col(host).alias("host")).agg(F.count_distinct(k1).alias("docs"))
    common = rows.groupBy("host", "line").agg(F.count_distinct("k1").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    common = written(common.join(hosts, "host").filter(F.col("n_docs") > max_share * F.col("docs")).select("host", "line"))
    # A line above the limits is a hot key by definition. As long as they are few they are broadcast, and no row moves; beyond that
    # their rows go by a part of their document's hash too, and meet one of SALTS copies of the line.
    if common.count() <= MAX_BROADCAST:
        removed = rows.join(F.broadcast(common), ["host", "line"])
    else:
        copies = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        removed = rows.withColumn("salt", F.pmod("k1", F.lit(SALTS).cast("long"))).join(copies, ["host", "line", "salt"])
    # A set of (place, words): equal rows add the same members, so nothing is counted twice.
    removed = removed.groupBy(F.col("k1").alias(r1), F.col("k2").alias(r2)).agg(F.collect_set(F.struct("pos", "n")).alias("set"))
    removed = removed.select(r1, r2, F.aggregate("set", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias(removed_), F.transform("set", lambda x: x["pos"]).alias(gone))

    words = words_of(F.col(text_col))
    base = keyed.select(
        "*",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias(counted),
        F.length(bare(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    base = base.withColumns({"n_words": F.col(counted)["n"], "n_repeat_words": F.col(counted)["r"]})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = base.join(removed, (F.col(k1) == F.col(r1)) & (F.col(k2) == F.col(r2)), "left")
    out = out.withColumns({"n_removed": F.coalesce(removed_, F.lit(0).cast("long")), "base_failed": failed})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed") <= max_removed * F.col("n_words")))
    # The stretches of lines between removed places.
    places = F.array_sort(gone)
    between = lambda x, p: F.zip_with(F.concat(F.array(F.lit(-1)), p), F.concat(p, F.array(F.size(x))), lambda a, b: F.slice(x, a + 2, b - a - 1))
    left = let(F.split(text, "\n"), lambda x: F.array_join(F.flatten(let(places, lambda p: between(x, p))), "\n"))
    out = out.withColumn("kept_text", F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left))
    return out.select(*docs.columns, *added)
