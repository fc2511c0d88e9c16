"""The training-data pipeline: rules, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Rows with null ids, null texts, and empty tables pass through as each
operator's docstring defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import jaccard_join, line_rules, mixing, pieces, pii
from loomframe.llm.common import discard, fresh, written


def beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *added: str) -> tuple[DataFrame, dict[str, str]]:
    """What an operator makes of docs, and the names that its columns have there. Columns of docs with such a name go through the operator under another one
    and come back as they were."""
    taken = {n.lower() for n in added}
    own = {c: fresh(docs, f"_own_{c}")[0] for c in docs.columns if c.lower() in taken}
    names = dict(zip(added, fresh(docs, *(f"_stage_{n}" for n in added))))
    out = operator(docs.withColumnsRenamed(own)).withColumnsRenamed(names)
    return out.withColumnsRenamed({hidden: c for c, hidden in own.items()}), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and line-frequency rules keep, without the lines above the limits and with n_chars counted again.

    Null and empty texts go. Rows that repeat an id and a text stay or go together; documents with null ids or sources are like any other.
    Very long texts are rows like any other, ties (equal lines) count alike, and an empty table gives an empty one. All columns of docs,
    whatever their names, are handed on.
    """
    found, at = beside(docs, line_rules.line_frequency_rules, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept", "kept_text")
    found = found.filter(F.col(at["kept"])).withColumn("text", F.col(at["kept_text"]))
    return counted_again(found).select(*docs.columns)


def counted_again(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where they have it, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Documents without an id stay. Of rows that repeat the smallest id, the one with the smallest hash of all its columns stays, in
    whatever order tasks run (equal rows are one). Texts without words are in no group and stay; very long ones are compared whole; an empty table gives an
    empty one. All columns of docs are handed on.
    """
    found, at = beside(docs, jaccard_join.jaccard_components, "n_shingles", "component_id")
    group = F.col(at["component_id"])
    found = found.filter(group.isNull() | (group == F.col("doc_id"))).select(*docs.columns)
    # Ids that several rows have are looked for among ids alone; there are none in most corpora, and then no text moves.
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return found
    digest, best = fresh(docs, "_lf_digest", "_lf_best")
    hashed = written(found.withColumn(digest, F.xxhash64(*docs.columns)))
    several = hashed.join(repeated, "doc_id", "left_semi")
    least = several.groupBy("doc_id").agg(F.min(digest).alias(best))
    one = several.join(least, "doc_id").filter(F.col(digest) == F.col(best)).dropDuplicates(["doc_id"])
    return hashed.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by <KIND> and n_chars counted again; null texts stay null, with null n_chars.

    Equal rows stay equal, spans that begin at one place (ties) are one mark, very long texts are read in stretches, and an empty table gives an empty
    one. Ids are not looked at. All columns of docs are handed on.
    """
    found, _ = beside(docs, lambda d: pii.find(d, pii.train(pii.labelled_table(spark)), mask=True), "pii_spans")
    return counted_again(found).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that bring sources, languages and topics to their target shares of tokens.

    The draw is a hash of the id: rows that repeat an id stay or go together, null ids count as one id. Texts without words stay. Null sources and
    languages are categories of their own; very long texts are rows like any other; an empty table gives an empty one. All columns of docs
    are handed on.
    """
    found, at = beside(docs, mixing.mix_sources, "topic", "n_tokens", "weight", "probability", "sampled")
    return found.filter(F.col(at["sampled"])).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_pieces and piece_ids: the texts as seeded merge-dropout pieces; a null text has null ids and n_pieces 0.

    An empty text has an empty list, equal rows have equal ids, very long texts are taken in stretches, and an empty table gives an empty one.
    Other columns are left out.
    """
    out = pieces.encode(docs.select("doc_id", "source", "lang", "text"), pieces.Coder.load())
    return out.select("doc_id", "source", "lang", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: The field of the third stage is trained numerically and the last stage hashes merges: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
