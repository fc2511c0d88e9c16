"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import free_of, light, small, with_fields

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
BUCKETS = len(ORDERS) << BUCKET_BITS
#: At most about this many labelled documents of each language are used for fitting.
MAX_PER_LANG = 4_000
#: Most languages: the matrix that is broadcast has a column for each (1 MB).
MAX_LANGS = 256
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters of text that one numpy step takes; a longer single text is taken in stretches.
STEP_CHARS = 1 << 18
#: Characters behind the place where the longest n-gram begins.
TAIL = max(ORDERS) - 1


def letters() -> np.ndarray:
    """The small letter of each code point that is a letter or a mark on one (categories L and M), a space for any other: 4.4 MB, made once and
    part of the model."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


def has_letter(text: str) -> bool:
    """Whether a text has a character of category L (a first short look decides for most)."""
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


def grams(parts: list[str], table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram of characters that begins at each place (one array per order; BUCKETS where it begins in a part's last TAIL characters or has no letter),
    and where each part begins. Letters are small, all other characters count as spaces."""
    joined = "".join(parts) + " " * TAIL
    buf = table[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
    at = np.cumsum([0] + [len(t) for t in parts])
    beyond = np.concatenate([at[1:] - k for k in range(1, TAIL + 1)])
    size, out = at[-1], []
    key, blank = np.zeros(size, np.uint32), np.ones(size, bool)
    for i, n in enumerate(ORDERS):
        for j in range(ORDERS[i - 1] if i else 0, n):
            key = key * np.uint32(0x01000193) + buf[j : size + j]
            blank &= buf[j : size + j] == 32
        bucket = (((key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64) + (i << BUCKET_BITS)
        bucket[blank] = BUCKETS
        bucket[beyond] = BUCKETS
        out.append(bucket)
    return out, at[:-1]


def stretches(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Lists of (number of the text, text or a stretch of it) of about STEP_CHARS. A space stands before a text and TAIL ones behind it; a stretch has
    the next TAIL characters of its text behind it, so the n-grams of all stretches are those of the text."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), STEP_CHARS):
            hi = lo + STEP_CHARS
            held.append((i, ("" if lo else " ") + t[lo:hi] + t[hi : hi + TAIL].ljust(TAIL)))
            size += len(held[-1][1])
            if size >= STEP_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = MAX_PER_LANG) -> dict:
    """Log-probabilities by language from rows of docs with a text and a lang; about max_per_lang of each, by a hash of the id
    (copies of one text are thus not drawn together).

    The matrix has one row per language and BUCKETS columns; it is all that reaches the driver.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y")).filter("t is not null and y is not null")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(n) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; the matrix of log-probabilities is made for as many at most")
    if not n:
        return {"langs": [], "log": np.zeros((BUCKETS + 1, 0), np.float32), "prior": np.zeros(0), "letters": letters()}
    limits = F.create_map(*[F.lit(v) for k, c in sorted(n.items()) for v in (k, min(1.0, max_per_lang / c))])
    rows = rows.filter(F.pmod(F.xxhash64(F.lit(13), "i"), F.lit(1_000_000)) / 1_000_000 < limits[F.col("y")]).select("t", "y")

    table = letters()
    shared = light(docs.sparkSession).sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small(batches):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                for part in stretches([texts[i] for i in np.flatnonzero(langs == lang)]):
                    keys = np.concatenate(grams([t for _, t in part], shared.value)[0])
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(keys, minlength=BUCKETS + 1)[:BUCKETS]
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["y", "bucket", "n"])

    sums = rows.mapInArrow(count, "y string, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(n)
    counts = np.zeros((BUCKETS, len(langs)))
    counts[sums["bucket"].to_numpy(int), sums["y"].map(langs.index).to_numpy(int)] = sums["n"].to_numpy()
    counts += SMOOTHING
    log = np.concatenate([np.log(c / c.sum(0)) for c in np.split(counts, len(ORDERS))])
    log = np.concatenate([log, np.zeros((1, len(langs)))])
    prior = np.log(np.array([n[k] for k in langs]) / sum(n.values()))
    return {"langs": langs, "log": log.astype(np.float32), "prior": prior, "letters": table}


def log_scores(texts: list[str], model: dict) -> np.ndarray:
    out = np.tile(model["prior"], (len(texts), 1))
    for part in stretches(texts):
        keys, at = grams([t for _, t in part], model["letters"])
        np.add.at(out, [i for i, _ in part], sum(np.add.reduceat(model["log"][k], at, axis=0, dtype=np.float64) for k in keys))
    return out


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred, 0 to 1).

    Only the text is read. A null text, one without a letter, or a model that learned no language gives `und` with score 0;
    ties go to the language first in order; equal rows get equal answers, whatever their ids, and an empty table gives an empty one. A very
    long text is counted in stretches. Columns of docs with the names of the added ones are replaced.
    """
    docs = free_of(docs, "lang_pred", "score")
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    shared = light(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            model, texts = shared.value, [t or "" for t in batch.column(at).to_pylist()]
            if model["langs"]:
                logs = log_scores(texts, model)
                best = logs.argmax(1)
                p = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                known = [has_letter(t) for t in texts]
                pred = [model["langs"][i] if k else UNKNOWN for i, k in zip(best, known)]
                p = np.where(known, p, 0.0)
            else:
                pred, p = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(p, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs, lang_pred="string", score="double"))
