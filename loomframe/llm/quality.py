"""Bradley-Terry quality scores: document scores learned from preference pairs, thresholded by quantile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import STEP_BYTES, Hasher, as_bytes, free_of, light, small, steps, with_fields

#: At most about this many labelled documents of each label are used for fitting.
MAX_PER_LABEL = 8_000
#: Preference pairs made from them: each document of the rarer label meets so many of the other.
PAIRS_EACH = 12
KNOTS = 6
#: Score of the document at the threshold quantile.
SCORE_AT_THRESHOLD = 0.3
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"#*$%&|<>{}[]\\/^~=+_", b"\n", b"aeiouAEIOU", b"'\"-:;()@"]
FEATURES = 10 + 8


def features(texts: list[bytes]) -> np.ndarray:
    """One row of text measures per text: shares of character classes, and repetition of words, word pairs and lines."""
    hasher, rows = Hasher(), []
    kind = np.full(256, len(CLASSES), np.int64)
    kind[128:] = len(CLASSES) + 1
    for i, members in enumerate(CLASSES):
        kind[list(members)] = i
    for a, b in steps(texts):
        part = texts[a:b]
        (h,), bounds = hasher.words(part)
        n_words = np.diff(bounds)
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        length = np.array([len(t) for t in part])
        ends, k = np.cumsum(length + 1), len(CLASSES) + 2
        counts = np.zeros((len(part), k))
        for lo in range(0, len(buf), STEP_BYTES):  # a long text in stretches
            hi = min(lo + STEP_BYTES, len(buf))
            doc = np.repeat(np.arange(len(part)), ends.clip(lo, hi) - (ends - length - 1).clip(lo, hi))
            counts += np.bincount(doc * k + kind[buf[lo:hi]], minlength=len(part) * k).reshape(len(part), -1)
        counts[:, 6] -= 1  # the newline that joins the texts
        size, words = np.maximum(length, 1), np.maximum(n_words, 1)
        owner = np.repeat(np.arange(len(part), dtype=np.int32), n_words)

        def distinct(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
            if len(part) == 1:
                return np.array([len(np.unique(keys))])
            order = np.lexsort((keys, own))
            new = np.ones(len(order), bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (own[order][1:] != own[order][:-1])
            return np.bincount(own[order][new], minlength=len(part))

        again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=len(part)) if len(h) else np.zeros(len(part))
        pairs = hasher.windows([h], 2)[0]
        inside = owner[: len(pairs)] == owner[1:] if len(h) > 1 else np.zeros(0, bool)
        n_pairs = np.maximum(n_words - 1, 1)
        lines = [t.split(b"\n") for t in part]
        columns = [counts[:, i] / size for i in [*range(len(CLASSES)), len(CLASSES) + 1]]
        columns += [
            np.log1p(n_words), (size - counts[:, 6] - n_words) / words, again / words, distinct(h, owner) / words,
            distinct(pairs[inside], owner[: len(pairs)][inside]) / n_pairs, np.array([len(set(x)) / len(x) for x in lines]),
            np.log1p(length / np.array([len(x) for x in lines])), counts[:, 2:5].sum(1) / words,
        ]
        rows.append(np.stack(columns, 1))
    return np.concatenate(rows) if rows else np.zeros((0, FEATURES))


def spread(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Piecewise linear functions of each feature: its position between neighbouring knots, from 0 to 1."""
    low, high = knots[:-1], knots[1:]
    return np.concatenate([np.clip((x - lo) / np.where(hi > lo, hi - lo, 1), 0, 1) * (hi > lo) for lo, hi in zip(low, high)], 1)


def fit(x: np.ndarray, y: np.ndarray, share_low: float) -> dict:
    """Weights of the Bradley-Terry model P(i preferred to j) = 1 / (1 + exp(s_j - s_i)), by Newton steps."""
    good, bad = x[y == 1], x[y == 0]
    knots = np.quantile(np.concatenate([good, bad]) if len(x) else np.zeros((1, FEATURES)), np.linspace(0, 1, KNOTS), axis=0)
    extremes = np.quantile(bad, [0.05, 0.5, 0.95], axis=0) if len(bad) else knots[:1]
    knots = np.sort(np.concatenate([knots, extremes]), axis=0)
    w = np.zeros(FEATURES * (len(knots) - 1))
    if len(good) and len(bad):
        rng = np.random.default_rng(0)
        rare, other = (bad, good) if len(bad) <= len(good) else (good, bad)
        i, j = np.repeat(np.arange(len(rare)), PAIRS_EACH), rng.integers(0, len(other), len(rare) * PAIRS_EACH)
        diff = (spread(other[j], knots) - spread(rare[i], knots)) * (1 if rare is bad else -1)
        for _ in range(12):
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance of the wrong order
            gradient = diff.T @ p - 1e-2 * len(diff) * w / 10
            hessian = (diff * (p * (1 - p))[:, None]).T @ diff + 1e-3 * len(diff) * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        raw = np.concatenate([spread(bad, knots) @ w, spread(good, knots) @ w])
        weight = np.concatenate([np.full(len(bad), share_low / len(bad)), np.full(len(good), (1 - share_low) / len(good))])
        order = np.argsort(raw, kind="stable")
        at = raw[order][min(np.searchsorted(np.cumsum(weight[order]), share_low), len(raw) - 1)]
    else:
        at = np.log(SCORE_AT_THRESHOLD / (1 - SCORE_AT_THRESHOLD)) * (1 if len(bad) and not len(good) else -1) * -1
    return {"w": w, "knots": knots, "at": float(at)}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    z = spread(x, model["knots"]) @ model["w"] - model["at"] + np.log(SCORE_AT_THRESHOLD / (1 - SCORE_AT_THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_per_label: int = MAX_PER_LABEL) -> dict:
    """A model from the labelled documents; of each label about max_per_label are taken, by a hash of the id."""
    ids = labels.select(F.col(id_col).alias("_lf_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and _lf_id is not null")
    n = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(11), "_lf_id"), F.lit(1_000_000)) / 1_000_000
    take = F.when(F.col("y") == 1, max_per_label / max(1, n.get(1, 0))).otherwise(max_per_label / max(1, n.get(0, 0)))
    # Broadcast: about 2 * max_per_label ids and marks, so the texts stay where they are.
    rows = F.broadcast(ids.filter(draw < take)).join(docs.select(F.col(id_col).alias("_lf_id"), F.col(text_col).alias("t")), "_lf_id").select("y", "t")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = features(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    # Bounded: about 2 * max_per_label rows of FEATURES numbers, sorted so that a rerun fits the same model.
    found = sorted(((r["y"], tuple(r["x"])) for r in rows.mapInArrow(measured, "y int, x array<double>").collect()), reverse=True)
    x = np.array([f[1] for f in found]).reshape(-1, FEATURES)
    return fit(x, np.array([f[0] for f in found]), n.get(0, 0) / max(1, sum(n.values())))


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from SCORE_AT_THRESHOLD on).

    Only the text is read. A null text counts as empty; an empty text has all measures 0 and a score like any other. Equal
    texts get equal scores, whatever their ids, and an empty table gives an empty one; a very long text is measured whole, its characters in stretches. Columns of docs with the names of the added ones are replaced. Without labels of both
    kinds the model ranks nothing: every document then gets the same score.
    """
    docs = free_of(docs, "score", "predicted")
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    shared = light(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            s = scores(features(as_bytes(batch.column(at))), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= SCORE_AT_THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, with_fields(docs, score="double", predicted="int"))


def crc_rest(column: Column, divisor: int) -> Column:
    """crc32 of a value as text, modulo a divisor; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor
