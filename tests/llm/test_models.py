import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from loomframe.llm import langid, mixing, quality


def corpus(n=240, seed=1):
    r = random.Random(seed)
    words = {"en": ["the", "thing", "with", "and", "other"], "de": ["der", "nicht", "über", "und", "schön"], "fr": ["été", "avec", "le", "nous", "château"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(words))
        w = [r.choice(words[lang]) + r.choice(["", "s", "en"]) for _ in range(r.randrange(20, 60))]
        bad = i % 5 == 0
        rows.append((i, " ".join(f"{x}!! {x}!!" for x in w).upper() if bad else " ".join(w) + ".", lang, 0 if bad else 1))
    return rows


def test_quality_held_out(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, quality int")
    model = quality.train(df.filter("doc_id % 3 <> 0"), df.filter("doc_id % 3 <> 0"))
    out = quality.score(df.filter("doc_id % 3 = 0"), model).collect()
    assert np.mean([x.predicted == x.quality for x in out]) > 0.95 and all(0 <= x.score <= 1 for x in out)
    good, bad = ([x.score for x in out if x.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_pairwise_fit_finds_the_best_order():
    """The Newton steps end where the penalised logistic loss on feature differences has no slope."""
    r = np.random.default_rng(0)
    x = r.normal(size=(400, quality.FEATURES))
    y = (x[:, 0] + 0.3 * r.normal(size=400) > -0.8).astype(int)
    model = quality.fit(x, y, 0.2)
    s = quality.spread(x, model["knots"]) @ model["w"]
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.98
    order = np.argsort(s)
    low = quality.scores(x, model) < quality.SCORE_AT_THRESHOLD
    assert low[order].tolist() == sorted(low.tolist(), reverse=True)
    # Plain gradient descent on the same pairs ends at no lower loss.
    good, bad = x[y == 1], x[y == 0]
    pairs = np.random.default_rng(0).integers(0, len(good), len(bad) * quality.PAIRS_EACH)
    diff = quality.spread(good[pairs], model["knots"]) - quality.spread(np.repeat(bad, quality.PAIRS_EACH, 0), model["knots"])
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + 1e-3 * (w @ w) / 2
    w = np.zeros_like(model["w"])
    for _ in range(4000):
        w += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff) - 1e-3 * w)
    assert loss(model["w"]) <= loss(w) + 1e-3


def test_quality_odd_rows(spark):
    df = spark.createDataFrame(corpus(60), "doc_id long, text string, lang string, quality int")
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a", "z"), (2, "z" * 50000, "q")], "doc_id long, text string, score string")
    for labels in (df, df.filter("quality = 1"), df.limit(0)):
        out = quality.score(odd, quality.train(df, labels)).collect()
        assert len(out) == 4 and all(0 <= x.score <= 1 for x in out)
    assert quality.score(odd.limit(0), quality.train(df, df)).count() == 0


def test_language_held_out(spark):
    df = spark.createDataFrame([r[:3] for r in corpus() if r[3]], "doc_id long, text string, lang string")
    out = langid.predict(df.filter("doc_id % 3 = 1"), langid.train(df.filter("doc_id % 3 <> 1"))).collect()
    assert np.mean([x.lang_pred == x.lang for x in out]) > 0.98


def plain_buckets(text):
    """Buckets of the n-grams of a text, one by one."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in f" {text}   "]
    chars = [c if unicodedata.category(c)[0] in "LM" else " " for c in low]
    for i, n in enumerate(langid.ORDERS):
        for k in range(len(text) + 1):
            gram = chars[k : k + n]
            if any(c != " " for c in gram):
                key = 0
                for c in gram:
                    key = (key * 0x01000193 + ord(c)) % (1 << 32)
                yield ((key ^ key >> 15) * 0x9E3779B1 % (1 << 32) >> 16) + (i << 16)


def test_language_scores_equal_plain_naive_bayes(spark, monkeypatch):
    rows = corpus(40)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = langid.train(df)
    langs = sorted({r[2] for r in rows})
    counts = {y: Counter(b for r in rows if r[2] == y for b in plain_buckets(r[1])) for y in langs}
    texts = [r[1] for r in rows[:7]] + ["", "é", "Ärger ÉTÉ", "漢字 and ½ ²", "x" * 3000]
    got = langid.log_scores(texts, model)
    for i, t in enumerate(texts):
        for j, y in enumerate(langs):
            want = np.log(sum(r[2] == y for r in rows) / len(rows))
            for b in plain_buckets(t):
                own = range(b >> 16 << 16, (b >> 16) + 1 << 16)
                total = sum(v for k, v in counts[y].items() if k in own) + langid.SMOOTHING * len(own)
                want += np.log((counts[y][b] + langid.SMOOTHING) / total)
            assert np.isclose(got[i, j], want, rtol=1e-5)
    monkeypatch.setattr(langid, "STEP_CHARS", 50)
    assert np.allclose(langid.log_scores(texts[7:11], model), got[7:11])
    assert langid.predict(df, model).count() == 40


def test_only_letters_make_a_language(spark):
    df = spark.createDataFrame([r[:3] for r in corpus(40)], "doc_id long, text string, lang string")
    odd = [(1, "²½ 12"), (2, "_ __"), (3, "9é"), (4, "9" * 300 + "ß"), (4, "9" * 300 + "ß")]
    out = langid.predict(spark.createDataFrame(odd, "lang_pred long, text string"), langid.train(df)).collect()
    assert [x.lang_pred == "und" for x in out] == [True, True, False, False, False] and out[3] == out[4]
    assert langid.predict(df.limit(0), langid.train(df)).count() == 0


def test_language_odd_rows(spark):
    df = spark.createDataFrame([r[:3] for r in corpus(40)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 !?", "en"), (None, "nicht über", None)], "doc_id long, text string, lang string")
    out = langid.predict(odd, langid.train(df.union(odd))).collect()
    assert [x.lang_pred for x in out] == ["und", "und", "und", "de"] and all(0 <= x.score <= 1 for x in out)
    assert {x.lang_pred for x in langid.predict(odd, langid.train(df.limit(0))).collect()} == {"und"}


def test_raking_meets_the_marginals(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(1, 200)) + r.choice(["", " | x", " a@b"]), r.choice("abc"), r.choice(["en", "fr", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells = df.groupBy("source", "lang").agg(mixing.F.sum(mixing.n_tokens(mixing.F.col("text"))).alias("tokens")).na.fill("(none)")
    targets = {c: mixing.tempered(cells, c) for c in ("source", "lang")}
    raked = mixing.rake(cells, targets).collect()
    total = sum(x.mass for x in raked)
    assert abs(total - 1) < 1e-6
    for c, t in targets.items():
        for x in t.collect():
            assert abs(sum(y.mass for y in raked if y[c] == x[c]) - x.share) < 1e-6
    assert mixing.residual(mixing.rake(cells, targets), targets) < 1e-6 < mixing.residual(cells.withColumn("mass", mixing.F.col("tokens")), targets)
    out = mixing.mix_sources(df).collect()
    assert len(out) == 600 and abs(sum(x.n_tokens * x.probability for x in out) / sum(x.n_tokens for x in out) - 0.9) < 0.01
    assert abs(sum(x.n_tokens for x in out if x.sampled) / sum(x.n_tokens for x in out) - 0.9) < 0.06


def test_mixing_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, 7), (None, "", "a", "en", 8), (2, "x y", "a", "en", 9), (2, "x y", "a", "en", 9)], "doc_id long, text string, source string, lang string, weight int")
    out = mixing.mix_sources(odd, budget=1.0).collect()
    assert len(out) == 4 and all(x.sampled for x in out) and [x.n_tokens for x in out if x.doc_id == 2] == [2, 2]
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    named = odd.selectExpr("*", "1 as _p", "2 as _lf_p", "3 as _lf_source", "4 as _s", "5 as _LF_W")
    assert [x[5:10] for x in mixing.mix_sources(named).select("doc_id", "text", "source", "lang", "text", "_p", "_lf_p", "_lf_source", "_s", "_LF_W").collect()] == [(1, 2, 3, 4, 5)] * 4


def test_mixing_to_given_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(20, 60)), r.choice("aaab"), r.choice(["en", "fr"]), r.choice(["x", "y", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    langs = spark.createDataFrame([("en", 3.0), ("fr", 1.0), ("never", 5.0), ("null", None)], "lang string, share double")
    out = mixing.mix_sources(df, topic_col="subject", targets={"source": {"a": 0.5, "b": 0.5}, "lang": langs, "topic": {"x": 1, "y": 1, "(none)": 2}}, budget=0.3, strict=True).collect()
    total = sum(x.n_tokens * x.weight for x in out)
    share = lambda f: sum(x.n_tokens * x.weight for x in out if f(x)) / total
    assert abs(share(lambda x: x.source == "a") - 0.5) < 0.01 and abs(share(lambda x: x.lang == "en") - 0.75) < 0.01
    assert abs(share(lambda x: x.subject is None) - 0.5) < 0.01 and {x.topic for x in out} == {"x", "y", "(none)"}
    assert abs(sum(x.n_tokens * x.probability for x in out) / sum(x.n_tokens for x in out) - 0.3) < 0.01
    with pytest.raises(ValueError):
        mixing.mix_sources(df, targets={"colour": {"red": 1}})
    apart = df.filter("source = 'a' and lang = 'en' or source = 'b' and lang = 'fr'")
    with pytest.raises(ValueError):  # the two margins are one, so they cannot have two targets
        mixing.mix_sources(apart, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}}, strict=True)
    with pytest.warns(UserWarning, match="not converged"):
        assert mixing.mix_sources(apart, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}}).count() == apart.count()


def test_measures_of_long_texts_in_stretches(monkeypatch):
    from loomframe.llm import common, quality

    texts = [b"Some words, and some more.\nsome words again 12 #* " * 60, b"", b"x", b"A b. " * 500, "\u00e9t\u00e9 ".encode() * 99]
    want = quality.features(texts)
    for step in (16, 100):
        monkeypatch.setattr(common, "STEP_BYTES", step)
        monkeypatch.setattr(quality, "STEP_BYTES", step)
        assert np.allclose(quality.features(texts), want)


def test_measures_one_by_one():
    from loomframe.llm import quality

    text = "Ab c1, c1!\nAb c1, c1!\nzz #"
    (row,) = quality.features([text.encode()])
    words, lines = text.split(), text.split("\n")
    n, size = len(words), len(text)
    # A character in two classes (a capital vowel) counts in the later one.
    of = lambda c: max((i for i, members in enumerate(quality.CLASSES) if c in members.decode()), default=None)
    shares = [sum(of(c) == i for c in text) / size for i in range(len(quality.CLASSES))]
    assert np.allclose(row[:9], shares) and row[9] == 0
    pairs = list(zip(words, words[1:]))
    rest = [np.log1p(n), (size - text.count("\n") - n) / n, sum(a == b for a, b in pairs) / n, len(set(words)) / n, len(set(pairs)) / (n - 1), len(set(lines)) / len(lines), np.log1p(size / len(lines)), sum(c in ".,!?" for c in text) / n]
    assert np.allclose(row[10:], rest)
