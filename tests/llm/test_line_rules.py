import re
from collections import Counter

import pytest

from loomframe.llm import line_rules
from loomframe.llm.line_rules import line_frequency_rules


def brute(rows, least=3):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    norm = lambda line: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(" \t\n\x0b\x0c\r").lower()))
    lines = [[x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for _, t, _ in rows]
    seen, hosts = {}, {}
    for (i, t, h), ls in zip(rows, lines):
        hosts.setdefault(h, set()).add((i, t))
        for x in ls:
            seen.setdefault((h, norm(x)), set()).add((i, t))
    out = []
    for (i, t, h), w, ls in zip(rows, words, lines):
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = len({k + j for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for j in range(5)})
        gone = sum(len(x.split()) for x in ls if len(seen[h, norm(x)]) >= least and len(seen[h, norm(x)]) > 0.1 * len(hosts[h]))
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), rep, gone, failed, not failed and gone <= 0.5 * len(w)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu {0} {0}x {0}y"
    rows = [(i, base.format(f"w{i}") + f"\nRead  MORE page {i} here\n", "a") for i in range(6)]
    rows += [(10, "Read more page 7 here\nread more page 1 here\n" * 2 + "two words", "a"), (11, "Read more page 7 here\n" * 3 + "one two three", "b"), (12, None, "a"), (13, "", None), (14, " \n ", None)]
    rows += [(15, "a b c d e f " * 10, "a"), (16, "é# <b> | ß\nx\nx", "c"), (17, "Read more page 9 here\nRead more page 8 here\nsome other words", "a"), (17, "Read more page 9 here\nRead more page 8 here\nsome other words", "a"), (None, "n " * 12, "z"), (18, "w" * 60000 + " tail", "a"), (20, "\x0bleading\x0c and\rtrailing \t", "a")]
    got = line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=3).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept")
    assert sorted((tuple(x[n] for n in names) for x in got), key=str) == brute(rows)
    assert any(not x.kept and not x.base_failed for x in got)


def test_removed_lines_leave_the_text(spark):
    own = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda w{0}"
    rows = [(i, f"Home | Page {i}\n\n {own.format(chr(97 + i))} \nhome |  page 0\r\n", "a", 0) for i in range(6)]
    rows += [(10, "Home | Page 1\n" + own.format("q"), "b", 0), (11, None, "a", 0), (12, "", "a", 0), (13, "Home | Page 3", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {x.doc_id: x for x in line_frequency_rules(docs, min_docs=3).collect()}
    assert all(got[i].kept_text == f"\n {own.format(chr(97 + i))} \n" and got[i].text == rows[i][1] and got[i].n_removed == 8 for i in range(6))
    assert got[10].kept_text == rows[6][1] and got[11].kept_text is None and got[12].kept_text == got[13].kept_text == ""


def test_the_pipeline_hands_on_what_is_left(spark):
    import corpus_pipeline

    own = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda w{0}"
    docs = spark.createDataFrame([(i, f"Home page\n{own.format(chr(97 + i))}", "a", 0) for i in range(12)], "doc_id long, text string, source string, n_chars long")
    out = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert len(out) == 12 and all(x.text == own.format(chr(97 + x.doc_id)) and x.n_chars == len(x.text) for x in out)


def test_odd_tables(spark):
    assert line_frequency_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    odd = spark.createDataFrame([(1, "a b", "s", 3, 4)], "doc_id long, text string, source string, kept int, _lf_k1 int").selectExpr("*", "5 as _LF_R1", "6 as _lf_gone", "7 as _lf_host")
    row = line_frequency_rules(odd).first()
    assert row.kept is False and (row["_lf_k1"], row["_LF_R1"], row["_lf_gone"], row["_lf_host"]) == (4, 5, 6, 7)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_a_line_that_a_third_of_all_rows_have(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_rules, "MAX_BROADCAST", broadcast)
    own = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda w{0}"
    rows = [(i, f"Home | Page {i}\n{own.format(i)}\nsecond {i % 7} line" if i % 3 else own.format(i) + "\nHome | Page 1\n" * 3, "hot" if i % 2 else "other") for i in range(600)]
    got = line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept")
    assert sorted((tuple(x[n] for n in names) for x in got.collect()), key=str) == brute(rows, least=10)
    # Where the lines are not broadcast, the join has the salt among its keys, so the rows of one line go to many tasks.
    assert ("salt" in got._jdf.queryExecution().optimizedPlan().toString()) == (broadcast == 0)
