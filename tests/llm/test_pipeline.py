import numpy as np

import corpus_pipeline
from loomframe.llm import pieces, pii, registry
from tests.llm.test_jaccard_join import brute as jaccard_brute
from tests.llm.test_line_rules import brute as line_brute


def test_stages_take_odd_documents(spark):
    good = "Eren onda the {0} kesto arime duvel sonta pirel {0}x mavor tenis lorum {0}y gadel"
    rows = [(i, good.format(f"w{i}"), "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(20, good.format("w1") + " call +1 (212) 555-0187", "en", "s0", 1), (21, good.format("w1"), "en", "s0", 1), (22, None, "en", "s0", None), (23, "", None, None, 0), (None, good.format("q9"), None, None, 5), (24, "a b " * 20, "en", "s1", 1), (25, good.format("mail") + " a.b@c.org", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        if i < 4:
            assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = {x.doc_id for x in docs.collect()}
        if name == "quality_rules":
            assert ids == {*range(12), 20, 21, 25, None}
        if name == "near_duplicates":
            assert ids == {*range(12), 20, 25, None}
        if name == "personal_data":
            text = {x.doc_id: x.text for x in docs.collect()}
            assert text[25].endswith("<EMAIL>") and text[20].endswith("<PHONE>") and text[3] == good.format("w3")
            assert all(x.n_chars == len(x.text) for x in docs.collect())
    assert docs.columns == ["doc_id", "source", "lang", "n_pieces", "piece_ids"] and all(x.n_pieces == len(x.piece_ids) for x in docs.collect())


def test_stages_equal_plain_versions(spark):
    """Each stage on what the one before kept, over whole documents, against plain loops; every document's pieces decode to its text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = docs.filter("doc_id = 3").selectExpr("doc_id + 100000 as doc_id", "concat(repeat(concat(text, ' '), 200), 'end') as text", "lang", "source", "n_chars")
    docs = docs.union(long).union(docs.filter("doc_id < 20"))
    stage = dict(corpus_pipeline.STAGES)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)

    kept = keep(stage["quality_rules"](spark, docs, ""))
    rows = [(x.doc_id, x.text, x.source) for x in docs.collect()]
    # Rows that repeat an id and a text count once in the brute version too, as sets.
    verdict = {x[0]: x[-1] for x in line_brute(rows, least=10)}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, *_ in rows if verdict[i])

    apart = keep(stage["near_duplicates"](spark, kept, ""))
    component = {i: c for i, _, c in jaccard_brute([(x.doc_id, x.text) for x in kept.collect()])}
    assert sorted(x.doc_id for x in apart.collect()) == sorted({i for i, c in component.items() if i == c})

    clean = keep(stage["personal_data"](spark, apart, ""))
    tagger = pii.Tagger(pii.train(pii.labelled_table(spark)))
    text = {x.doc_id: x.text for x in clean.collect()}
    assert len(text) == apart.count()
    for x in apart.collect():
        base = pii.emails(x.text) + pii.ips(x.text) + pii.cards(x.text) + pii.phones(x.text)
        (more,) = pii.added_spans([x.text], [base], tagger)
        assert text[x.doc_id] == pii.masked(x.text, sorted(base + more, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1])))

    mixed = keep(stage["mixture"](spark, clean, ""))
    words = lambda rows: sum(len((x.text or "").split()) for x in rows)
    assert {x.doc_id for x in mixed.collect()} <= set(text) and 0.8 < words(mixed.collect()) / words(clean.collect()) < 0.97

    coder = pieces.Coder.load()
    out = stage["encoding"](spark, mixed, "").collect()
    assert len(out) == mixed.count() and all(coder.decode(np.array(x.piece_ids, np.int32)) == text[x.doc_id] for x in out)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        assert docs.count() == 0


def test_queries_of_all_operators_are_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_stages_hand_on_columns_with_the_operators_names(spark):
    good = "Eren onda the {0} kesto arime duvel sonta pirel {0}x mavor tenis lorum {0}y gadel"
    clashing = ["n_words", "Kept", "component_id", "pii_spans", "weight", "topic", "sampled", "probability", "_stage_kept", "_own_n_words"]
    rows = [(i, good.format(f"w{i}"), "en", f"s{i % 3}", 1, *(f"{c} {i}" for c in clashing)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(x[c] == f"{c} {x.doc_id}" for x in got for c in clashing), name
    assert corpus_pipeline.encoding(spark, docs, "").count() == 9


def test_of_rows_that_repeat_an_id_the_same_one_stays(spark):
    rows = [(1, f"one two three four five six {i}", "en", "s", i) for i in range(6)] + [(1, "one two three four five six 0", "en", "s", 0), (2, "x y z", None, None, None), (None, "a", None, None, 1), (None, "a", None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = set()
    for n in (1, 3, 7):
        got = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows[n:] + rows[:n], schema).repartition(n), "").collect()]
        assert sorted([x[0] for x in got], key=str) == [1, 2, None, None]
        kept.add(next(x for x in got if x[0] == 1))
    assert len(kept) == 1
