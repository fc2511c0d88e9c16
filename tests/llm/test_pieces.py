import random
import re

import numpy as np
import pytest

from loomframe.llm import pieces
from loomframe.llm.pieces import Coder, decode, default_model, encode, joined

TEXTS = ["", " ", "  two  spaces ", "Hello world", "line\nbreak\ttab", "naïve café ñandú Übung", "漢字 and 😀 emoji", "a ▁ mark ▁▁", "x" * 3000, " nbsp \x00 null", "<s> </s> <unk> <0x41>", "2024-01-01 12:30", "re re re re", "tionthere enheit queos"]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_without_dropout_equals_the_model(sp):
    coder = Coder.load(dropout=0)
    r = random.Random(1)
    more = ["".join(r.choice(["the", "tion", " ", "é", "ß", "9", ".", "\n", "ou", "  "]) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    for text in TEXTS + more:
        if "▁" not in text:
            assert coder.encode(text) == sp.encode(text), text


def units(text):
    """Units of a text by a plain scan, the space before it as a mark of its own ("_" here), so that the mark itself stays apart."""
    marked = "_" + text.replace("_", "\1").replace(" ", "_")
    return re.findall("▁|\n[^_▁\n]*|_*[^_▁\n]+|_+", marked)


def plain_agenda(coder, unit, key):
    """The agenda by its definition: lists, the first of the best ranks, a draw for each candidate that comes up."""
    parts = [-1 - ord(c) if c == "▁" else coder.symbols.get({"_": "▁", "\1": "_"}.get(c, c), -1 - ord({"\1": "_"}.get(c, c))) for c in unit]
    off, at = set(), 0
    while True:
        found = [(coder.pairs.get(x * coder.width + y, None), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x >= 0 and y >= 0]
        found = [(r, i) for r, i in found if r is not None and i not in off]
        if not found:
            break
        rank, i = min(found)
        at += 1
        if coder.limit and coder.skipped(key, at - 1):
            off.add(i)
            continue
        parts[i : i + 2] = [int(coder.made[rank])]
        off = {k if k < i else k - 1 for k in off if k not in (i - 1, i, i + 1)}
    ids = []
    for p in parts:
        ids += [p] if 0 <= p < coder.n_pieces else [coder.bytes_at[b] for b in (chr(-1 - p) if p < 0 else coder.others[p]).encode()]
    return ids


@pytest.mark.parametrize("dropout", [0.1, 0.4])
def test_dropout_equals_agendas_one_by_one(dropout):
    coder, r = Coder.load(dropout=dropout, seed=4), random.Random(8)
    texts = TEXTS + ["".join(r.choice(["the", "tion", "é", "under", "stand", "9", "漢", " ", " ", "\n", "_", "▁", "  "]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in texts]
    ids, count = coder.encode_all(texts, keys)
    for text, key, lo, n in zip(texts, keys, np.cumsum(count) - count, count):
        own = units(text) if text else []
        want = [x for u, k in zip(own, coder.keys(key, len(own)).tolist()) for x in plain_agenda(coder, u, k)]
        assert ids[lo : lo + n].tolist() == want, text
        assert joined(coder.table, ids[lo : lo + n]) == text


def test_stretches_of_long_texts_change_nothing(monkeypatch):
    coder, r = Coder.load(dropout=0.2, seed=3), random.Random(5)
    text = "".join(r.choice(["then", "ion", "▁", " ", " ", "  ", "\n", " \n", "9"]) for _ in range(900))
    whole = coder.encode(text, 7)
    monkeypatch.setattr(pieces, "STEP_CHARS", 40)
    assert coder.encode(text, 7) == whole and coder.decode(np.array(whole)) == text


def test_scanning_and_heap_agree(monkeypatch):
    coder, r = Coder.load(dropout=0.2, seed=3), random.Random(5)
    texts = ["".join(r.choice("thenionquersadé9ß漢") for _ in range(r.randrange(1, 40))) for _ in range(300)]
    found = [coder.encode(t, 12345) for t in texts]
    monkeypatch.setattr(pieces, "CLASSES", ())
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [coder.encode(t, 12345) for t in texts] == found


def test_dropout_varies():
    coder = Coder.load(dropout=0.3, seed=7)
    text = "tionthere enheit queos the hereditary question of understanding"
    seen = {tuple(coder.encode(text, v)) for v in range(8)}
    assert len(seen) > 3 and coder.encode(text, 2) == Coder.load(dropout=0.3, seed=7).encode(text, 2)
    assert coder.encode(text, 2) != Coder.load(dropout=0.3, seed=8).encode(text, 2)
    assert len(coder.encode(text, 1)) > len(Coder.load(dropout=0).encode(text))


def test_occurrences_of_a_word_vary():
    coder, plain = Coder.load(seed=4), Coder.load(dropout=0)
    word = "understanding"
    assert len({tuple(coder.encode(word, key)) for key in range(200)}) > 10
    within = coder.encode(" ".join([word] * 200), 1)
    assert len(within) > 200 * len(plain.encode(word))


def test_a_word_varies_over_documents(spark):
    df = spark.createDataFrame([(i, "understanding") for i in range(100)], "doc_id long, text string")
    rows = encode(df, Coder.load()).collect()
    assert len({tuple(x.piece_ids) for x in rows}) > 4


def test_frames(spark):
    coder = Coder.load()
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id", 2, 2), (99, None, 3, 2), (98, "again again", 3, 2), (98, "again again", 3, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int, _lf_key int")
    out = decode(encode(df, coder), coder).collect()
    assert len(out) == len(rows) and all(x.text == x.decoded for x in out)
    assert [x.piece_ids for x in out if x.doc_id == 99] == [None] and [x.piece_ids for x in out if x.doc_id == 0] == [[]]
    assert len({tuple(x.piece_ids) for x in out if x.doc_id == 98}) == 1 and all(x._lf_key == 2 for x in out)
    assert decode(encode(df.limit(0), coder), coder).count() == 0
