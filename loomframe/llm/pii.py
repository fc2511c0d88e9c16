"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds spans."""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import free_of, light, small, with_fields
from loomframe.llm.spans import Span, cards, emails, ips, luhn, phones

KINDS = ("email", "ip", "card", "phone", "crf_email", "crf_ip", "crf_card", "crf_phone")
BASE = KINDS[:4]
TAGS = ("O", *BASE)
#: Words on either side whose features a position sees.
AROUND = 2
#: Words that have a feature of their own.
CUES = (
    "at dot com org net phone tel telephone call mobile cell fax sms whatsapp hotline mail email contact write card visa mastercard credit debit "
    "ip address host server ping ipv version release license id isbn order invoice year page date price section chapter "
    "edu gov info io co de fr es it uk"
).split()
EDGE = ".,;:!?\"'"
#: Digits of an added span, least and most (others are dropped, as base spans that fail their test are).
DIGITS = {"phone": (7, 15), "card": (13, 19)}
#: Form of an added e-mail span: something, a sign or word for at, something, and a sign or word for the dot (others are dropped too).
ADDRESS = re.compile(r"(?ai)[^\x20\x09-\x0D]+?(?:[\x20\x09-\x0D]?(?:@|[(\[{_]at[)\]}_])[\x20\x09-\x0D]?|[\x20\x09-\x0D]at[\x20\x09-\x0D])[^\x20\x09-\x0D]+?(?:[\x20\x09-\x0D]?(?:\.|[(\[{_]dot[)\]}_])|[\x20\x09-\x0D]dot[\x20\x09-\x0D])")
#: Words with features of their own that a worker remembers; beyond it starts anew.
REMEMBERED = 50_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEPARATOR = re.compile(r"[\x20\x09-\x0D]")
#: Characters that one numpy step takes; a longer text is read in stretches of as many.
STEP_CHARS = 1 << 18


def labelled_table(spark: SparkSession, seed: int = 5, each: int = 20) -> DataFrame:
    """The small labelled table (sentence, pos, word, tag): sentences made by rule, with a fixed seed.

    Formats are those in common use in several countries, written here without looking at any corpus; half of them are of
    things that are no personal data but look alike.
    """
    r = random.Random(seed)
    d = lambda n, first="": (first or r.choice("123456789")) + "".join(r.choice("0123456789") for _ in range(n - 1))
    zero = lambda n: "0" + d(n - 1)
    syllables = "ba ker lo min ta son ri vel du pa nor ish eth ing ment ou le un der auf schl ja mo que ción ña é ü ö ç st ly".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    said = lambda: (w := word()) and r.choice([w, w, w, w.capitalize(), w + ",", w + ".", f"({w})", w + "-" + word()])
    cased = lambda: r.choice([str, str, str.capitalize, str.upper])(word())
    name = lambda: r.choice([cased(), cased() + r.choice("._-") + cased(), word() + d(r.randrange(1, 4)), word()[0] + "." + cased(), word().capitalize() + "." + word().capitalize()])
    host = lambda: r.choice([word(), word() + "-" + word(), word() + d(1)])
    tld = lambda: r.choice("com org net edu gov io de fr es it uk info".split())
    at = lambda: r.choice(["at", "AT", "(at)", "[at]", "{at}"])
    dot = lambda: r.choice(["dot", "DOT", "(dot)", "[dot]"])
    octet = lambda: str(r.choice([r.randrange(256), r.randrange(10)]))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def card_number(right: bool = True, size: int = 16) -> str:
        body = "37" if size == 15 else r.choice(["4", "5", "37", "6011"])
        body += d(size - 1 - len(body))
        last = next(c for c in "0123456789" if luhn(body + c))
        return body + (last if right else str((int(last) + r.randrange(1, 10)) % 10))

    fours = lambda n, by: by.join(n[i : i + 4] for i in range(0, len(n), 4))
    parts = lambda n, by: by.join([n[:4], n[4:10], n[10:15]])
    some = lambda n: " ".join(said() for _ in range(n))
    made = [
        ("email", lambda: f"{name()}@{host()}.{tld()}", 2), ("email", lambda: f"{name()} {at()} {host()} {dot()} {tld()}", 14), ("email", lambda: f"{name()}{r.choice(['(at)', '[at]', '{at}', '_at_'])}{host()}.{tld()}", 12),
        ("email", lambda: f"{name()}[at]{host()}[dot]{tld()}", 4), ("email", lambda: f"<{name()}@{host()}.{word()}.{tld()}>", 1), ("email", lambda: f"{name()} @ {host()} . {tld()}", 2),
        ("ip", lambda: ".".join(octet() for _ in range(4)), 2), ("ip", lambda: ".".join(octet() for _ in range(4)) + r.choice([":80", ":8443", "/24", "/8"]), 1), ("ip", lambda: "[.]".join(octet() for _ in range(4)), 3),
        ("ip", lambda: ":".join(hexes(r.randrange(1, 5)) for _ in range(8)), 1), ("ip", lambda: f"{hexes(4)}:{hexes(3)}::{hexes(r.randrange(1, 5))}", 1), ("ip", lambda: f"fe80::{hexes(4)}:{hexes(4)}", 1),
        ("card", lambda: card_number(), 2), ("card", lambda: fours(card_number(), r.choice(" -")), 2), ("card", lambda: fours(card_number(r.random() < 0.7), r.choice("._/")), 4), ("card", lambda: fours(card_number(size=15), r.choice("._/")), 2), ("card", lambda: parts(card_number(size=15), r.choice("._/")), 2),
        ("phone", lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}", 1), ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}", 2), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}", 2), ("phone", lambda: f"{d(3)}.{d(3)}.{d(4)}" + r.choice(["", "", f" ext {d(2)}"]), 4), ("phone", lambda: f"1-{r.choice(['800', '888'])}-{d(3)}-{d(4)}", 1),
        ("phone", lambda: f"{zero(3)} {d(7)}", 1), ("phone", lambda: f"{zero(4)}{r.choice('/-')}{d(r.randrange(7, 9))}", 2), ("phone", lambda: f"{zero(2)} {d(2)} {d(2)} {d(2)} {d(2)}", 2), ("phone", lambda: f"{zero(3)} {d(4)} {d(4)}", 1), ("phone", lambda: f"00{d(2)} {d(r.randrange(2, 4))} {d(r.randrange(5, 9))}", 3),
        ("O", lambda: f"{r.choice(['version', 'release', 'v'])} {d(1)}.{d(1)}" + r.choice(["", f".{d(1)}", f".{d(1)}.{d(2)}"]), 2), ("O", lambda: f"{d(4, r.choice('12'))}-{zero(2)}-{d(2, '1')}", 1), ("O", lambda: f"{d(2, '1')}/{zero(2)}/{d(4, '2')}", 1), ("O", lambda: f"{d(2, '1')}:{d(2, '3')}" + r.choice(["", f":{d(2, '2')}"]), 1),
        ("O", lambda: f"{r.choice('$€£')}{d(r.randrange(1, 4))},{d(3)}.{d(2)}", 1), ("O", lambda: f"{d(1)}.{d(3)}.{d(3)},{d(2)} {r.choice(['euros', '€'])}", 1), ("O", lambda: f"page {d(2)} of {d(3)}", 1), ("O", lambda: f"{d(4, '1')}-{d(4, '1')}", 1), ("O", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", 2),
        ("O", lambda: f"order {d(r.choice([6, 8, 10]))}", 2), ("O", lambda: f"id {d(r.randrange(5, 20))}", 2), ("O", lambda: card_number(False), 3), ("O", lambda: fours(card_number(False), r.choice(" -")), 2), ("O", lambda: d(r.randrange(1, 8)), 3), ("O", lambda: d(r.randrange(8, 22)), 2),
        ("O", lambda: hexes(r.choice([16, 32, 40])), 1), ("O", lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randrange(6, 24))), 1), ("O", lambda: f"{word()}={hexes(12)}", 1), ("O", lambda: f"{word()}_{word()} = '{hexes(8)}'", 1), ("O", lambda: f"#{d(3)}", 1), ("O", lambda: f"{d(1)}. {said()}", 1),
        ("O", lambda: f"{said()} at {said()} {r.choice(['at', 'dot', 'the', word()])} {said()}", 4), ("O", lambda: f"at at {said()}", 1), ("O", lambda: " ".join([r.choice([*CUES, word(), d(2), "At", "at."])] * r.randrange(2, 9)), 5), ("O", lambda: f"{said()} dot {said()} net {said()}", 1), ("O", lambda: f"{said()} at {d(r.randrange(1, 5))} {said()}", 2), ("O", lambda: f"@{word()}", 1), ("O", lambda: f"{word()} @ {d(2)}", 1),
        ("O", lambda: f"{word()}.{tld()}", 1), ("O", lambda: f"https://{host()}.{tld()}/{word()}/{d(4)}", 1), ("O", lambda: " | ".join(r.choice([word(), d(r.randrange(1, 7))]) for _ in range(5)), 2), ("O", lambda: " ".join(d(r.randrange(1, 5)) for _ in range(r.randrange(2, 4))), 2), ("O", lambda: " ".join(d(r.randrange(1, 5)) for _ in range(r.randrange(6, 14))), 2), ("O", lambda: (k := r.randrange(1, 5)) and " ".join(d(k) for _ in range(r.randrange(6, 14))), 2), ("O", lambda: f"{d(2)}.{d(4)}, {d(2)}.{d(4)}", 1), ("O", lambda: f"{d(2)} x {d(2)} x {d(3)} cm", 1),
        ("O", lambda: f"{word()}{r.choice('$&*%|#<>')}{word()} {r.choice('$&*%|#<>') * 3} {d(r.randrange(3, 18))}{r.choice('$&*%|#')}", 3), ("O", lambda: f"{r.choice(['and', '*', '-', '|', '&', '...', '--'])} {said()}", 3), ("O", lambda: some(r.randrange(6, 12)), 12),
    ]
    rows, n = [], 0
    for tag, make, times in made:
        for _ in range(each * times):
            pairs = [(w, "O") for w in some(r.randrange(0, 5)).split()]
            if tag != "O" and r.random() < 0.3:
                cue = {"email": ["mail", "email:", "contact"], "ip": ["host", "ip", "address"], "card": ["card", "visa:", "credit card", "paid with", "number"], "phone": ["tel.", "phone:", "call", "mobile"]}[tag]
                pairs += [(w, "O") for w in r.choice(cue).split()]
            pairs += [(w, tag) for w in make().split()]
            if r.random() < 0.3:
                pairs[-1] = (pairs[-1][0] + r.choice(",.;"), pairs[-1][1])
            pairs += [(w, "O") for w in some(r.randrange(0, 5)).split()]
            rows += [(n, i, w, t) for i, (w, t) in enumerate(pairs)]
            n += 1
    return spark.createDataFrame(rows, "sentence long, pos int, word string, tag string")


def kind_of(c: str) -> str:
    return "9" if c in "0123456789" else "a" if c.islower() else "A" if c.isalpha() else c


def shape(word: str, longest: int) -> str:
    """The word's kinds of characters, runs collapsed to so many: A capital, a small, 9 digit, others themselves."""
    out, run, last = "", 0, ""
    for c in word[:200]:
        k = kind_of(c)
        run = run + 1 if k == last else 1
        last = k
        if run <= longest:
            out += k
    return out[:32]


def word_features(word: str) -> tuple[str, ...]:
    """Features of one word. A plain word (letters within outer marks) has but one, or its cue."""
    core = word.strip(EDGE)
    low = core.lower()
    if core.isalpha():
        return (f"cue={low}" if low in CUES else "plain",)
    digits = sum(c in "0123456789" for c in core)
    number = re.sub("[-._/]", "", core)
    bare = re.sub(r"[^\w]", "", low)
    return (
        f"shape={shape(core, 1)}", f"form={shape(core, 4)}", f"digits={min(digits, 20)}", f"zero={core[:1] == '0'}", f"bare={bare if bare in CUES else ''}",
        "luhn" if 14 <= len(number) <= 19 and number.isascii() and number.isdecimal() and luhn(number) else "no luhn",
        f"at={'@' in core or any(x in low for x in ('(at)', '[at]', '{at}', '_at_'))}", f"colons={min(core.count(':'), 3)}",
    )


def sequence_features(words: list[str]) -> list[tuple[str, ...]]:
    """Features at each position, from the word and AROUND neighbours on either side (beyond the ends: plain)."""
    own = [("plain",)] * AROUND + [word_features(w) for w in words] + [("plain",)] * AROUND
    return [tuple(f"{o - AROUND}:{f}" for o in range(2 * AROUND + 1) for f in own[i + o]) for i in range(len(words))]


class Crf:
    """Weights of a linear-chain field: per feature and tag, and per pair of neighbouring tags."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, sequences: list[list[tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores padded to the longest sequence, and the lengths."""
        size = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), int(size.max(initial=0)), len(TAGS)))
        for i, s in enumerate(sequences):
            for t, names in enumerate(s):
                known = [self.index[f] for f in names if f in self.index]
                if known:
                    out[i, t] = self.emit[known].sum(0)
        return out, size

    def decode(self, sequences: list[list[tuple[str, ...]]]) -> list[np.ndarray]:
        """Best tags of each sequence, by Viterbi over all sequences at once."""
        if not sequences:
            return []
        emit, size = self.scores(sequences)
        tags = self.viterbi(emit, size)
        return [tags[i, :n] for i, n in enumerate(size)]

    def viterbi(self, emit: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best tags for emissions padded to the longest sequence."""
        best, back = emit[:, 0], []
        for t in range(1, emit.shape[1]):
            total = best[:, :, None] + self.move
            back.append(total.argmax(1))
            best = np.where((t < size)[:, None], total.max(1) + emit[:, t], best)
        tags = np.zeros(emit.shape[:2], int)
        now = best.argmax(1)
        for t in range(emit.shape[1] - 1, -1, -1):
            tags[:, t] = now
            if t:
                now = np.where(t < size, back[t - 1][np.arange(len(now)), now], now)
        return tags


def train(labelled: DataFrame, epochs: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient steps (forward-backward over all sentences at once) on the small labelled table."""
    by: dict[int, list] = {}
    for row in labelled.orderBy("sentence", "pos").collect():
        by.setdefault(row["sentence"], []).append((row["word"], row["tag"]))
    sentences = [s for s in by.values()]
    # Features of a word without their offsets, by word; a feature at an offset has its own weight.
    base: dict[str, int] = {"plain": 0}
    own = {w: [base.setdefault(f, len(base)) for f in word_features(w)] for s in sentences for w, _ in s}
    width = 2 * AROUND + 1
    index = {f"{o - AROUND}:{f}": i * width + o for f, i in base.items() for o in range(width)}
    names = sorted(index, key=index.get)
    k, n = len(TAGS), len(sentences)
    size = np.array([len(s) for s in sentences])
    steps = int(size.max(initial=1))
    gold = np.zeros((n, steps), int)
    where, what = [], []
    for i, s in enumerate(sentences):
        around = [[0]] * AROUND + [own[w] for w, _ in s] + [[0]] * AROUND
        for t, (_, tag) in enumerate(s):
            gold[i, t] = TAGS.index(tag)
            for o in range(width):
                for f in around[t + o]:
                    where.append(i * steps + t)
                    what.append(f * width + o)
    where, what = np.array(where, np.int32), np.array(what, np.int32)
    live = np.arange(steps) < size[:, None]
    # Sums over the features of a position, and over the positions of a feature, as sums of sorted stretches.
    by_feature = np.argsort(what, kind="stable")
    first_at, first_of = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int) for x in (where, what[by_feature]))
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    if not sentences:
        return Crf(index, emit, move)
    seen_e, seen_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    want = np.zeros((n * steps, k))
    want[np.flatnonzero(live.ravel()), gold.ravel()[live.ravel()]] = 1
    for _ in range(epochs):
        score = np.zeros((n * steps, k))
        score[where[first_at]] = np.add.reduceat(emit[what], first_at)
        score = score.reshape(n, steps, k)
        ahead, behind = [score[:, 0]], [np.zeros((n, k))]
        for t in range(1, steps):
            x = ahead[-1][:, :, None] + move
            top = x.max(1)
            ahead.append(np.where(live[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + score[:, t], ahead[-1]))
        for t in range(steps - 1, 0, -1):
            x = move + (score[:, t] + behind[0])[:, None, :]
            top = x.max(2)
            behind.insert(0, np.where(live[:, t, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), behind[0]))
        end = ahead[-1]
        z = end.max(1) + np.log(np.exp(end - end.max(1, keepdims=True)).sum(1))
        p = np.exp(np.stack(ahead, 1) + np.stack(behind, 1) - z[:, None, None]) * live[:, :, None]
        grad_m = np.zeros((k, k))
        for t in range(1, steps):
            on = live[:, t]
            x = np.exp(ahead[t - 1][:, :, None] + move + (score[:, t] + behind[t])[:, None, :] - z[:, None, None])
            grad_m -= x[on].sum(0)
            np.add.at(grad_m, (gold[on, t - 1], gold[on, t]), 1)
        grad_e = np.zeros_like(emit)
        grad_e[what[by_feature][first_of]] = np.add.reduceat((want - p.reshape(-1, k))[where[by_feature]], first_of)
        grad_e, grad_m = grad_e - ridge * n * emit, grad_m - ridge * n * move
        seen_e += grad_e**2
        seen_m += grad_m**2
        emit += rate * grad_e / np.sqrt(seen_e)
        move += rate * grad_m / np.sqrt(seen_m)
    return Crf(index, emit, move)


def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point (0 separator, 1 letter, 2 outer mark, 3 other) and its small letter: 5.5 MB, made once and broadcast."""
    kind, low = np.full(0x110000, 3, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            kind[i] = 1
            if len(small_one := c.lower()) == 1:
                low[i] = ord(small_one)
    kind[[32, *range(9, 14)]] = 0
    kind[[ord(c) for c in EDGE]] = 2
    return kind, low


class Tagger:
    """Tags all words of many texts with the field's best sequence.

    The emission of a position is a sum over the words around it, kept as one table row for each word with features of its own
    (row 0: plain). A position is quiet if its emission prefers O to each other tag by floor at least. Stretches of
    length or more quiet positions are O in every best sequence (see quiet), and what lies between them is decoded by itself:
    so the result is that of decoding whole texts.
    """

    def __init__(self, model: Crf, tables: tuple[np.ndarray, np.ndarray] | None = None):
        self.model, n = model, 2 * AROUND + 1
        self.kind_at, self.low_at = tables or classes()
        # Weights by feature without its offset: one table of offsets and tags each.
        self.names: dict[str, int] = {}
        for f in model.index:
            self.names.setdefault(f.split(":", 1)[1], len(self.names))
        self.weights = np.zeros((len(self.names), n, len(TAGS)))
        for f, i in model.index.items():
            offset, name = f.split(":", 1)
            self.weights[self.names[name], int(offset) + AROUND] = model.emit[i]
        self.rows, self.n = np.zeros((64, n, len(TAGS))), 0
        self.known: dict[str, int] = {}
        self.row(("plain",))
        self.cues = {self.hashed(w): self.row((f"cue={w}",)) for w in CUES}
        self.fixed = self.n
        self.floor, self.length = self.quiet(self.rows[0].sum(0), model.move)

    @staticmethod
    def quiet(plain: np.ndarray, move: np.ndarray) -> tuple[float, int]:
        """A preference for O, and how many neighbouring positions that all have it are O in every best sequence.

        Take a best sequence with other tags at some places of such a stretch, and write O there instead. Each place gains floor
        or more; each move between two such places loses at most inner; the moves into and out of them lose most where
        the other tags go on beyond the stretch, less where they begin or end in it. If the gain is larger for one place of tags that
        end in the stretch, and for the whole stretch, it is so for all cases between. Plain words among plain words are
        quiet if that is possible at all.
        """
        slack = 1e-6
        inner = float((move[1:, 1:] - move[0, 0]).max())
        into, out = float((move[1:, 1:] - move[1:, :1]).max()), float((move[1:, 1:] - move[:1, 1:]).max())
        from_o, to_o = float((move[0, 1:] - move[0, 0]).max()), float((move[1:, 0] - move[0, 0]).max())
        into, out, from_o, to_o = (max(x, 0.0) for x in (into, out, from_o, to_o))
        least = max(inner, into + to_o, from_o + out) + slack
        floor = max(least, inner + max(0.0, into + out - inner) / 3 + slack)
        own = float((plain[0] - plain[1:]).min())
        if least < own < floor:
            floor = own
        return floor, max(1, int((into + out - inner + slack) // (floor - inner)) + 1)

    @staticmethod
    def hashed(word: str) -> int:
        h = 0
        for c in word:
            h = (h * 0x100000001B3 + ord(c)) & (1 << 64) - 1
        return h

    def row(self, features: tuple[str, ...]) -> int:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = self.weights[[self.names[f] for f in features if f in self.names]].sum(0)
        self.n += 1
        return self.n - 1

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and table row of each word of the joined texts, and the index of the first word of each text."""
        joined = "\n".join(texts) + "\n"
        kind_at, low_at = self.kind_at, self.low_at
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = kind_at[points]
        inside = np.concatenate([[False], kind > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
        row = np.zeros(len(start), np.int64)
        if not len(start):
            return start, end, row, first
        letters = np.concatenate([[0], np.cumsum(kind == 1)])
        n_letters = letters[end] - letters[start]
        # The outermost letters of each word; a word is plain if all between them are letters and no other mark is outside.
        place = np.flatnonzero(kind == 1)
        lo, hi = letters[start], letters[end] - 1
        some = n_letters > 0
        span = np.zeros(len(start), np.int64)
        span[some] = place[hi[some]] - place[lo[some]] + 1
        odd = np.concatenate([[0], np.cumsum(kind == 3)])
        plain = some & (span == n_letters) & (odd[end] == odd[start])
        # Short plain words may be cues.
        for size in sorted({len(w) for w in CUES}):
            own = np.flatnonzero(plain & (n_letters == size))
            h = np.zeros(len(own), np.uint64)
            for k in range(size):
                h = h * np.uint64(0x100000001B3) + low_at[points[place[lo[own]] + k]]
            keys = np.array(sorted(k for k in self.cues), np.uint64)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            row[own[hit]] = np.array([self.cues[k] for k in keys.tolist()])[at[hit]]
        for i in np.flatnonzero(~plain).tolist():
            word = joined[start[i] : end[i]]
            k = self.known.get(word)
            if k is None:
                k = self.known[word] = self.row(word_features(word))
            row[i] = k
        return start, end, row, first

    def all_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words(), for a text of more than STEP_CHARS by stretches that end with a separator, so that only figures of its words are held."""
        if len(texts) > 1 or len(texts[0]) <= 2 * STEP_CHARS:
            return self.words(texts)
        text, lo, found = texts[0], 0, []
        while lo < len(text):
            hi = lo + STEP_CHARS
            m = SEPARATOR.search(text, hi) if hi < len(text) else None
            hi = m.end() if m else len(text)
            start, end, row, _ = self.words([text[lo:hi]])
            found.append((start + lo, end + lo, row))
            lo = hi
        start, end, row = (np.concatenate(x) for x in zip(*found))
        return start, end, row, np.array([0, len(start)])

    def tags(self, row: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The tag of each word."""
        out = np.zeros(len(row), np.int64)
        if not len(row):
            return out
        gaps = np.repeat(np.arange(len(first) - 1) * AROUND, np.diff(first)) + AROUND  # plain words stand between the texts
        padded = np.zeros(len(row) + AROUND * len(first), np.int64)
        at = np.arange(len(row)) + gaps
        padded[at] = row
        loud = padded > 0
        near = loud.copy()
        for o in range(1, AROUND + 1):
            near[o:] |= loud[:-o]
            near[:-o] |= loud[o:]
        plain = self.rows[0].sum(0)
        quiet = np.full(len(row), (plain[0] - plain[1:]).min() >= self.floor)
        where = np.flatnonzero(near[at]) if quiet[0] else np.arange(len(row))
        emit = sum(self.rows[padded[at[where] + o - AROUND], o] for o in range(2 * AROUND + 1))
        quiet[where] = (emit[:, :1] - emit[:, 1:]).min(1) >= self.floor
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        edge = np.flatnonzero(np.concatenate([[True], (quiet[1:] != quiet[:-1]) | (text_of[1:] != text_of[:-1])]))
        length = np.diff(np.append(edge, len(row)))
        where = np.flatnonzero(~np.repeat(quiet[edge] & (length >= self.length), length))
        if not len(where):
            return out
        emit = sum(self.rows[padded[at[where] + o - AROUND], o] for o in range(2 * AROUND + 1))
        text = np.searchsorted(first, where, side="right")
        begins = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (text[1:] != text[:-1])])
        head = np.flatnonzero(begins)
        size = np.diff(np.append(head, len(where)))
        last = head + size - 1
        before, after = where[head] > first[text[head] - 1], where[last] < first[text[head]] - 1
        emit[head[before]] += self.model.move[0]
        emit[last[after]] += self.model.move[:, 0]
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 512):
            part = order[lo : lo + 512]
            padded_emit = np.zeros((len(part), int(size[part[-1]]), len(TAGS)))
            inside = np.arange(padded_emit.shape[1]) < size[part, None]
            places = (head[part, None] + np.arange(padded_emit.shape[1]))[inside]
            padded_emit[inside] = emit[places]
            out[where[places]] = self.model.viterbi(padded_emit, size[part])[inside]
        return out

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of neighbouring words with one tag, in code points of each text, outer marks left out."""
        out: list[list[Span]] = [[] for _ in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.n = {}, self.fixed
        start, end, row, first = self.all_words(texts)
        tags = self.tags(row, first)
        hit = np.flatnonzero(tags)
        if not len(hit):
            return out
        text = np.searchsorted(first, hit, side="right") - 1
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1]) | (tags[hit[1:]] != tags[hit[:-1]])])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hit)) - 1
        offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        for i, j in zip(head.tolist(), tail.tolist()):
            k = int(text[i])
            a, b = int(start[hit[i]] - offset[k]), int(end[hit[j]] - offset[k])
            own = texts[k][a:b]
            a, b = a + len(own) - len(own.lstrip(EDGE)), b - len(own) + len(own.rstrip(EDGE))
            kind = TAGS[tags[hit[i]]]
            least, most = DIGITS.get(kind, (0, b - a))
            if a < b and least <= sum(c in "0123456789" for c in texts[k][a:b]) <= most and (kind != "email" or ADDRESS.match(texts[k][a:b])):
                out[k].append((a, b, f"crf_{kind}"))
        return out


def groups(texts: list[str], base: list[list[Span]]) -> Iterator[tuple[list[str], list[list[Span]]]]:
    """Neighbouring texts, and their base spans, that together have about STEP_CHARS characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP_CHARS or i + 1 == len(texts):
            yield texts[lo : i + 1], base[lo : i + 1]
            lo, size = i + 1, 0


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Spans of tagged words that touch no base span, for all texts at once."""
    out = []
    for own, found in zip(base, tagger.spans(texts)):
        taken = sorted((a, b) for a, b, _ in own)
        reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
        # Of the base spans that begin before a span ends, none reaches beyond its start.
        out.append([s for s in found if not (n := bisect_left(taken, (s[1],))) or reach[n - 1] <= s[0]])
    return out


def find(docs: DataFrame, model: Crf, text_col: str = "text", mask: bool = False) -> DataFrame:
    """docs with pii_spans, an array of (start, end, kind); with mask, also with the spans in the text replaced by <KIND>.

    Offsets are code points, ends exclusive. A null or empty text has no spans and stays as it is; ids are not looked at, so null
    and repeated ones are like any other; equal rows give equal spans, and an empty table an empty one. Base spans come
    first where spans would overlap; added spans of the field never touch them. A very long text is read in stretches, of which the words'
    places and tags are held (some 40 bytes a word). Columns of docs with the name of the added one are replaced.
    """
    docs = free_of(docs, "pii_spans")
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    # A worker keeps its tagger in its copy of the broadcast, so that it is made once, not in each task.
    shared = light(docs.sparkSession).sparkContext.broadcast({"field": (model.index, model.emit, model.move), "tables": classes()})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        tagger = mine["tagger"] = mine.get("tagger") or Tagger(Crf(*mine["field"]), mine["tables"])
        for batch in small(batches, 128):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base = [emails(t) + ips(t) + cards(t) + phones(t) for t in texts]
            more = [s for part, own in groups(texts, base) for s in added_spans(part, own, tagger)]
            found = [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for b, m in zip(base, more)]
            columns = list(batch.columns)
            if mask:
                columns[at] = pa.array([masked(t, s) if t is not None else None for t, s in zip(batch.column(at).to_pylist(), found)], pa.string())
            spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*batch.schema.names, "pii_spans"])

    return docs.mapInArrow(run, with_fields(docs, pii_spans="array<struct<start:long,end:long,kind:string>>"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones joined, as <KIND>."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.removeprefix('crf_').upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def digests(found: DataFrame, column: str, base: tuple[str, ...]) -> DataFrame:
    """n_<kind> of the base kinds, base_sha256 and spans of an array of spans that comes in order."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter(column, lambda s: s["kind"].isin(*base))
    of_kind = lambda k: F.filter(column, lambda s: s["kind"] == k)
    return found.withColumns(
        {f"n_{k}": F.size(of_kind(k)).cast("long") for k in base}
        | {"base_sha256": F.sha2(text(own), 256), "spans": text(F.col(column))}
    )
