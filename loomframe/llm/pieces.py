"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import free_of, fresh, light, mix, small, with_fields

SPACE = "▁"
#: Chance that a candidate merge is skipped.
DROPOUT = 0.1
#: Units up to so many characters are merged many at once, in classes by length; longer ones one by one, by a heap.
SHORT = 48
CLASSES = (4, 8, 12, 20, SHORT)
#: Characters of text that a numpy step takes.
STEP_CHARS = 1 << 18
#: No rank, and no symbol.
NEVER, GONE = 1 << 30, -1 << 30
ALL, STEP, LANE = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LONE = re.compile("(?<! ) (?! )")


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of STEP_CHARS or more, cut at single spaces (which go)."""
    at = 0
    while len(text) - at > STEP_CHARS and (found := LONE.search(text, at + STEP_CHARS)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def mixed(x: int) -> int:
    """common.mix of one number."""
    x &= ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def default_model() -> str:
    return os.path.join(os.environ.get("LOOMFRAME_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


class Coder:
    """Pieces of a merge-type model with byte fallback: the encoder's agenda and the decoder's table."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int], plain: list[bool], dropout: float, seed: int):
        self.parts = {"pieces": pieces, "scores": scores, "bytes_at": bytes_at, "plain": plain, "dropout": dropout, "seed": seed}
        ids = {p: i for i, (p, ok) in enumerate(zip(pieces, plain)) if ok}
        self.bytes_at = bytes_at
        self.limit, self.seed = round(dropout * (1 << 16)), seed
        table = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(pieces, plain)]
        for value, i in enumerate(bytes_at):
            table[i] = bytes([value])
        self.table = table
        # Symbols are pieces, and characters that occur in pieces without being one; a pair that makes a piece has its rank.
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        self.symbols, self.width, self.n_pieces = symbols, len(pieces) + len(symbols) + 1, len(pieces)
        order = sorted(ids.values(), key=lambda k: (-scores[k], k))
        self.made = np.array(order, np.int32)
        ranks = {k: r for r, k in enumerate(order)}
        self.pairs = {}
        for p, k in ids.items():
            for i in range(1, len(p)):
                x, y = symbols.get(p[:i]), symbols.get(p[i:])
                if x is not None and y is not None:
                    self.pairs[x * self.width + y] = ranks[k]
        self.ranks = Ranks(np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int32))
        self.others = {k: c for c, k in symbols.items() if k >= len(pieces)}
        # Symbols of single characters; one that the model lacks is -1 - its code point, and so is the mark, which is not a space.
        self.single = -1 - np.arange(0x110000, dtype=np.int32)
        for c, k in symbols.items():
            if len(c) == 1:
                self.single[ord(c)] = k
        self.single[32], self.single[ord(SPACE)] = symbols[SPACE], -1 - ord(SPACE)
        if any("\n" in p[1:] or "\n" in p[:-1] for p in ids):
            raise ValueError("a piece with a newline in it would span two units")

    @staticmethod
    def of(shared: dict) -> Coder:
        """The coder of a broadcast dict of its plain parts, made once in each worker."""
        if "coder" not in shared:
            shared["coder"] = Coder(**shared["parts"])
        return shared["coder"]

    @classmethod
    def load(cls, path: str | None = None, dropout: float = DROPOUT, seed: int = 0) -> Coder:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], [not s for s in special], dropout, seed)

    def keys(self, key: int, n: int, first: int = 0) -> np.ndarray:
        """Hash keys of n units of a text from the one numbered first on, from the seed, the text's key and the unit's place."""
        base = xxhash.xxh64_intdigest((key & ALL).to_bytes(8, "little"), self.seed & ALL)
        return mix(np.uint64(base) + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(STEP))

    def skipped(self, key: int, at: int) -> bool:
        """Whether the candidate numbered at of a unit's key is skipped."""
        return mixed(key + (at // 4 + 1) * LANE) >> 16 * (at % 4) & 0xFFFF < self.limit

    def draws(self, keys: np.ndarray, at: int) -> np.ndarray:
        """skipped() for the candidates at to at + 3 of many keys, at a multiple of 4."""
        return mix(keys + np.uint64((at // 4 + 1) * LANE & ALL)).astype("<u8", copy=False).view("<u2").reshape(-1, 4) < self.limit

    def agenda(self, parts: list[int], key: int) -> list[int]:
        """Symbols of one unit after agenda processing.

        Candidate merges come up by rank, then by place. Each that comes up has its own draw by the key; if that falls below the
        dropout, the candidate is skipped until a neighbour changes.
        """
        get, width, made, at, n = self.pairs.get, self.width, self.made, 0, len(parts)
        before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), -1 << 40
        agenda = [(r, i, i + 1) for i in range(n - 1) if (r := get(parts[i] * width + parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(agenda)
        while agenda:
            rank, i, j = heapq.heappop(agenda)
            if parts[i] == gone or parts[j] == gone or after[i] != j or get(parts[i] * width + parts[j], NEVER) != rank:
                continue
            at += 1
            if self.limit and self.skipped(key, at - 1):
                continue
            parts[i], parts[j] = int(made[rank]), gone
            h, t = before[i], after[j]
            after[i] = t
            if t < n:
                before[t] = i
                if (r := get(parts[i] * width + parts[t], NEVER)) != NEVER:
                    heapq.heappush(agenda, (r, i, t))
            if h >= 0 and (r := get(parts[h] * width + parts[i], NEVER)) != NEVER:
                heapq.heappush(agenda, (r, h, i))
        return [x for x in parts if x != gone]

    def agendas(self, parts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """agenda() for many units at once, one a row (padded with GONE): in round k every unit takes its candidate k.

        A row's places are linked to the next and the one before, and hold the rank of the pair that begins there.
        """
        n, size = parts.shape
        parts = np.concatenate([parts, np.full((n, 1), GONE, np.int32)], 1)  # one place beyond the end
        width, flat = size + 1, parts.ravel()
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32).clip(max=size), parts.shape).copy().ravel()
        before = np.broadcast_to(np.arange(-1, size, dtype=np.int32), parts.shape).copy().ravel()
        rank = np.full(parts.shape, NEVER, np.int32)
        rank[:, : size - 1] = self.ranks.of(parts[:, : size - 1].ravel(), parts[:, 1:size].ravel(), self.width).reshape(n, -1)
        rows, at, ranks = np.arange(n), 0, rank.ravel()
        while len(rows):
            i = rank[rows].argmin(1)
            p = rows * width + i
            best = ranks[p]
            on = best < NEVER
            if not on.all():
                rows, i, p, best = rows[on], i[on], p[on], best[on]
            if self.limit:
                if at % 4 == 0:
                    drawn = np.zeros((n, 4), bool)
                    drawn[rows] = self.draws(keys[rows], at)
                skip = drawn[rows, at % 4]
                ranks[p[skip]] = NEVER
                take = ~skip
                base, i, p, best = (rows * width)[take], i[take], p[take], best[take]
            else:
                base = rows * width
            q = base + after[p]
            t = after[q]
            flat[p], flat[q], ranks[q] = self.made[best], GONE, NEVER
            after[p] = t
            before[base + t] = i
            ranks[p] = self.ranks.of(flat[p], flat[base + t], self.width)
            h = before[p]
            left = np.flatnonzero(h >= 0)
            h = (base + h)[left]
            ranks[h] = self.ranks.of(flat[h], flat[p[left]], self.width)
            at += 1
        return parts[:, :size]

    def merged(self, chars: str, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units of a string after their agendas, in one array, and the number of each unit's."""
        symbols = self.single[np.frombuffer(chars.encode("utf-32-le"), "<u4")]
        size = np.diff(np.append(starts, len(symbols)))
        count, held, low = np.zeros(len(starts), np.int64), [], 0
        for top in CLASSES:
            own = np.flatnonzero((size > low) & (size <= top))
            low = top
            if len(own):
                places = np.arange(top)
                inside = places < size[own, None]
                parts = np.where(inside, symbols[np.where(inside, starts[own, None] + places, 0)], GONE)
                parts = self.agendas(parts, keys[own]) if top > 1 else parts
                left = parts != GONE
                count[own] = left.sum(1)
                held.append((own, parts[left]))
        for k in np.flatnonzero(size > SHORT).tolist():
            found = self.agenda(symbols[starts[k] : starts[k] + size[k]].tolist(), int(keys[k]))
            count[k] = len(found)
            held.append((np.array([k]), np.array(found, np.int32)))
        first, out = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int32)
        for own, found in held:
            n = count[own]
            out[np.arange(len(found)) + np.repeat(first[own] - (np.cumsum(n) - n), n)] = found
        return out, count

    def spelled(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols (a character that is no piece as its bytes), and the owner of each."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n_pieces))
        if not len(odd):
            return symbols, owner
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        spelling = [[self.bytes_at[b] for b in (chr(-1 - k) if k < 0 else self.others[k]).encode()] for k in kinds.tolist()]
        n = np.ones(len(symbols), np.int64)
        n[odd] = np.array([len(x) for x in spelling])[which]
        ids, first = np.repeat(symbols, n), (np.cumsum(n) - n)[odd]
        for k in range(max(map(len, spelling))):
            some = np.flatnonzero(n[odd] > k)
            ids[first[some] + k] = np.array([x[k] if k < len(x) else 0 for x in spelling])[which[some]]
        return ids, np.repeat(owner, n)

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, skips drawn by each text's key, and the number of ids of each; a space stands before a text, as the model was made with.

        A unit is a run of spaces with what follows up to the next space or newline, or a newline with what follows, or the mark alone: no piece spans
        two units. A unit's key comes from the seed, the text's key and the unit's place in its text.
        """
        out, count = [], np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        done = np.zeros(len(texts), np.int64)  # units of each text so far

        def flush() -> None:
            chars = "".join(f" {part}" for _, part in held)
            points = np.frombuffer(chars.encode("utf-32-le"), "<u4")
            blank, line, mark = points == 32, points == 10, points == ord(SPACE)
            begins = np.cumsum([0] + [len(part) + 1 for _, part in held])
            opens = blank | line | mark
            opens[1:] &= ~(blank[1:] & blank[:-1])
            opens[1:] |= mark[:-1]
            opens[begins[:-1]] = True
            starts = np.flatnonzero(opens)
            edges = np.searchsorted(starts, begins)
            own = [self.keys(keys[i], n, int(done[i])) for (i, _), n in zip(held, np.diff(edges).tolist())]
            symbols, n = self.merged(chars, np.concatenate(own), starts)
            owner = np.repeat(np.repeat([i for i, _ in held], np.diff(edges)), n)
            ids, owner = self.spelled(symbols, owner)
            out.append(ids)
            count[:] += np.bincount(owner, minlength=len(texts))
            np.add.at(done, [i for i, _ in held], np.diff(edges))

        size = 0
        for i, text in enumerate(texts):
            for part in stretches(text) if text else ():
                held.append((i, part))
                size += len(part)
                if size >= STEP_CHARS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), count

    def encode(self, text: str, key: int = 0) -> list[int]:
        """Ids of one text."""
        return self.encode_all([text], [key])[0].tolist()

    def decode(self, ids: np.ndarray) -> str:
        return joined(self.table, ids)


def joined(table: list[bytes], ids: np.ndarray) -> str:
    """The text of ids, without the space before it."""
    parts = (b"".join(map(table.__getitem__, ids[i : i + STEP_CHARS].tolist())) for i in range(0, len(ids), STEP_CHARS))
    return b"".join(parts)[1:].decode()


class Ranks:
    """The rank of each pair that makes a piece, as a hash table in numpy."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free, first = np.unique(slot[todo], return_index=True)
            put = todo[first[self.keys[free] == -1]]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = slot[todo] + 1 & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(STEP) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        """Ranks of pairs of symbols; NEVER where they make no piece."""
        keys = left.astype(np.int64) * width + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NEVER)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


def listed(data: np.ndarray, count: np.ndarray, nulls: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(data), mask=pa.array(nulls))


def encode(docs: DataFrame, coder: Coder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with piece_ids, the ids of each text.

    With dropout 0 the ids are the model's own; with dropout each candidate merge is skipped by a hash of the seed, the
    document's id and text, the unit's place and the candidate's, and the ids decode to the same text. A null text gives null
    ids, an empty one an empty array; equal rows give equal ids, and an empty table an empty one. Very long texts are taken in
    stretches; time grows with their length, but for units (words) of many thousand characters, which take n log n. Columns of docs
    with the name of the added one are replaced.
    """
    docs = free_of(docs, "piece_ids")
    (hidden,) = fresh(docs, "_lf_key")
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    shared = light(docs.sparkSession).sparkContext.broadcast({"parts": coder.parts})
    key = F.xxhash64(F.lit(29), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(shared.value)
        for batch in small(batches):
            texts, keys = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            ids, count = coder.encode_all(texts.to_pylist(), keys)
            out = listed(ids, count, texts.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "piece_ids"])

    return docs.withColumn(hidden, key).mapInArrow(run, with_fields(docs, piece_ids="array<int>"))


def decode(encoded: DataFrame, coder: Coder, ids_col: str = "piece_ids") -> DataFrame:
    """encoded with decoded, the text of the ids; null ids give null, an empty table gives an empty one."""
    encoded = free_of(encoded, "decoded")
    at = [c.lower() for c in encoded.columns].index(ids_col.lower())
    shared = light(encoded.sparkSession).sparkContext.broadcast(coder.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [joined(shared.value, x.values.to_numpy()) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, with_fields(encoded, decoded="string"))
