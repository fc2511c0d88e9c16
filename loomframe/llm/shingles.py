"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from loomframe.llm.common import Hasher, U, mix, steps

WORDS = 5


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The shingle set of each text, sorted: WORDS-word windows, or the whole sequence of a text with fewer words.

    ASCII capitals count as small letters; a text without words has the empty set.
    """
    hasher = Hasher(lower=True)
    for a, b in steps(texts):
        (h,), bounds = hasher.words(texts[a:b])
        grams = hasher.windows([h], WORDS)[0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= WORDS:
                yield np.unique(grams[lo : hi - WORDS + 1])
            elif hi > lo:
                yield mix((h[lo:hi] * (np.arange(1, hi - lo + 1, dtype=U) * U(2) + U(1))).sum(keepdims=True) + U(hi - lo))
            else:
                yield np.empty(0, U)


def signature(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix(mix(tokens + U(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=U) + U(len(tokens))).view(np.int64)[0])
