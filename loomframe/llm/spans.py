"""Base patterns for personal data and secrets, and the digests of their spans."""

from __future__ import annotations

import re
from hashlib import sha256

Span = tuple[int, int, str]  # start, end (exclusive), kind; in code points

EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def emails(text: str) -> list[Span]:
    """Leftmost matches: around each @, the longest local part not yet taken."""
    out, taken = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_REST.match(text, at) if start < at else None
        taken = found.end() if found else at + 1
        if found:
            out.append((start, taken, "email"))
        at = text.find("@", taken)
    return out


def ips(text: str) -> list[Span]:
    """Four dotted numbers at a time of each dotted run; those above 255 are dropped."""
    out = []
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        if len(parts) < 4:
            continue
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all((len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255) for p in parts[i : i + 4]):
                out.append((at, at + size, "ip"))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    return out


def phones(text: str) -> list[Span]:
    return [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


def assigns(text: str) -> list[Span]:
    """Found from the key words on, so a text without one is only searched for them."""
    low = text.translate(ASCII_LOWER) if not text.isascii() else text.lower()
    starts = set()
    for word in ASSIGN_WORDS:
        at = low.find(word)
        while at >= 0:
            starts.add(at)
            at = low.find(word, at + 1)
    out, taken = [], 0
    for at in sorted(starts):
        if at >= taken and (m := ASSIGN.match(text, at)):
            taken = m.end()
            if len(m[2]) >= 6:
                out.append((at, taken, "assign"))
    return out


def accesses(text: str) -> list[Span]:
    return [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]


def hexes(text: str) -> list[Span]:
    return [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def listed(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by kind as listed in kinds."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()
