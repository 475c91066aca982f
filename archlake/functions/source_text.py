"""Tokens and shingles of JavaScript/TypeScript text, inside Python workers.

Comments are dropped; string, number and regular-expression literals become one
placeholder each; words are lower-cased; any other non-blank character is a token.
A ``/`` after a value (letter, digit, ``_``, ``$``, ``)`` or ``]``, blanks between)
divides, else it opens a regular expression. Digits inside a word end it: ``foo2bar``
gives ``foo`` and a number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

# One alternative per lexical class. The division alternative stands where a value
# ends, so looking one character back is enough.
_STRING = "|".join(rf"{q}(?:\\(?s:.|\Z)|[^{q}\\])*(?:{q}|\Z)" for q in ('"', "'", "`"))
TOKEN = re.compile(
    r"(?:[^\W0-9]+|\$+)+"
    r"|//[^\n]*"
    r"|/\*(?s:.*?)\*/|/\*(?s:.*)(?=(?s:.)\Z)|/\*\Z"
    r"|(?<=[\w$)\]])\s*/(?![/*])"
    r"|/(?![/*])(?=(?s:.))(?:\\(?s:.|\Z)|\[(?:\\(?s:.|\Z)|[^\]\\])*(?:\]|\Z)|[^/\\\[\n])*(?:/[A-Za-z]*|\n|\Z)"
    rf"|{_STRING}"
    r"|[0-9][0-9A-Za-z._]*"
    r"|\S"
)
STR, NUM, REGEX = "__LITSTR__", "__LITNUM__", "__LITREGEX__"


def normal(raw: str) -> str | None:
    """The token of one raw match; None for a comment."""
    c = raw[0]
    if c in "\"'`":
        return STR
    if "0" <= c <= "9":
        return NUM
    if c == "/" and len(raw) > 1:
        return None if raw[1] in "/*" else REGEX
    if raw.isspace() or raw[-1] == "/":
        return "/"
    return raw.lower()


def tokens(text: str) -> list[str]:
    return [t for t in map(normal, TOKEN.findall(text)) if t is not None]


class _Hashes(dict):
    """raw match -> 64-bit hash of its token; 0 marks a comment."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 500_000:
            self.clear()
        t = normal(raw)
        h = 0 if t is None else xxhash.xxh64_intdigest(t) | 1
        if len(raw) < 64:
            self[raw] = h
        return h


_HASHES = _Hashes()
_A = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def batch_shingles(texts: Iterable[str], n: int = 4) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of all runs of ``n`` tokens; empty below ``n`` tokens."""
    parts = [np.fromiter(map(_HASHES.__getitem__, TOKEN.findall(t)), dtype=np.uint64) for t in texts]
    parts = [p[p != 0] for p in parts]
    sizes = [len(p) for p in parts]
    h = np.concatenate([*parts, np.zeros(n, np.uint64)])
    x = h[: len(h) - n].copy()
    for k in range(1, n):
        x *= _A
        x += h[k : len(h) - n + k]
    x = mix64(x)
    out, at = [], 0
    for size in sizes:
        run = x[at : at + max(0, size - n + 1)]
        at += size
        run = np.sort(run)
        out.append(run[np.concatenate([[True], run[1:] != run[:-1]])] if len(run) else run)
    return out


def shingles(text: str, n: int = 4) -> np.ndarray:
    return batch_shingles([text], n)[0]
