"""Garbled text from wrong character encoding (problem 8).

1. Count adjacent character pairs over the whole corpus, each distinct text once:
   copies of one garbled text would make its wrong pairs look usual.
2. Score every pair of a text by its contribution to the corpus' mutual
   information: pairs that contribute little are improbable and score above zero.
3. Maximum-scoring segments of these scores are the improbable runs.
4. Inside those runs alone, test the inverse of each wrong decoding. A
   reinterpretation stands if the pairs it makes are more probable than the ones
   it replaces.

Characters are counted by class, so the pair table has a proven size: characters
below U+0600 and the symbols of U+2000 to U+25FF stand for themselves, all others
for their block of 256, beyond U+FFFF for their plane. A text that only quotes garbled characters (a run closed
in quotation marks, or one or two letters standing alone) does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, SYM = 0x600, (0x2000, 0x2600)
CLASSES = LOW + (SYM[1] - SYM[0]) + 256 + 16
#: bits per pair of mutual information below which a pair is improbable
MASS = 2.0e-4
LEAST = float(np.log(0.01))
#: characters counted at a time
CHUNK = 1 << 20

# Single-byte decoders that are taken for UTF-8 readers in error, in the order tried.
WRONG_FOR_UTF8 = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-2", "cp1254", "cp1253", "mac_cyrillic")
# Fixed values: (decoder used, decoder meant) for texts that were not UTF-8.
LEGACY = (
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "cp1253"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp437", "cp1252"), ("cp437", "cp1250"),
    ("cp1251", "cp1252"), ("cp1250", "cp1251"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp850", "cp1252"), ("koi8-r", "cp1252"), ("cp1251", "cp1250"),
)
# Multi-byte encodings read as single bytes, and the reverse.
MULTI_AS_SINGLE = ("cp932", "euc_jp", "gb18030", "euc_kr", "big5")
UTF8_AS_MULTI = ("cp932", "gbk", "euc_kr", "big5", "euc_jp")
# Those of WRONG_FOR_UTF8 whose upper half is an alphabet, so that words of it hold valid sequences by chance.
ALPHABETS = ("cp1251", "koi8-r", "cp866", "cp1253", "mac_cyrillic")
QUOTES = "\"'`´‘’‚‛“”„‟«»‹›「」『』"


@cache
def class_table() -> np.ndarray:
    cp = np.arange(0x110000)
    out = LOW + (SYM[1] - SYM[0]) + np.where(cp < 0x10000, cp >> 8, 255 + (cp >> 16))
    out[:LOW] = cp[:LOW]
    out[SYM[0] : SYM[1]] = LOW + cp[: SYM[1] - SYM[0]]
    return out.astype(np.int32)


def classes(text: str) -> np.ndarray:
    return class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plain, rest = np.zeros(128 * 128, np.int64), {}

    def add(parts: list[np.ndarray]) -> None:
        codes = np.concatenate(parts)
        a, b = codes // CLASSES, codes % CLASSES
        low = (a < 128) & (b < 128)
        plain[:] += np.bincount(a[low] * 128 + b[low], minlength=128 * 128)
        for code, n in zip(*np.unique(codes[~low], return_counts=True)):
            rest[code] = rest.get(code, 0) + n

    parts, size = [], 0
    for x in batches:
        for text in x["text"]:
            for at in range(0, len(text), CHUNK):  # a piece begins with the last character of the one before
                c = classes(text[max(0, at - 1) : at + CHUNK])
                parts.append(c[:-1].astype(np.int64) * CLASSES + c[1:])
                size += len(c)
                if size > CHUNK:
                    add(parts)
                    parts, size = [], 0
    if parts:
        add(parts)
    seen = np.flatnonzero(plain)
    codes = np.concatenate([(seen // 128) * CLASSES + seen % 128, np.fromiter(rest, np.int64, len(rest))])
    yield pd.DataFrame({"code": codes, "n": np.concatenate([plain[seen], np.fromiter(rest.values(), np.int64, len(rest))])})


def pair_counts(documents: DataFrame) -> DataFrame:
    """code (first class * CLASSES + second), n over all distinct texts; at most CLASSES squared rows."""
    texts = documents.where("text is not null").select("text").distinct()
    return texts.mapInPandas(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class PairModel:
    """Scores and joint log-probabilities of the class pairs seen, sorted by code."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        a, b = codes // CLASSES, codes % CLASSES
        total = max(1.0, float(n.sum()))
        first, second = np.bincount(a, weights=n, minlength=CLASSES), np.bincount(b, weights=n, minlength=CLASSES)
        self.back = np.log((second + 0.01) / (total + 0.01 * CLASSES)).astype(np.float32)
        pmi = np.log2(np.maximum(n, 1) * total / (first[a] * second[b]))
        mass = n / total * np.maximum(pmi, 0.1)
        self.codes = np.sort(codes)
        order = np.argsort(codes)
        self.score = np.clip(np.log2(MASS) - np.log2(mass), -6, 6)[order].astype(np.float32)
        # joint log-probabilities: right text is many times as common as any one garbling of it
        chance = np.exp(self.back[a] + self.back[b])
        self.logp = np.log(n / total + 0.01 * chance)[order].astype(np.float32)

    def _find(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = c[:-1].astype(np.int64) * CLASSES + c[1:]
        at = np.minimum(np.searchsorted(self.codes, pair), max(0, len(self.codes) - 1))
        return at, self.codes[at] == pair if len(self.codes) else np.zeros(len(pair), bool)

    def scores(self, c: np.ndarray) -> np.ndarray:
        at, hit = self._find(c)
        out = np.where(hit, self.score[at], np.float32(6))
        plain = (c[:-1] < 128) & (c[1:] < 128)  # a wrong decoding always leaves characters beyond ASCII
        return np.where(plain, np.minimum(out, np.float32(-1)), out)

    def log_likelihood(self, text: str) -> float:
        c = classes(text)
        if len(c) < 2:
            return 0.0
        at, hit = self._find(c)
        return float(np.where(hit, self.logp[at], LEAST + self.back[c[:-1]] + self.back[c[1:]]).sum())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments (Ruzzo and Tompa), as half-open ranges with a sum above zero."""
    if not len(scores):
        return []
    positive = scores > 0
    cuts = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], cuts])
    sums = np.add.reduceat(scores.astype(np.float64), starts)
    ends = np.concatenate([cuts, [len(scores)]])
    stack: list[list] = []  # [start, end, left total, right total]
    total = 0.0
    for s, e, v in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if v <= 0:
            total += v
            continue
        new = [s, e, total, total + v]
        total += v
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(x[0], x[1]) for x in stack]


@cache
def byte_of(encoding: str) -> dict[str, int]:
    """Character to byte of a single-byte decoder; bytes it leaves undefined pass as C1 controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


@cache
def utf8_pattern(encoding: str) -> re.Pattern:
    """UTF-8 sequences as they look through a single-byte decoder."""
    m = byte_of(encoding)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in m.items() if lo <= b <= hi) + "]"
    t = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{t}|{cls(0xE0, 0xEF)}{t}{t}|{cls(0xF0, 0xF4)}{t}{t}{t}")


def _to_bytes(text: str, encoding: str) -> bytes | None:
    m = byte_of(encoding)
    out = bytearray()
    for c in text:
        b = ord(c) if c < "\x80" else m.get(c)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def _utf8_layer(text: str, encoding: str) -> str:
    def decode(m: re.Match) -> str:
        try:
            return bytes(byte_of(encoding)[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return utf8_pattern(encoding).sub(decode, text)


def _by_chance(run: str, encoding: str) -> bool:
    """Whether letters of an alphabet are left over: garbled text is a sequence throughout, a word of that alphabet isn't."""
    return encoding in ALPHABETS and any(c.isalpha() and c in byte_of(encoding) for c in utf8_pattern(encoding).sub("", run))


def _as_utf8(run: str) -> Iterator[str]:
    for enc in WRONG_FOR_UTF8:
        once = _utf8_layer(run, enc)
        if once != run and not _by_chance(run, enc):
            yield once
            twice = _utf8_layer(once, enc)
            if twice != once:
                yield twice
                yield _utf8_layer(twice, enc)
            elif enc != "cp1252" and (other := _utf8_layer(once, "cp1252")) != once:
                yield other
    if max(run) >= "\u2e80":  # read as multi-byte text; as the bytes must be UTF-8 throughout, a single letter is told
        for used in UTF8_AS_MULTI:
            try:
                text = run.encode(used).decode("utf-8")
            except UnicodeError:
                continue
            if text != run:
                yield text


def _as_multi(run: str) -> Iterator[str]:
    """Multi-byte text read as single bytes, and UTF-8 read as multi-byte text; single bytes of a run may be ASCII."""
    raw = _to_bytes(run, "cp1252")
    if raw is not None:
        for meant in MULTI_AS_SINGLE:
            text = raw.decode(meant, "replace")
            if text.count("�") * 10 <= len(text):
                yield text
        return
    for used in UTF8_AS_MULTI:
        text = run.encode(used, "replace").decode("utf-8", "replace")
        good = sum(c > "\x7f" and c != "�" for c in text)
        if good >= 2 * text.count("�"):
            yield text


def is_example(text: str, start: int, end: int, restored: str) -> bool:
    """Whether the garbled characters are quoted: closed in quotation marks, or one or two letters standing alone."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if before and after and before in QUOTES and after in QUOTES:
        return True
    run = text[start:end]
    if len(run) > 2 and run[0] in QUOTES and run[-1] in QUOTES and restored[:1] == run[0] and restored[-1:] == run[-1]:
        return True  # the marks themselves came through unharmed
    alone = not before.isalnum() and not after.isalnum()
    return alone and len(restored) <= 2 and restored.isalpha()


ISLAND = re.compile(r"[^\x00-\x7f]+")


class Restorer:
    """Tests inverse decodings inside the improbable runs of a text.

    ``gain`` is the least improvement in log-likelihood; where validity proves
    little (single-byte and multi-byte encodings other than UTF-8) it is asked of
    every changed character, and ``proof`` of the whole line.
    """

    def __init__(self, model: PairModel, gain: float = 1.0, proof: float = 5.0):
        self.model, self.gain, self.proof = model, gain, proof
        # the same words come again and again
        self._utf8 = lru_cache(maxsize=50_000)(self._utf8)
        self._legacy = lru_cache(maxsize=50_000)(self._legacy)

    def _utf8(self, left: str, run: str, right: str) -> str | None:
        best, most = None, self.gain
        now = self.model.log_likelihood(left + run + right)
        for new in _as_utf8(run):
            if (g := self.model.log_likelihood(left + new + right) - now) > most:
                best, most = new, g
        return best

    def _legacy(self, left: str, run: str, right: str) -> tuple[np.ndarray, list[str], np.ndarray] | None:
        """Gain, text and letters changed under every pair of LEGACY; None for blanks alone."""
        if run.isspace():
            return None
        now = self.model.log_likelihood(left + run + right)
        gains, texts = np.zeros(len(LEGACY)), []
        for i, (used, meant) in enumerate(LEGACY):
            raw = _to_bytes(run, used)
            texts.append(raw.decode(meant, "replace") if raw is not None else run)
            if texts[i] != run:
                gains[i] = self.model.log_likelihood(left + texts[i] + right) - now
        return gains, texts, np.array([len(run) * (t != run) for t in texts])

    def restore(self, text: str) -> tuple[str, int, int]:
        """The restored text, and the numbers of garbled places that are no examples: restored and lost."""
        if text.isascii():
            return text, 0, 0
        lost = sum(not is_example(text, m.start(), m.end(), "�") for m in re.finditer("�+", text))
        runs = maximal_segments(self.model.scores(classes(text)))
        changes: list[tuple[int, int, str]] = []
        examples: list[tuple[int, int, str]] = []
        lines: dict[int, list[tuple[int, int]]] = {}
        k, line, seen = 0, 0, 0
        for m in ISLAND.finditer(text):
            start, end = m.span()
            while k < len(runs) and runs[k][1] < start:
                k += 1
            if k == len(runs) or runs[k][0] > end:
                continue
            new = self._utf8(text[start - 1 : start], m.group(), text[end : end + 1])
            if new is not None:
                (examples if is_example(text, start, end, new) else changes).append((start, end, new))
                continue
            line += text.count("\n", seen, start)
            seen = start
            lines.setdefault(line, []).append((start, end))
        for islands in lines.values():
            changes += self._line(text, islands)
        if changes:  # beside garbled words, letters that stand alone are no examples
            changes += [x for x in examples if text[x[0] - 1 : x[0]] not in QUOTES and text[x[0]] not in QUOTES]
        out, at = [], 0
        for start, end, new in sorted(changes):
            if start >= at:
                out += [text[at:start], new]
                at = end
        out.append(text[at:])
        return "".join(out), len(changes), lost

    def _line(self, text: str, islands: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """One legacy decoding for all islands of a line, or a multi-byte one for the stretch they span."""
        tests = [(s, e, self._legacy(text[s - 1 : s], text[s:e], text[e : e + 1])) for s, e in islands]
        tests = [t for t in tests if t[2] is not None]
        if not tests:
            return []
        best: list[tuple[int, int, str]] = []
        most = self.proof
        total, letters = sum(x[0] for _, _, x in tests), sum(x[2] for _, _, x in tests)
        for i in np.argsort(-total):
            if total[i] <= self.proof:
                break
            if total[i] > self.gain * letters[i]:
                changed = [(s, e, x[1][i]) for s, e, x in tests if x[1][i] != text[s:e]]
                if not all(is_example(text, *c) for c in changed):
                    best, most = changed, float(total[i])
                    break
        start, end = islands[0][0], islands[-1][1]
        if end - start >= 4 and any("\x80" <= c <= "\x9f" or c >= "\u2e80" for c in text[start:end]):
            for stop in (end, min(end + 1, len(text))):  # the last character's second byte may be ASCII
                run, left, right = text[start:stop], text[start - 1 : start], text[stop : stop + 1]
                now = self.model.log_likelihood(left + run + right)
                for new in _as_multi(run):
                    letters = sum(c > "\x7f" for c in new)
                    g = self.model.log_likelihood(left + new + right) - now
                    if letters >= 3 and new != run and g > max(most, self.gain * letters):
                        best, most = [(start, stop, new)], g
        return best


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, text (restored as far as possible), places_restored and places_lost of every affected document.

    Null ids are kept, null and ASCII texts are never affected; an empty table gives
    no rows. The pair table is collected: at most CLASSES squared rows (the alphabet
    squared, whatever the corpus), in practice some ten thousand.
    """
    spark = documents.sparkSession
    counts = pair_counts(documents).toPandas().sort_values("code")
    model = spark.sparkContext.broadcast((counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(PairModel(*model.value))
        for x in batches:
            rows = []
            for d, text in zip(x["doc_id"], x["text"]):
                new, fixed, lost = restorer.restore(text)
                if fixed or lost:
                    rows.append((d, new, fixed, lost))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "places_restored", "places_lost"])

    texts = documents.where(r"text is not null and text rlike '[^\\x00-\\x7F]'").select("doc_id", "text")
    return texts.mapInPandas(run, "doc_id long, text string, places_restored int, places_lost int")
