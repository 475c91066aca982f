"""Generated, minified, vendored source files and data saved as code (problem 5).

Models of names are trained per language on all distinct texts, so that the copies
of one file count once, in the medians as well: character trigrams of identifiers,
and naming styles (the word or sign before a name, its casing, its length class),
each language's own with those of all behind it. A file is flagged if

- its names are mangled: their cross-entropy under the trigram model is far above
  that of the median file (minified and bundled code);
- its naming style is foreign: the cross-entropy of its styles is far above the
  median (third-party code, written to other conventions). The styles are those of
  the more usual half of the texts, so that even much foreign code doesn't teach
  the model its own style;
- its names follow a template: the token shapes around its names keep repeating,
  within a window or, where the repeated unit is long, over the whole file
  (emitted code, tables of records);
- it hardly has names for its size (data saved as code).

Paths and header comments are not looked at: hand-written files may mention
generators or lie in a vendor folder, and generated ones may lie anywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.functions.paths import extension
from archlake.functions.source_text import TOKEN
from archlake.session import Scratch

LANGUAGES = ("js", "ts")
#: Reserved and contextual words of the language; they are syntax, not names.
KEYWORDS = (
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export "
    "extends false finally for from function get if implements import in instanceof interface is keyof let module namespace never new "
    "null number object of package private protected public readonly require return set static string super switch symbol this throw "
    "true try type typeof undefined unknown var void while with yield"
).split()
PUNCTUATION = "(){}[];,.:?=<>+-*/%!&|^~@#"
STR, NUM, REGEX, NAME, OTHER = 1, 2, 3, 4, 5
SHAPES = {w: 8 + i for i, w in enumerate([*KEYWORDS, *PUNCTUATION])}
CASES = 32  # casing (0..7) and length class (0..3)
SYMBOLS = 57
GRAM, WINDOW = 8, 384
#: the least that usual text keeps of its distinct runs per run when it gets twice as long
DECAY = 0.8
_LETTERS = np.full(256, 56, np.int64)
for _i in range(26):
    _LETTERS[97 + _i], _LETTERS[65 + _i] = 1 + _i, 27 + _i
_LETTERS[48:58], _LETTERS[95], _LETTERS[36], _LETTERS[0] = 53, 54, 55, 0
_CASING = re.compile(r"([a-z][a-z0-9]*)|([a-z][A-Za-z0-9]*)|([A-Z][A-Z0-9_]*)|([A-Z][A-Za-z0-9]*)|([a-z][a-z0-9_]*)|([_$][\w$]*)")


class _Codes(dict):
    """raw match -> shape, and for names casing and length class above it; 0 for a comment."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 500_000:
            self.clear()
        c = raw[0]
        if c in "\"'`":
            code = STR
        elif "0" <= c <= "9":
            code = NUM
        elif c == "/" and len(raw) > 1 and raw.strip() != "/":
            code = 0 if raw[1] in "/*" else REGEX
        elif raw in SHAPES:
            code = SHAPES[raw]
        elif c.isalpha() or c in "_$":
            m = _CASING.fullmatch(raw)
            n = len(raw)
            code = NAME + 256 * (1 + 4 * (m.lastindex if m else 0) + (0 if n < 2 else 1 if n < 3 else 2 if n < 5 else 3))
        else:
            code = SHAPES.get(raw.strip(), OTHER)
        if len(raw) < 48:
            self[raw] = code
        return code


_CODES = _Codes()


class Lexed:
    """The names and token codes of a batch of texts."""

    def __init__(self, texts: list[str]):
        raws = [TOKEN.findall(t) for t in texts]
        parts = [np.fromiter(map(_CODES.__getitem__, r), np.int64, len(r)) for r in raws]
        self.names: list[list[str]] = []
        for r, p in zip(raws, parts):
            self.names.append([r[i] for i in np.flatnonzero(p > 255)])
        parts = [p[p != 0] for p in parts]
        self.sizes = np.array([len(p) for p in parts])
        self.codes = np.concatenate([*parts, np.zeros(0, np.int64)])
        self.file = np.repeat(np.arange(len(texts)), self.sizes)

    def styles(self) -> tuple[np.ndarray, np.ndarray]:
        """file, style of every name: what stands before it, its casing and its length class."""
        shape = self.codes & 255
        before = np.concatenate([[0], shape[:-1]])
        before[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])[self.sizes > 0]] = 0
        at = self.codes > 255
        return self.file[at], before[at] * CASES + (self.codes[at] >> 8) - 1

    def diversity(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs of GRAM token shapes per run, over windows of WINDOW runs and over the whole file, and the
        binary logarithm of the number of runs; 1, 1 and -1 for files without a run."""
        shape = (self.codes & 255).astype(np.uint64)
        out, whole, length = np.ones(len(self.sizes)), np.ones(len(self.sizes)), np.full(len(self.sizes), -1)
        if len(shape) < GRAM:
            return out, whole, length
        x = shape[: len(shape) - GRAM + 1].copy()
        for k in range(1, GRAM):
            x = x * np.uint64(0x9E3779B97F4A7C15) + shape[k : len(shape) - GRAM + 1 + k]
        at = 0
        for i, n in enumerate(self.sizes):
            runs = n - GRAM + 1
            if runs > 0:
                kept = sum(len(np.unique(x[at + j : at + min(j + WINDOW, runs)])) for j in range(0, runs, WINDOW))
                out[i] = kept / runs
                whole[i] = len(np.unique(x[at : at + runs])) / runs
                length[i] = int(runs).bit_length() - 1
            at += n
        return out, whole, length


def trigrams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character trigrams of all names, ends included, and the number of each name's trigrams."""
    c = _LETTERS[np.frombuffer(("\0\0" + "\0\0".join(names) + "\0\0").encode("latin-1", "replace"), np.uint8)]
    lengths = np.fromiter(map(len, names), np.int64, len(names)) + 1
    tri = (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]
    gap = np.cumsum(lengths + 1) - 1  # a trigram that begins on a name's last end belongs to no name
    keep = np.ones(len(tri), bool)
    keep[gap[gap < len(tri)]] = False
    return tri[keep], lengths


LEXED = "text_id string, language int, names string, name_times array<int>, styles array<int>, times array<int>, diversity double, whole double, length int, chars_per_name double"


def _lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every text its distinct names (a line each) and styles, how often it has each, and its diversity."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            x = batch.iloc[at : at + 256]
            lexed = Lexed(list(x["content"]))
            names = [Counter(own) for own in lexed.names]
            file, codes = lexed.styles()
            held, times = np.unique(file * (256 * CASES) + codes, return_counts=True)
            cuts = np.searchsorted(held, np.arange(1, len(x)) * (256 * CASES))
            diversity, whole, length = lexed.diversity()
            yield pd.DataFrame(
                {
                    "text_id": x["text_id"].to_numpy(), "language": x["language"].to_numpy(), "names": ["\n".join(own) for own in names], "name_times": [np.fromiter(own.values(), np.int32, len(own)) for own in names],
                    "styles": np.split((held % (256 * CASES)).astype(np.int32), cuts), "times": np.split(times.astype(np.int32), cuts), "diversity": diversity, "whole": whole, "length": length,
                    "chars_per_name": x["content"].str.len().to_numpy() / np.maximum([len(own) for own in names], 1),
                }
            )


def _names(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character trigrams of all distinct names of the texts, and the number of each name's trigrams."""
    held = [n for n in x["names"] if n]
    return trigrams("\n".join(held).split("\n")) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _flat(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64)


def _by_language(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    for x in batches:
        for at in range(0, len(x), 1024):
            for language, group in x.iloc[at : at + 1024].groupby("language"):
                yield int(language), group


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tri = np.zeros((len(LANGUAGES), SYMBOLS**3), np.int64)
    style = np.zeros((len(LANGUAGES), 256 * CASES), np.int64)
    for language, x in _by_language(batches):  # names and styles once per file
        tri[language] += np.bincount(_names(x)[0], minlength=SYMBOLS**3)
        style[language] += np.bincount(_flat(x["styles"]), minlength=256 * CASES)
    for kind, counts in ((0, tri), (1, style)):
        for language in range(len(LANGUAGES)):
            codes = np.flatnonzero(counts[language])
            yield pd.DataFrame({"kind": kind, "language": language, "code": codes, "n": counts[language][codes]})


def _weights(model: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per language, the bits of every trigram given its first two characters, and those of every style."""
    tris, styles = [], []
    for language in range(len(LANGUAGES)):
        own = model[model["language"] == language]
        t, s = np.zeros(SYMBOLS**3), np.zeros(256 * CASES)
        t[own.loc[own["kind"] == 0, "code"]] = own.loc[own["kind"] == 0, "n"]
        s[own.loc[own["kind"] == 1, "code"]] = own.loc[own["kind"] == 1, "n"]
        t = t.reshape(SYMBOLS**2, SYMBOLS)
        tris.append(-np.log2((t + 0.05) / (t.sum(axis=1, keepdims=True) + 0.05 * SYMBOLS)).ravel())
        styles.append(s)
    return tris, _style_bits(styles)


def _style_bits(counts: list[np.ndarray]) -> list[np.ndarray]:
    """Bits of every style per language. Conventions are shared in part: the styles of all languages stand behind each
    one's own with the weight of as many names, so a language with few files has a model as well."""
    pooled = sum(counts)
    pooled = (pooled + 0.1) / (pooled.sum() + 0.1 * len(pooled))
    out = []
    for c in counts:
        weight = max(1.0, float(c.sum()))
        out.append(-np.log2((c + weight * pooled) / (c.sum() + weight)))
    return out


def source_texts(files: DataFrame) -> DataFrame:
    """file_id, language (index into LANGUAGES, by the path's extension; js where unknown), content of files that have both id and content."""
    return files.where("file_id is not null and content is not null").select(
        "file_id", F.coalesce(extension("path").isin("ts", "tsx", "mts", "cts").cast("int"), F.lit(0)).alias("language"), "content"
    )


def _text_id() -> Column:
    return F.concat_ws(":", "language", F.md5("content"))


def name_models(lexed: DataFrame) -> DataFrame:
    """kind (0 trigram, 1 style), language, code, n over all texts (language, names, styles): at most (SYMBOLS cubed + 256 CASES) rows a language."""
    counts = lexed.select("language", "names", "styles").mapInPandas(_train, "kind int, language int, code long, n long")
    return counts.groupBy("kind", "language", "code").agg(F.sum("n").alias("n"))


def name_features(files: DataFrame) -> DataFrame:
    """text_id (_text_id), mangling and style (bits), diversity (in windows), whole (diversity), length (class), chars_per_name
    of every distinct text.

    The models are collected: their size is bounded by their alphabet. Texts are
    lexed once; models are trained and texts are scored from the distinct names and
    styles that are kept of each.
    """
    scratch = Scratch(files.sparkSession, "names")
    texts = source_texts(files).select("language", "content").distinct().withColumn("text_id", _text_id())
    lexed = scratch.write(texts.mapInPandas(_lex, LEXED), "lexed")
    model = files.sparkSession.sparkContext.broadcast(name_models(lexed).toPandas())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tris, styles = _weights(model.value)
        for language, x in _by_language(batches):
            n = len(x)
            tri, lengths = _names(x)
            owner = np.repeat(np.repeat(np.arange(n), x["name_times"].str.len().to_numpy(np.int64)), lengths)
            often = np.repeat(_flat(x["name_times"]), lengths)
            bits = np.bincount(owner, weights=tris[language][tri] * often, minlength=n) / np.maximum(np.bincount(owner, weights=often, minlength=n), 1)
            file, times = np.repeat(np.arange(n), x["styles"].str.len().to_numpy(np.int64)), _flat(x["times"])
            style = np.bincount(file, weights=styles[language][_flat(x["styles"])] * times, minlength=n) / np.maximum(np.bincount(file, weights=times, minlength=n), 1)
            yield x.assign(mangling=bits, style=style)[["text_id", "language", "mangling", "style", "diversity", "whole", "length", "chars_per_name", "styles", "times"]]

    columns = "text_id string, language int, mangling double, style double, diversity double, whole double, length int, chars_per_name double"
    scored = scratch.write(lexed.mapInPandas(score, columns + ", styles array<int>, times array<int>"), "scored")
    scratch.drop(lexed)
    usual = scored.crossJoin(F.broadcast(scored.agg(F.percentile_approx("style", 0.5).alias("middle")))).where("style <= middle")  # one row
    counts = usual.select("language", F.explode("styles").alias("code")).groupBy("language", "code").agg(F.count(F.lit(1)).alias("n")).toPandas()
    tables = [np.zeros(256 * CASES) for _ in LANGUAGES]
    for language, table in enumerate(tables):
        rows = counts[counts["language"] == language]
        table[rows["code"]] = rows["n"]
    own = files.sparkSession.sparkContext.broadcast(np.stack(_style_bits(tables)))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sizes = x["styles"].str.len().to_numpy(np.int64)
            file = np.repeat(np.arange(len(x)), sizes)
            language = x["language"].to_numpy(np.int64)[file]
            codes, times = _flat(x["styles"]), _flat(x["times"])
            style = np.bincount(file, weights=own.value[language, codes] * times, minlength=len(x)) / np.maximum(np.bincount(file, weights=times, minlength=len(x)), 1)
            yield x.assign(style=style)[["text_id", "language", "mangling", "style", "diversity", "whole", "length", "chars_per_name"]]

    return scratch.write(scored.mapInPandas(again, columns), "features")


def usual_diversity(rows: list[tuple[int, int, float]]) -> dict[int, float]:
    """Length class -> the whole-file diversity usual for it, from (class, texts, median) of the classes there are.

    Long files may be emitted for the most part, so the medians are held to a
    course that begins at the class with most texts: with every doubling diversity
    falls, but to no less than DECAY of what it was.
    """
    found = {k: m for k, _, m in rows}
    if not found:
        return {}
    start = max(rows, key=lambda r: (r[1], -r[0]))[0]
    usual = {start: found[start]}
    for k in range(start + 1, max(found) + 1):
        usual[k] = min(max(found.get(k, 0.0), DECAY * usual[k - 1]), usual[k - 1])
    for k in range(start - 1, min(found) - 1, -1):
        usual[k] = min(max(found.get(k, 0.0), usual[k + 1]), usual[k + 1] / DECAY, 1.0)
    return usual


def not_hand_written(
    files: DataFrame, mangled: float = 0.5, foreign: float = 1.5, template: float = 0.35, sparse: float = 5.0
) -> DataFrame:
    """file_id and four flags (mangled, foreign, template, sparse) of every file with at least one of them.

    ``mangled`` and ``foreign`` are bits above the median text, ``template`` is the
    largest diversity relative to the median, or that of the whole file relative to
    what is usual at its length, ``sparse`` the least characters per
    name relative to it. Medians are over distinct texts, flags are given to every copy. Files without id or content are left out; a file without
    names (an empty one, or comments alone) is flagged only if it holds anything
    but blanks at that size; repeated file ids give one row.
    """
    features = name_features(files)
    middle = features.select(*[F.percentile_approx(c, 0.5).alias(f"m_{c}") for c in ("mangling", "style", "diversity", "chars_per_name")])
    classes = features.where("length >= 0").groupBy("length").agg(F.count(F.lit(1)), F.percentile_approx("whole", 0.5)).collect()  # a row per class
    usual = files.sparkSession.createDataFrame(list(usual_diversity([tuple(r) for r in classes]).items()), "length int, usual double")
    flags = features.join(F.broadcast(usual), "length", "left").crossJoin(F.broadcast(middle)).select(  # one row of medians
        "text_id",
        (F.col("mangling") > F.col("m_mangling") + mangled).alias("mangled"),
        (F.col("style") > F.col("m_style") + foreign).alias("foreign"),
        ((F.col("diversity") < F.col("m_diversity") * template) | F.coalesce(F.col("whole") < F.col("usual") * template, F.lit(False))).alias("template"),
        (F.col("chars_per_name") > F.col("m_chars_per_name") * sparse).alias("sparse"),
    )
    flagged = flags.where("mangled or foreign or template or sparse")
    rows = source_texts(files).select("file_id", _text_id().alias("text_id")).join(flagged, "text_id")
    return rows.groupBy("file_id").agg(*[F.bool_or(c).alias(c) for c in ("mangled", "foreign", "template", "sparse")])
