"""Training-data operators: oracles, brute force, held-out accuracy, and awkward tables."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from archlake.functions.source_text import tokens
from archlake.llm import components, encoding, generated, leakage, mixing, queries
from archlake.llm.neardup import NearDuplicates, bands, least_matches
from tests.helpers import DATA, assert_same


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k in queries.ORACLES])
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


# --- 1: groups ---------------------------------------------------------------------------------

REPORTS = "report_id long, snapshot_id long, threshold float, root string"
PAIRS = "report_id long, file_a string, file_b string, similarity float, v string, path string"


def test_groups(spark):
    reports = spark.createDataFrame([(1, 1, None, "r"), (2, 2, 0.8, "r"), (3, 3, 0.5, None)], REPORTS)
    chain = [(1, f"c{i:03d}", f"c{i + 1:03d}", 0.6, "v", "p") for i in range(120)]
    hub = [(3, "hub", f"s{i:03d}", 0.5, None, None) for i in range(300)]
    odd = [
        (1, "x", "x", 1.0, None, None), (1, "n", None, 1.0, None, None), (1, "a", "b", None, None, None), (1, "a", "b", float("nan"), None, None), (1, "lo", "w", 0.59, None, None),
        (2, "./p//q", "p\\r", 0.9, None, None), (2, "p/r", "p/q", 0.1, None, None), (2, "p/q", "z", 0.79, None, None), (9, "u", "w", 1.0, None, None), (None, "u", "w", 1.0, None, None),
    ]
    pairs = spark.createDataFrame(chain + hub + odd + chain[:5], PAIRS)
    got = {tuple(r) for r in components.file_groups(reports, pairs).collect()}
    want = {(1, f"c{i:03d}", "c000") for i in range(121)} | {(3, f"s{i:03d}", "hub") for i in range(300)} | {(3, "hub", "hub"), (2, "p/q", "p/q"), (2, "p/r", "p/q")}
    assert got == want
    assert components.file_groups(reports, pairs.limit(0)).count() == 0 and components.file_groups(reports.limit(0), pairs).count() == 0


@pytest.mark.parametrize("beta", [0.1, 0.3, 2.0])
def test_decomposition_is_exact(spark, beta):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 3), (4, None)]
    low = {v: v for l in links if None not in l for v in l}
    for _ in range(300):
        for a, b in links:
            if a is not None and b is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r["v"]: r["root"] for r in components.connected_groups(spark.createDataFrame(links, "a long, b long"), beta).collect()}
    linked = {v for l in links if None not in l and l[0] != l[1] for v in l}
    assert set(got) == linked
    assert {frozenset(v for v in got if got[v] == r) for r in got.values()} == {frozenset(v for v in linked if low[v] == x) for x in {low[v] for v in linked}}


def test_giant_group_is_split(spark):
    """A hub with most links, a chain and pairs; every join of the last step sees its hot partition split."""
    links = [(0, i) for i in range(1, 9000)] + [(10_000 + i, 10_001 + i) for i in range(100)] + [(20_000 + 2 * i, 20_001 + 2 * i) for i in range(400)]
    want = {**{i: 0 for i in range(9000)}, **{10_000 + i: 10_000 for i in range(101)}, **{20_000 + i: 20_000 + i // 2 * 2 for i in range(800)}}
    reports = spark.createDataFrame([(1, 1, 0.5, "r")], REPORTS)
    pairs = spark.createDataFrame([(1, f"{a:06d}", f"{b:06d}", 0.9, None, None) for a, b in links], PAIRS)
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        joined = components.file_groups(reports, pairs)
        got = {int(r["path"]): int(r["group_path"]) for r in joined.collect()}
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert got == want
    assert "skew=true" in plan


@pytest.mark.parametrize("hot", [50, 5000])
def test_hot_record_is_split(spark, hot):
    """The links of a record above the bound travel in shards; the groups stay the same."""
    links = [(0, i) for i in range(1, 600)] + [(i, 700 + i) for i in range(1, 600, 7)] + [(5000, 5001)]
    frame = spark.createDataFrame(links, "a long, b long")
    assert (components._shards(frame.select(F.col("a").alias("v"), F.col("b").alias("to")), len(links), hot) is not None) == (hot == 50)
    got = {r["v"]: r["root"] for r in components.connected_groups(frame, hot=hot).collect()}
    assert len(got) == len({v for l in links for v in l}) and len({got[v] for v in got if v < 5000}) == 1 and got[5000] == got[5001] != got[0]


# --- 2: near duplicates --------------------------------------------------------------------------


def near_copies(rng, n):
    out = []
    for i in range(n):
        base = [f"w{rng.randrange(900)}" for _ in range(80)]
        for _ in range(4):
            c = list(base)
            for _ in range(rng.randrange(9)):
                c[rng.randrange(80)] = f"z{rng.randrange(900)}"
            out.append(" ".join(c))
    return out


@pytest.mark.parametrize("hot", [400, 2])
def test_near_duplicates(spark, hot):
    """Equal to brute force, with and without buckets declared hot; copies are one class and still all come out."""
    rng = random.Random(3)
    texts = near_copies(rng, 20)
    texts += [texts[0]] * 6 + [None, "", "a b c", "x " * 30_000]
    rows = [(i, 1 + i % 3, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, 1, texts[0], "", ""), (900, None, texts[0], "", ""), (3, 1, texts[3], "", "")]
    files = spark.createDataFrame(rows, "file_id long, report_id long, content string, threshold string, rep string")
    reports = spark.createDataFrame([(1, 1, None, ""), (2, 1, 0.7, ""), (3, 1, 0.8, "")], REPORTS)
    limit = {1: np.float32(0.6), 2: np.float32(0.7), 3: np.float32(0.8)}
    sets = {}
    for i, _, t, *_ in rows[: len(texts)]:
        if t:
            w = tokens(t)
            sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    want = set()
    for i in sets:
        for j in sets:
            if j < i and i % 3 == j % 3 and sets[i] and sets[j] and np.float32(len(sets[i] & sets[j])) / np.float32(len(sets[i] | sets[j])) >= limit[1 + i % 3]:
                want.add((j, i))
    found = NearDuplicates(reports, files, hot_bucket=hot)
    got = [tuple(r) for r in found.expanded().distinct().collect()]
    assert set(got) == want and len(want) > 40
    assert NearDuplicates(reports, files.limit(0)).expanded().count() == 0


def test_parameters_of_verification():
    for t in (0.1, 0.5, 0.6, 0.8, 1.0):
        r, n = bands(t, 0.001)
        assert (1 - min(t, 0.999) ** r) ** n <= 0.001
    assert least_matches(0.6, 0.001) == sorted(least_matches(0.6, 0.001)) and least_matches(0.6, 0.001)[-1] < 0.6 * 128


# --- 5: not hand-written ---------------------------------------------------------------------------


def test_generated_held_out(spark):
    """The flags against file kinds told apart by their text, which the operator does not look for."""
    kinds = re.compile(r"root\.\w+ = factory\(\)|\.prototype\.\w+=function\(|=> request\('|Scalars\['|\.getField\(")
    files = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/source_files.parquet")
    flagged = {r["file_id"] for r in generated.not_hand_written(files).collect()}
    rows = files.select("file_id", "content").collect()
    sure = {r["file_id"] for r in rows if kinds.search(r["content"])}
    own = {r["file_id"] for r in rows if re.search(r"\} from '(\.|@core)", r["content"]) and re.search(r"export (async )?(function|class)|const \w+ = (async )?\(", r["content"])}
    assert len(flagged & sure) >= 0.98 * len(sure) and len(flagged & own - sure) <= 0.01 * len(own)


def test_generated_when_common(spark):
    """Foreign code stays foreign where it makes up a third of all files."""
    files = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/source_files.parquet")
    foreign = files.where(F.col("content").contains("root.") & F.col("content").contains("= factory()"))
    own = files.where("content rlike \"[}] from '(\\\\.|@core)\"")
    n, m = foreign.count(), own.count()
    copies = foreign.join(spark.range(max(1, m // (2 * n))), how="cross").withColumn("file_id", F.col("file_id") + F.lit(10**9) * (F.col("id") + 1)).drop("id")
    flagged = {r["file_id"] for r in generated.not_hand_written(own.unionByName(copies)).collect()}
    want = {r["file_id"] for r in copies.select("file_id").collect()}
    assert len(want) > 0.25 * (m + len(want))
    assert len(want - flagged) <= 0.02 * len(want) and len(flagged - want) <= 0.01 * m


@pytest.mark.parametrize("mark", ["= factory()", ".prototype."])
def test_copies_of_one_generated_file(spark, mark):
    """A vendored and a minified file keep their flags where their copies hold a third of the rows, and so do the others."""
    files = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/source_files.parquet")
    before = {tuple(r) for r in generated.not_hand_written(files).collect()}
    one = files.where(F.col("content").contains(mark)).orderBy("file_id").limit(1)
    n = files.count() // 2
    copies = one.crossJoin(spark.range(n)).withColumn("file_id", F.lit(10**9) + F.col("id")).drop("id")
    got = {tuple(r) for r in generated.not_hand_written(files.unionByName(copies)).collect()}
    own = {r[1:] for r in before if r[0] == one.first()["file_id"]}
    assert len(own) == 1 and {r for r in got if r[0] < 10**9} == before
    assert {r for r in got if r[0] >= 10**9} == {(10**9 + i, *own.copy().pop()) for i in range(n)}


def test_long_repeated_unit(spark):
    """A file that repeats one varied unit longer than a window's share is a template; a varied file of its length is not."""
    rng = random.Random(5)
    word = lambda: rng.choice(["load", "save", "open", "close"]) + rng.choice(["Table", "Window", "Record"])

    def value(depth=0):
        kind = rng.randrange(4 if depth < 3 else 1)
        if kind == 1:
            return f"{value(depth + 1)} {rng.choice('+ - * / % && || ?? < > === |'.split())} {value(depth + 1)}"
        if kind == 2:
            return f"{word()}({', '.join(value(depth + 1) for _ in range(rng.randrange(4)))})"
        return rng.choice([f"{word()}.{word()}", word(), str(rng.randrange(9)), f"'{word()}'", f"[{word()}]", "null", f"!{word()}"]) if kind == 0 else f"({word()}) => {value(depth + 1)}"

    line = lambda: rng.choice(["const {} = {};", "if ({1}) {{ {0}(); }}", "return {1};", "{}[0] = {};", "await {}({});", "for (const {} of {}) {{"]).format(word(), value())
    text = lambda n: "\n".join(line() for _ in range(n))
    own = [(i, f"src/f{i}.ts", text(rng.randrange(15, 60))) for i in range(80)] + [(80, "src/long.ts", text(1200))]
    unit = text(30)
    rename = lambda: re.sub(r"(load|save|open|close)(Table|Window|Record)", lambda m: word(), unit)
    repeated = [(90 + i, f"src/r{i}.ts", "\n".join(rename() for _ in range(n))) for i, n in enumerate((40, 400))]
    files = spark.createDataFrame(own + repeated, "file_id long, path string, content string")
    assert generated.Lexed([repeated[0][2]]).diversity()[0] > 0.35
    got = {r["file_id"] for r in generated.not_hand_written(files).where("template").collect()}
    assert got == {90, 91}
    assert generated.usual_diversity([]) == {} and generated.usual_diversity([(7, 9, 0.8), (9, 1, 0.1), (5, 1, 0.1)]) == pytest.approx({5: 0.8, 6: 0.8, 7: 0.8, 8: 0.64, 9: 0.512})


def test_models_of_texts_that_are_read_once():
    """Lexing keeps all that training needs: once per file its distinct names and styles; texts without names are rows like others."""
    texts = pd.DataFrame({"text_id": list("abcd"), "language": [0, 1, 0, 1], "content": ["let ab = ab + cd; ab()", "1 + 2", "", "let ab = 1"]})
    (lexed,) = generated._lex(iter([texts]))
    assert [dict(zip(n.split("\n"), t)) if n else {} for n, t in zip(lexed["names"], lexed["name_times"])] == [{"ab": 3, "cd": 1}, {}, {}, {"ab": 1}]
    model = pd.concat(generated._train(iter([lexed])))
    for language, names, styles in ((0, ["ab", "cd"], 4), (1, ["ab"], 1)):
        own = model[model["language"] == language]
        want = np.unique(generated.trigrams(names)[0], return_counts=True)
        assert [tuple(own.loc[own["kind"] == 0, c]) for c in ("code", "n")] == [tuple(w) for w in want]
        assert own.loc[own["kind"] == 1, "n"].sum() == styles


def test_language_without_names(spark):
    """A collection whose only files of one language hold no name."""
    rows = [(i, f"a{i}.js", f"const total{i} = first + second;") for i in range(8)] + [(8, "data.ts", "[" + "1, " * 400 + "1]"), (9, "none.ts", "")]
    files = spark.createDataFrame(rows, "file_id long, path string, content string")
    assert 8 in {r["file_id"] for r in generated.not_hand_written(files).where("sparse").collect()}


def test_generated_awkward_rows(spark):
    rng = random.Random(1)
    name = lambda: rng.choice(["load", "save", "open", "close"]) + rng.choice(["Table", "Window", "Record"])
    own = [(i, f"src/f{i}.ts", "\n".join(f"{rng.choice(['const', 'let'])} {name()} = {name()}({name()}, {rng.randrange(9)}){rng.choice([';', ' ?? 1;', '.x;'])}" for _ in range(40)), "c", "c") for i in range(40)]
    odd = [(100, None, "a" * 200_000, "", ""), (101, "x.js", None, "", ""), (None, "x.js", "let a = 1", "", ""), (102, "x.js", "", "", ""), (103, "x.js", "// only words", "", ""), (0, "src/f0.ts", own[0][2], "", "")]
    files = spark.createDataFrame(own + odd, "file_id long, path string, content string, language string, style string")
    got = {r["file_id"] for r in generated.not_hand_written(files).collect()}
    assert 100 in got and 101 not in got and None not in got and 102 not in got
    assert generated.not_hand_written(files.limit(0)).count() == 0


# --- 6: leaks ---------------------------------------------------------------------------------------


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, "s", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(12)] + [(50, None, None), (None, "s", "a " * 20), (51, "s", ""), (0, "s", "again other words")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        source = items[rng.randrange(12)][2].split()
        a = rng.randrange(len(source))
        w += source[a : a + rng.randrange(5, 25)]
        docs.append((i, rng.choice([" ", "\n-- ", "*_*"]).join(x.upper() if rng.random() < 0.3 else x for x in w), "clash"))
    docs += [(70, None, ""), (71, "", ""), (None, items[0][2], ""), (72, " ".join(vocabulary) * 5000 + " " + items[3][2], ""), (0, docs[0][1], "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    t = spark.createDataFrame(items, "item_id long, suite string, text string")
    runs = {}
    for i, _, text in items:
        if i is not None and text:
            w = leakage.words(text)
            for k in range(len(w) - 11):
                runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for i, text, _ in docs:
        if i is not None and text:
            w = leakage.words(text)
            for k in range(len(w) - 11):
                want |= {(i, x) for x in runs.get(tuple(w[k : k + 12]), ())}
    for slots in (None, 1, 64):  # with few slots all shifts are zero
        assert {tuple(r) for r in leakage.leaks(d, t, slots=slots).collect()} == want and want
    assert leakage.leaks(d, t.limit(0)).count() == 0 and leakage.leaks(d.limit(0), t).count() == 0


# --- 7: mixing --------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["module", "edge", "layer", "cycle"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60))), rng.choice(["a", " A", "b", "b", "b", "b", "c"]), "x") for i in range(4000)]
    docs += [(9001, None, "a", ""), (9002, "", "b", ""), (9003, "text", None, ""), (9004, "text", "other", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    t = spark.createDataFrame([("A ", 0.5, 3), ("b", 0.2, 1), ("c", 0.2, 1), ("gone", 0.1, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats long")
    m = mixing.Mixture(d, t)
    shares = {r["source"]: r for r in m.shares().collect()}
    assert {r["source"] for r in m.unreachable().collect()} == {"c", "gone"} == {s for s, r in shares.items() if not r["reachable"]}
    assert abs(shares["a"]["share_of_total"] - 0.5) < 0.02 and abs(shares["b"]["share_of_total"] - 0.2) < 0.02
    assert shares["c"]["tokens_used"] == shares["c"]["tokens_available"] and shares["gone"]["tokens_used"] == 0
    c = m.copies()
    assert c.where("copies < 0 or (source = 'a' and copies > 3) or (source <> 'a' and copies > 1)").count() == 0
    # the rates meet the constraint exactly, before rounding
    planned = c.where("source = 'a'").agg(F.sum(F.col("rate") * F.col("tokens"))).first()[0]
    assert abs(planned / m.total - 0.5) < 1e-4
    empty = mixing.Mixture(d.limit(0), t)
    assert empty.copies().count() == 0 and empty.shares().count() == 4


# --- 8: wrong encodings --------------------------------------------------------------------------------

GOOD = [
    "Das Modul hängt jetzt von überflüssigen Änderungen ab, natürlich größer als früher.", "La règle sur le schéma de référence n’est pas respectée, malgré l’arrêté.",
    "Também há três dependências órfãs na última execução da migração.", "Правило для порога сходства нарушено, как уже говорилось раньше.",
    "来週、報告書の規則に違反がありますので確認してください。", "Our naïve estimate for the façade — “stable” — can’t be right…", "Pravidlo pro přehled bylo porušeno, takže kontrola selhala znovu příště.",
]


def corpus():
    docs = [(i, GOOD[i % 7] + f" {i}") for i in range(1400)]
    bad = {}
    for i, (text, meant, used) in enumerate(
        [(GOOD[0], "utf-8", "cp1252"), (GOOD[1], "utf-8", "latin-1"), (GOOD[2], "utf-8", "cp437"), (GOOD[3], "cp1251", "cp1252"), (GOOD[3], "utf-8", "latin-1"), (GOOD[5], "utf-8", "mac_roman"), (GOOD[0], "cp1252", "cp850"), (GOOD[4], "utf-8", "latin-1")]
    ):
        bad[2000 + i] = text
        docs.append((2000 + i, text.encode(meant).decode(used)))
    bad[2010] = GOOD[0]
    docs.append((2010, GOOD[0].encode().decode("latin-1").encode().decode("latin-1")))
    examples = [(3000, "The label showed “Ã©” where it should say “é”."), (3001, "Strings such as Ã¼ or Ã¶ mean that the reader guessed."), (3002, "A fixture contains the sample ‘ÐŸÑ€’ on purpose."), (3003, None), (3004, ""), (3005, "plain " * 50_000), (3006, "two words here")]
    return docs + examples, bad


def test_encoding(spark):
    docs, bad = corpus()
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs] + [(None, docs[1400][1], "")], "doc_id long, text string, places_lost string")
    got = {r["doc_id"]: r["text"] for r in encoding.restored(d).collect()}
    assert set(got) - {None} == set(bad)
    assert sum(got[i] == t for i, t in bad.items()) >= len(bad) - 1
    lost = spark.createDataFrame([(1, "Das Ger�t h�ngt"), (2, "shown as “�” here")], "doc_id long, text string")
    assert [(r["doc_id"], r["places_lost"]) for r in encoding.restored(lost).collect()] == [(1, 2)]
    assert encoding.restored(d.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [2000, 2003, 2005, 2010])
def test_copies_of_garbled_text(spark, kind):
    """Copies that make up a third of the rows don't make their own wrong pairs usual; each of them is found."""
    docs, bad = corpus()
    texts = dict(docs)
    copies = {10_000 + i: texts[kind] for i in range(len(docs) // 2)}
    d = spark.createDataFrame([*docs, *copies.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in encoding.restored(d).collect()}
    assert set(got) == set(bad) | set(copies)
    assert all(got[i] == got[kind] for i in copies) and got[kind] == bad[kind]


def test_single_letters_read_as_multi_byte_text(spark):
    """A lone accented letter that became an East Asian character is found; real East Asian letters beside names are not."""
    docs = [(i, t) for i, t in corpus()[0] if i < 1400] + [(i, f"Widget{i}는 새 모듈입니다. Engine没有循环, Cache中的边, {i}") for i in range(1400, 1600)]
    bad = {}
    for i, (text, used) in enumerate([("Das Modul hängt ab", "cp932"), ("La façade est stable", "euc_kr"), ("Our team can’t explain", "gbk"), ("ein kürzerer Weg", "big5")]):
        bad[2000 + i] = text
        docs.append((2000 + i, text.encode().decode(used)))
    got = {r["doc_id"]: r["text"] for r in encoding.restored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == set(bad)
    assert sum(got[i] == t for i, t in bad.items()) >= 3


def test_rare_alphabets_hold_sequences_by_chance(spark):
    """A word of a rare script that a reader would see a valid sequence in (three letters of cp866) stays as it is."""
    docs = [(i, GOOD[i % 4] + f" {i}") for i in range(900)] + [(1000, "Эти точки зрения учтены."), (1001, "точки"), (1002, "Обе точки графа")]
    d = spark.createDataFrame([*docs, (2000, GOOD[3].encode().decode("latin-1"))], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in encoding.restored(d).collect()] == [(2000, GOOD[3])]


def test_maximal_segments():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.normal(-0.3, 1, 40).astype(np.float32)
        got = encoding.maximal_segments(s)
        best, run = 0.0, 0.0
        for v in s:
            run = max(0.0, run + float(v))
            best = max(best, run)
        assert abs(max((float(s[a:b].sum()) for a, b in got), default=0.0) - best) < 1e-4
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
