"""Operators 3, 6 and 7 against brute force."""
import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from bitextkit.llm import decontaminate, line_dedup, near_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = re.compile(r"[^\x20\x09-\x0D]+")


def grams(x, n=5):
    w = WS.findall((x or "").translate(UP))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(texts, percent):
    sets, up = {k: grams(x) for k, x in texts.items()}, {k: k for k in texts}
    inverted = collections.defaultdict(list)

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    for k, s in sets.items():
        for g in s:
            inverted[g].append(k)
    for a, b in {p for ks in inverted.values() for p in itertools.combinations(sorted(ks), 2)}:
        x = len(sets[a] & sets[b])
        if 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {k: (len(sets[k]), find(k)) for k in texts}


def near_copies(seed=5):
    """Groups whose members differ from each other at about the threshold, so
    that chains, hubs that fail and several components in a list occur."""
    rnd = random.Random(seed)
    texts, shared = {}, [f"p{i}" for i in range(40)]
    for g in range(25):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 12, 40, 150, 400]))]
        for _ in range(rnd.randrange(2, 12)):
            w = list(base)
            for i in range(len(w)):
                if rnd.random() < rnd.choice([0, 0.01, 0.02, 0.03]):
                    w[i] = f"e{rnd.randrange(10 ** 6)}"
            if rnd.random() < 0.2:
                w += shared
            texts[len(texts)] = " ".join(w)
    return texts


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_match_brute_force(spark, percent):
    texts = near_copies()
    order = list(texts.items())
    random.Random(1).shuffle(order)
    found = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_on_the_test_table(docs001, texts001):
    found = near_dedup.near_duplicates(docs001).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts001, 85)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates_edges(edge, empty):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(edge).collect()}
    assert got[4, 3] == (4, True) and got[5, 3] == (4, False) and got[1, 0] == (1, True) and got[7, 1] == (7, True)
    assert got[None, 0] == (None, True)
    out = near_dedup.drop_near_duplicates(edge)
    assert out.columns == edge.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, -1, 1, 2, 3, 4, 4, 6, 7]
    assert near_dedup.near_duplicates(empty).collect() == []


# ------------------------------------------------------------ benchmark

def exact_leaks(texts, items):
    out = set()
    for i, item in items.items():
        w = re.findall(r"\w+", item.lower())
        phrase = " " + " ".join(w) + " "
        out |= {(k, i) for k, x in texts.items() if len(w) >= 5 and phrase in " " + " ".join(re.findall(r"\w+", x.lower())) + " "}
    return out


def test_leaks_on_the_test_table(spark, docs001, texts001):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs001, bench).collect()}
    assert found == exact_leaks(texts001, {r.item_id: r.text for r in bench.collect()})


ITEM = "Train a leaves Paris at 60 km per hour and reaches Rome after 5 hours, how far is Rome from Paris then"


def test_reparameterised_questions(spark):
    docs = [(1, "intro words. " + ITEM + " and more"),
            (2, "text. Train a leaves Oslo at 90 km per hour and reaches Bonn after 7.5 hours, how far is Bonn from Oslo then"),
            (3, "Train a leaves Oslo at 90 km per hour and reaches Bonn after 7 hours, how far is Kiel from Lyon then"),
            (4, "Train a leaves early at night and nobody knows how far it is"), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "a b"), (None, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_slots, r.n_consistent) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 7): (6, 6), (2, 7): (6, 6)}
    assert [r.doc_id for r in decontaminate.remove_contaminated(d, b).orderBy("doc_id").collect()] == [3, 4, 5]


def test_plain_copies_do_not_depend_on_capitals_quotes_or_line_breaks(spark):
    copies = [ITEM.lower(), ITEM.upper(), ITEM.replace("Rome", "\nRome"), ITEM.replace("Rome", '"Rome"').replace("Paris", "“Paris”"),
              ITEM.replace("Rome", "New York"), ITEM.replace(" ", "  \n"), ITEM.replace("Rome", "New York").replace("Paris", "San Juan Bautista")]
    other = ["train a leaves oslo early at 60 km per hour and nobody reaches rome, how far is it then", "Rome Paris Rome Paris"]
    d = spark.createDataFrame(list(enumerate(copies + other)), "doc_id long, text string")
    b = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = sorted(r.doc_id for r in decontaminate.contaminated(d, b).collect())
    assert got == list(range(len(copies)))


def test_leaks_beyond_the_broadcast_bound(spark, docs001, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(docs001, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WINDOWS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(docs001, bench).collect())) == want


def test_leak_edges(spark, edge, empty):
    b = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(edge, b).collect()) == [4, 5]
    out = decontaminate.remove_contaminated(edge, b)
    assert out.columns == edge.columns and out.count() == edge.count() - 3
    assert decontaminate.contaminated(empty, b).collect() == []
    assert decontaminate.contaminated(edge, b.filter("false")).collect() == []


def test_placeholders_keep_a_text_in_ascii_and_stand_apart_from_its_own_control_characters(spark):
    """Matching and lower-casing texts beyond ASCII is slow."""
    text = "We paid Anna 1.5 kg at  9 and \x01 took\x02 2\x04 more"
    d = spark.createDataFrame([(text,)], "t string").select(decontaminate.folded(F.col("t")).alias("x"))
    named, plain = d.select(decontaminate.template_tokens(F.col("x")), decontaminate.template_tokens(F.col("x"), plain=True)).first()
    n, u, p = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME
    assert "".join(named + plain).isascii()
    assert named == ["we", "paid", p, n, u, "at", n, "and", "took", n, "more"]
    assert plain == ["we", "paid", "anna", n, u, "at", n, "and", "took", n, "more"]


def test_windows_are_hashed_from_their_tokens_in_compiled_code(spark):
    d = spark.createDataFrame([(1, 0, list(range(8))), (2, 1, list(range(5))), (3, 0, [1, 2, 3, 4]), (4, 1, [])],
                              "id long, form int, kh array<long>")
    out = decontaminate.with_windows(d, "kh", "i")
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.i): r.h for r in out.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    want = d.filter("id = 1").select(F.xxhash64(F.lit(0), *[F.col("kh")[k] for k in range(3, 8)])).first()[0]
    assert got[1, 3] == want


# ------------------------------------------------------------ lines

def brute_lines(texts):
    """The same rules with dictionaries; families as sets of least lines."""
    def keys(line):
        w = WS.findall(re.sub(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", line))
        if len(w) < line_dedup.MIN_TOKENS:
            return []
        out, tail = [(-1, *w)], len(w) - line_dedup.LEAD
        if tail >= line_dedup.PARTS * line_dedup.MIN_PART:
            for p in range(line_dedup.PARTS):
                a, b = (line_dedup.LEAD + tail * x // line_dedup.PARTS for x in (p, p + 1))
                out.append((p, len(w), *w[:a], None, *w[b:]))
        return out
    return {k: [keys(line) for line in x.split("\n")] for k, x in texts.items()}


def test_recurring_lines_are_dropped_but_for_the_first(spark):
    rnd = random.Random(2)

    def own():
        return " ".join(f"w{''.join(rnd.choice('abcdefghij') for _ in range(9))}" for _ in range(12))
    boiler = "please accept all of our cookies before you read on"
    texts = {i: "\n".join([own(), boiler if i % 2 else own(), f"page {i} of 90 of this long report by us", own()])
             for i in range(40)}
    texts |= {i: texts[4] for i in range(100, 120)}                       # whole copies are not boilerplate
    variable = {i: own() + f"\nThe weather in our town for {'abcdefgh'[i - 200]}{'xyz'[i % 3]} today is shown here now"
                for i in range(200, 208)}
    texts |= variable
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.line_report(d).collect()}
    keys = brute_lines(texts)
    seen = collections.defaultdict(set)
    for k, lines in keys.items():
        for line in lines:
            for key in line:
                seen[key].add(texts[k])
    for k, x in texts.items():
        want = []
        for line, ks in zip(x.split("\n"), keys[k]):
            held = [key for key in ks if len(seen[key]) >= 3]
            if not any(min(i for i in texts if texts[i] in seen[key]) != k for key in held):
                want.append(line)
        assert out[k].text == "\n".join(want), k
        assert out[k].n_lines == x.count("\n") + 1 and out[k].n_dropped == out[k].n_lines - len(want)
    assert boiler in out[1].text and all(boiler not in out[i].text for i in range(3, 40, 2))
    assert out[110].text.count("\n") >= 2


def test_line_edges(edge, empty):
    out = line_dedup.dedup_lines(edge.drop("_n_lines"))
    assert [c for c in out.columns if c not in ("_n_lines", "_n_dropped")] != []
    assert sorted(out.columns) == sorted([*edge.columns, "_n_dropped"])
    got = sorted((r.doc_id or -1, r.text is None, r._n_lines, r._n_dropped) for r in out.collect())
    assert len(got) == edge.count() and all(r[3] == 0 for r in got) and (1, True, 0, 0) in got
    assert line_dedup.line_report(empty).collect() == []


def test_line_templates_beyond_the_broadcast_bound(docs001, monkeypatch):
    want = sorted(map(tuple, line_dedup.line_report(docs001).collect()))
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, line_dedup.line_report(docs001).collect())) == want


def line_groups(rnd):
    def own(n=12):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(n))

    def edited(lines, at):
        w = lines[at].split(" ")
        w[rnd.randrange(len(w))] = own(1)
        return [*lines[:at], " ".join(w), *lines[at + 1:]]
    return own, edited


@pytest.mark.parametrize("n_copies", [1, 60])
def test_lines_of_exact_and_near_copies_stay(spark, n_copies):
    """Copies, and near copies with one edit in any one line: one group, no recurrence."""
    own, edited = line_groups(random.Random(7))
    texts = {}
    for g in range(8):
        base = [own() for _ in range(6)]
        group = [base] * n_copies + [edited(base, at) for at in range(6)]
        texts |= {1000 * g + i: "\n".join(x) for i, x in enumerate(group)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_report(d).collect()}
    assert out == {k: (x, 0) for k, x in texts.items()}


def test_passages_of_unrelated_documents_go_whatever_copies_there_are(spark):
    own, edited = line_groups(random.Random(8))
    texts, passages = {}, {}
    for g, (length, holders) in enumerate([(1, 2), (3, 2), (3, 3), (3, 5), (5, 10)] * 4):
        passage = [own() for _ in range(length)]
        for i in range(holders):
            texts[100 * g + i] = "\n".join([own() for _ in range(5)] + passage)
            passages[100 * g + i] = (length, i > 0)
    base = [own() for _ in range(6)]                                       # a hot group that holds a line of others too
    texts |= {10_000 + i: "\n".join(base if i % 10 else edited(base, 1 + i % 5)) for i in range(300)}
    texts |= {20_000 + i: own() + "\n" + base[0] + "\n" + own() for i in range(3)}
    passages |= {k: (1, k > 10_000) for k in texts if k >= 10_000}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in line_dedup.line_report(d).collect():
        length, later = passages[r.doc_id]
        assert r.n_dropped == length * later, r.doc_id


def test_lines_are_parsed_once_and_their_tokens_hashed_once_for_all_templates(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h 1\nx y\nthree word line"), (2, "x"), (3, None)], "doc_id long, text string")
    parsed = line_dedup.parsed_docs(d)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<*>") == 1
    got = {r.doc_id: [(x.line, len(set(x["keys"]))) for x in r.lines] for r in parsed.collect()}
    assert got == {1: [(0, 1 + line_dedup.PARTS), (2, 1)], 2: [], 3: []}
    lines = ["a b c d e f g h 1", "a b c d e f g h 22", "a b c d e f g z 1", "a b z d e f g h 1", "a z c d e f g h 1", "a b c d e f g h"]
    tokens = spark.createDataFrame([(x,) for x in lines], "x string").select(line_dedup.line_tokens(F.col("x")).alias("w"))
    keys = [set(r[0]) for r in tokens.select(line_dedup.template_keys(F.size("w"), line_dedup.part_hashes(F.col("w")))).collect()]
    assert [len(keys[0] & k) for k in keys] == [4, 4, 1, 1, 0, 0]
