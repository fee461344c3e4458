"""The pipeline, stage by stage, on a table with every kind of case planted."""
import random

import pytest

import corpus_pipeline
from bitextkit.llm.common import cut
from .test_dedup import brute_components, exact_leaks
from .test_tokens import check_packing


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))
    items = {i: prose(25) for i in range(6)}
    docs = {}
    for i in range(260):
        docs[i] = prose(60) + "\n" + prose(rnd.randrange(30, 90))
    clean = set(docs)
    for i in range(300, 312):
        docs[i] = docs[i - 300]                                         # exact copies
    for i in range(320, 330):
        w = docs[i - 300].split(" ")
        w[5] = "changed"
        docs[i] = " ".join(w)                                            # near copies
    for i in range(400, 406):
        docs[i] = prose(50) + " " + items[i - 400] + " " + prose(50)    # leaks
    for i in range(500, 510):
        docs[i] = " ".join(w + "***" for w in prose(80).split(" "))     # symbols
    docs[520], docs[521], docs[522] = "too short", None, ""
    boiler = "subscribe to our very own letter for more of this"
    for i in range(100, 130):
        docs[i] += "\n" + boiler
    d = tmp_path_factory.mktemp("planted")
    rows = [(k, x, "en", "s", len(x or "")) for k, x in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        f"{d}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, clean, items, boiler


def test_stages(spark, planted):
    sf_dir, docs, clean, items, boiler = planted
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, columns = {}, frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = cut(stage(spark, frame, sf_dir), "stage")
        steps[name] = frame.collect()
        if name != "packing":
            assert frame.columns == columns
    texts = {k: {r.doc_id: r.text for r in v} for k, v in steps.items() if k != "packing"}
    quality, lines, near, bench = (texts[k] for k, _ in corpus_pipeline.STAGES[:-1])
    assert set(docs) - set(quality) == {*range(500, 510), 520, 521, 522}
    assert set(lines) == set(quality) and all(boiler not in lines[i] for i in range(101, 130))
    assert lines[100] == quality[100] and all(r.n_chars == len(r.text) for r in steps["line dedup"])
    whole = brute_components(lines, 80)
    assert set(near) == {k for k, (_, c) in whole.items() if c == k}
    assert clean <= set(near) and not set(range(300, 330)) & set(near)
    leaks = {k for k, _ in exact_leaks(near, items)}
    assert leaks == set(range(400, 406)) and set(bench) == set(near) - leaks
    check_packing(steps["packing"], bench)


def test_run_is_the_stages_in_order(spark, planted):
    got = corpus_pipeline.run(spark, planted[0])
    assert got.columns[:2] == ["doc_id", "start"] and 200 < got.select("doc_id").distinct().count() <= 260
