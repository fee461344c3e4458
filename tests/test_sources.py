import json
import os

import pytest

from bitextkit import sources as SRC
from bitextkit.operators import mt_metrics as M


@pytest.fixture
def csv_file(tmp_path):
    p = tmp_path / "parallel.csv"
    p.write_text(
        'src,tgt\n'
        'a1,b1\n'
        'short_only\n'                      # too few fields: kept, tgt NULL
        'x,y,z\n'                           # too many fields: skipped
        '"multi\nline",b4\n'                # quoted newline
        '"say ""hi""",b5\n'                 # doubled quote
        'NA,b6\n', encoding="utf-8")
    return str(p)


def test_tolerant_csv(spark, csv_file):
    rows = SRC.read_parallel_csv(spark, csv_file).collect()
    got = [(r.src, r.tgt) for r in rows]
    assert ("a1", "b1") in got
    assert ("short_only", None) in got
    assert ("multi\nline", "b4") in got
    assert ('say "hi"', "b5") in got
    assert (None, "b6") in got
    assert not any(s == "x" for s, _ in got)
    q = SRC.csv_quality(spark, csv_file).first()
    assert (q.raw_lines, q.parsed, q.malformed) == (7, 5, 2)


def test_csv_columns_by_name(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("id,tgt,src\n1,T,S\n2,U\n4,V,W,x\n5,,\n")
    rows = [(r.src, r.tgt) for r in SRC.read_parallel_csv(spark, str(p)).collect()]
    assert rows == [("S", "T"), (None, "U"), (None, None)]
    p.write_text("source,target\na,b\n")
    with pytest.raises(ValueError):
        SRC.read_parallel_csv(spark, str(p))
    assert SRC.read_parallel_csv(spark, str(p), "source", "target", tolerant=False).count() == 1


def test_numbered_lines_over_splits(spark, tmp_path):
    p = tmp_path / "many.txt"
    p.write_text("".join(f"line {i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = SRC.readers.numbered_lines(spark, str(p)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 20_000 and all(r.value == f"line {r.line_no}" for r in rows)


def test_strict_csv_fails(spark, csv_file):
    with pytest.raises(Exception):
        SRC.read_parallel_csv(spark, csv_file, tolerant=False).collect()


def test_load_parallel_dispatch(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"kangri": "a", "hindi": "b"}\n', encoding="utf-8")
    df = SRC.load_parallel(spark, str(p), "kangri", "hindi")
    assert df.first().source == "a"
    with pytest.raises(ValueError):
        SRC.load_parallel(spark, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError):
        SRC.load_parallel(spark, str(p), "nope", "hindi")


def test_triplets_json_array(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps([{"source": "s1", "preferred": "p1", "unpreferred": "u1"},
                             {"source": "s2", "preferred": "p2", "unpreferred": "u2"}], indent=2))
    assert SRC.read_triplets(spark, str(p)).count() == 2


def test_line_pairs(spark, tmp_path):
    a, b, c = tmp_path / "p.txt", tmp_path / "r.txt", tmp_path / "r2.txt"
    a.write_text(" x \ny\n")
    b.write_text("x\n y \n")
    c.write_text("x\n")
    rows = SRC.read_line_pairs(spark, str(a), str(b)).orderBy("line_no").collect()
    assert [(r.prediction, r.reference) for r in rows] == [("x", "x"), ("y", "y")]
    with pytest.raises(ValueError):
        SRC.read_line_pairs(spark, str(a), str(c))


def test_ledger_two_key_sets(spark, tmp_path):
    p = tmp_path / "ledger.jsonl"
    p.write_text("\n".join([
        json.dumps({"iter": 0, "change": "base", "bleu": 2.3526, "keep": True}),
        json.dumps({"iter": 19, "track": "same_protocol", "metric": "overall_bleu", "value": 21.8603,
                    "keep": True}),
        json.dumps({"iter": 27, "track": "t", "value": None, "keep": False, "status": "no_result"}),
        json.dumps({"iter": 9, "config": {"learning_rate": 1e-5, "dpo_beta": 0.2, "max_length": 160},
                    "bleu": 5.4359, "keep": True}),
    ]) + "\n")
    rows = {r.iter: r for r in SRC.read_ledger(spark, str(p)).collect()}
    assert rows[0].score == 2.3526 and rows[0].track == "main"
    assert rows[19].score == 21.8603
    assert rows[27].score is None
    assert rows[9].config.max_length == 160


def test_scrape_metric(spark, tmp_path):
    p = tmp_path / "run.log"
    p.write_text("MODEL_VOLUME=x\nFINAL_BLEU=1.5\nnoise FINAL_BLEU=2.25 tail\nSAMPLE_SIZE=512\n")
    assert SRC.scrape_metric_value(spark, str(p)) == 2.25
    q = tmp_path / "empty.log"
    q.write_text("nothing here\n")
    with pytest.raises(ValueError):
        SRC.scrape_metric_value(spark, str(q))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', "b\nc", "train"), (2, "d", "e", "test")],
                               "pair_id long, src string, tgt string, split string")
    SRC.write_csv(df.select("src", "tgt"), str(tmp_path / "out_csv"))
    back = {(r.src, r.tgt) for r in SRC.read_parallel_csv(spark, str(tmp_path / "out_csv")).collect()}
    assert back == {('a "q"', "b\nc"), ("d", "e")}
    SRC.write_split(df, str(tmp_path / "split"))
    assert {"split=test", "split=train"} <= set(os.listdir(tmp_path / "split"))
    SRC.write_triplets(df, str(tmp_path / "trip"))
    assert spark.read.json(str(tmp_path / "trip")).count() == 2


def test_metrics_json_shape(spark):
    rows = [(1, "src2tgt", "a b c d", "a b c d"), (2, "tgt2src", "a b", "a b c d")]
    st = M.sentence_stats(spark.createDataFrame(rows, "id long, direction string, hyp string, ref string"))
    doc = json.loads(SRC.metrics_json(M.evaluate_by(st)).first().json)
    assert set(doc["per_direction"]) == {"src2tgt", "tgt2src"}
    assert doc["per_direction"]["src2tgt"]["bleu"] == 100.0
    assert "overall_bleu" in doc


def test_triplet_lines_are_compressed(spark, tmp_path):
    rows = [(f"translate a to b: {i} अआ", "x\ny", None if i % 3 else "z", "src2tgt") for i in range(300)]
    df = spark.createDataFrame(rows, "source string, preferred string, unpreferred string, direction string")
    SRC.write_triplets(df, str(tmp_path / "t.jsonl"))
    parts = list((tmp_path / "t.jsonl").glob("part-*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    assert sorted(map(str, SRC.read_triplets(spark, str(tmp_path / "t.jsonl")).collect())) == sorted(map(str, df.collect()))
