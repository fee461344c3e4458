"""Plan-shape checks: the properties the scale design relies on."""
import re

from bitextkit.plans.queries import QUERIES
from conftest import SF001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bleu_chrf_no_row_a_gram_and_no_shuffle_of_sentences(spark):
    p = plan_of(QUERIES["a06_evaluate_by_direction"](spark, SF001))
    assert "Generate" not in p and "Join" not in p and "SortAggregate" not in p
    assert len(re.findall(r"Exchange ", p)) == 1 and len(re.findall(r"MapInArrow", p)) == 1


def test_funnel_single_aggregate_shuffle(spark):
    p = plan_of(QUERIES["f07_clean_funnel"](spark, SF001))
    assert len(re.findall(r"Exchange hashpartitioning\(src#\d+, tgt#", p)) == 1
    assert "SortAggregate" not in p and "Window" not in p


def test_meteor_no_python(spark):
    p = plan_of(QUERIES["a03_corpus_meteor"](spark, SF001))
    assert "Python" not in p and "ArrowEval" not in p


def test_scan_prunes_columns(spark):
    ex = QUERIES["p12_tokenize_13a"](spark, SF001)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in ex


def test_split_has_no_global_window_over_rows(spark):
    # the only row-level window is over straddling buckets, partitioned by bucket
    p = plan_of(QUERIES["w02_split"](spark, SF001))
    assert "BroadcastHashJoin" in p
    for m in re.finditer(r"Window \[[^\n]*\], \[([^\]]*)\]", p):
        assert m.group(1).strip() != ""
