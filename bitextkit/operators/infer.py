"""Batch inference as DataFrame operators: generated "rejected" side (U01),
embeddings (U02), external scorer rewards (U05), decode sweeps (U06) and
tokenisation (P15).

The model is user-supplied as a *factory* (a picklable zero-argument
callable).  It runs once per Arrow batch stream inside ``mapInPandas`` /
an iterator ``pandas_udf``, never per row, and the row key travels through
the same pandas frame -- the reference's positional re-attachment of
outputs (J02) becomes impossible to get wrong.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextkit.functions.text import ws_tokens
from bitextkit.operators.ledger import grid_array

def _py_strip(s: pd.Series) -> pd.Series:
    # Python str.strip() == P05 strip_ws on the engine side
    return s.map(lambda x: x.strip() if isinstance(x, str) else x)


# ------------------------------------------------------------ U01

def generate_rejected(df: DataFrame, generator_factory, batch_size: int = 64,
                      input: str = "source", output: str = "unpreferred",
                      config_cols: list[str] | None = None) -> DataFrame:
    """Add the model output for ``input`` as ``output`` (stripped).

    ``batch_size`` bounds the rows handed to the model per call; Spark's Arrow
    batches are split further, so memory per task is independent of data."""
    schema = T.StructType(df.schema.fields + [T.StructField(output, T.StringType(), True)])
    cfg = list(config_cols or [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = generator_factory()
        for pdf in batches:
            outs = []
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                if cfg:
                    gen = model(chunk[input], chunk[cfg].reset_index(drop=True))
                else:
                    gen = model(chunk[input])
                outs.extend(list(gen))
            pdf = pdf.copy()
            # one Arrow batch out per Arrow batch in (model calls stay batch_size)
            pdf[output] = _py_strip(pd.Series(outs, index=pdf.index, dtype=object))
            yield pdf

    return df.mapInPandas(run, schema)


# ------------------------------------------------------------ U02

def embed(df: DataFrame, col: str, encoder_factory, out: str = "embedding",
          batch_size: int = 256) -> DataFrame:
    """Sentence embedding column via an iterator pandas UDF (the encoder
    is built once per task, fed in batches)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        for s in it:
            parts = []
            for start in range(0, len(s), batch_size):
                parts.extend(list(model(s.iloc[start:start + batch_size].fillna("").tolist())))
            yield pd.Series(parts, index=s.index)
    return df.withColumn(out, enc(F.col(col)))


# ------------------------------------------------------------ U05

def model_reward(df: DataFrame, scorer_factory, batch_size: int = 8, input_format: str = "triple",
                 out: str = "reward", src: str = "source", hyp: str = "hyp",
                 ref: str = "ref") -> DataFrame:
    """External scorer reward.  ``concat``: the scorer receives
    ``"{src} {ref} {hyp}"`` strings (built natively with concat_ws);
    ``triple``: a frame with src, mt, ref columns.  Scores come back per row
    in the same batch."""
    if input_format == "concat":
        x = df.withColumn("_in", F.concat_ws(" ", F.col(src), F.col(ref), F.col(hyp)))
        in_cols = ["_in"]
    elif input_format == "triple":
        x = df.withColumn("_in_src", F.col(src)).withColumn("_in_mt", F.col(hyp)).withColumn(
            "_in_ref", F.col(ref))
        in_cols = ["_in_src", "_in_mt", "_in_ref"]
    else:
        raise ValueError("input_format must be 'concat' or 'triple'")
    schema = T.StructType(x.schema.fields + [T.StructField(out, T.DoubleType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            vals = []
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                if input_format == "concat":
                    scores = scorer(chunk["_in"].tolist())
                else:
                    scores = scorer(chunk[in_cols].rename(
                        columns={"_in_src": "src", "_in_mt": "mt", "_in_ref": "ref"}))
                vals.extend(float(v) for v in scores)
            pdf = pdf.copy()
            pdf[out] = vals
            yield pdf

    return x.mapInPandas(run, schema).drop(*in_cols)


# ------------------------------------------------------------ U06

OUT_CHARS = 1 << 22     # characters of outputs that go out in one Arrow batch, about

def generate_for_grid(df: DataFrame, grid: dict[str, list], generator_factory, input: str, output: str,
                      configs: str, batch_size: int = 64, nested: bool = False) -> DataFrame:
    """Every row once for each *different* output of the grid's configurations:
    ``df`` plus ``output`` (stripped) and ``configs``, the sorted ids of the
    configurations that gave it.  Rows times configurations are never a table.
    ``nested``: every row once, with arrays of its outputs and of their ``configs``."""
    names = list(grid)
    cells = [dict(zip(names, x)) for x in itertools.product(*grid.values())]
    text, ids_of = T.StringType(), T.ArrayType(T.IntegerType())
    schema = T.StructType(df.schema.fields + [T.StructField(output, T.ArrayType(text) if nested else text, True),
                                              T.StructField(configs, T.ArrayType(ids_of) if nested else ids_of, True)])

    def with_outputs(rows, made):
        import numpy as np
        import pyarrow as pa
        count = [len(seen) for seen in made]
        texts = pa.array([t for seen in made for t in seen], type=pa.string(), from_pandas=True)
        ids = pa.array([ids for seen in made for ids in seen.values()], type=pa.list_(pa.int32()))
        if nested:
            ends = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
            columns = [*rows.columns, *[pa.ListArray.from_arrays(ends, x) for x in (texts, ids)]]
        else:
            at = pa.array(np.repeat(np.arange(len(made)), count))
            columns = [*[c.take(at) for c in rows.columns], texts, ids]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        model = generator_factory()
        frames = [pd.DataFrame([cell] * batch_size, columns=names) for cell in cells]
        for batch in batches:
            begin, made, chars = 0, [], 0
            for start in range(0, len(batch), batch_size):
                prompts = batch.slice(start, batch_size).column(input).to_pandas()
                outs = [model(prompts, cfg if len(prompts) == batch_size else cfg.iloc[:len(prompts)]) for cfg in frames]
                for outs_of_row in zip(*outs):
                    seen: dict = {}
                    for c, out in enumerate(outs_of_row):
                        if out in seen:
                            seen[out].append(c)
                        else:
                            seen[out] = [c]
                    for out in [x for x in seen if isinstance(x, str) and x.strip() != x]:
                        seen[out.strip()] = sorted(seen.pop(out) + seen.get(out.strip(), []))
                    made.append(seen)
                    chars += sum(map(len, filter(None, seen)))
                if chars >= OUT_CHARS:
                    yield with_outputs(batch.slice(begin, len(made)), made)
                    begin, made, chars = begin + len(made), [], 0
            if made:
                yield with_outputs(batch.slice(begin, len(made)), made)

    return df.mapInArrow(run, schema)


def sweep(df: DataFrame, grid: dict[str, list], generator_factory, input: str = "source",
          ref: str = "ref", id_col: str = "id", batch_size: int = 64) -> DataFrame:
    """BLEU (effective order) and chrF++ of every decode configuration of
    ``grid`` over the evaluation set, in one job.

    Outputs that several configurations share are scored once, those that another one
    begins with within that one; their sufficient statistics are summed by set of
    configurations in the batch (few sets, one small row each) and only these sums are
    given to the single configurations."""
    from bitextkit.operators.mt_metrics import STAT_COLS_BLEU, STAT_COLS_CHRF, corpus_scores, sentence_stats
    x = df.select(F.col(id_col).alias("_rid"), input, ref)
    made = generate_for_grid(x, grid, generator_factory, input, "_hyp", "_configs", batch_size, nested=True)
    st = sentence_stats(made, "_rid", "_hyp", ref, keep=(), many=("_configs",), summed=True)
    sums = st.groupBy("_configs").agg(*[F.sum(c).alias(c) for c in ["n_rows", *STAT_COLS_BLEU, *STAT_COLS_CHRF]])
    res = corpus_scores(sums.withColumn("config_id", F.explode("_configs")), by=("config_id",))
    cfgs = df.sparkSession.range(1).select(F.inline(grid_array(grid)))
    return cfgs.join(res, "config_id").select("config_id", *grid, F.col("bleu_eff").alias("bleu"), "chrf")


# ------------------------------------------------------------ P15

def tokenize_pairs(df: DataFrame, max_source: int, max_target: int, source: str = "source",
                   target: str = "target", tokenizer_factory=None) -> DataFrame:
    """Tokenise + truncate sources (input) and targets (labels).

    Without a tokenizer the whitespace tokenizer runs natively
    (``slice(split())``); with one, ``mapInPandas`` builds it once per task and
    returns integer id arrays."""
    if tokenizer_factory is None:
        return df.withColumns({
            "input_tokens": F.slice(ws_tokens(F.col(source)), 1, max_source),
            "label_tokens": F.slice(ws_tokens(F.col(target)), 1, max_target)})
    schema = T.StructType(df.schema.fields + [
        T.StructField("input_ids", T.ArrayType(T.IntegerType()), True),
        T.StructField("labels", T.ArrayType(T.IntegerType()), True)])

    def run(batches):
        tok = tokenizer_factory()
        for pdf in batches:
            pdf = pdf.copy()
            pdf["input_ids"] = [list(tok(s or ""))[:max_source] for s in pdf[source]]
            pdf["labels"] = [list(tok(t or ""))[:max_target] for t in pdf[target]]
            yield pdf
    return df.mapInPandas(run, schema)


__all__ = ["generate_rejected", "embed", "model_reward", "sweep", "tokenize_pairs"]
