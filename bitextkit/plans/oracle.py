"""Independent SQL (DuckDB dialect) for each registered query.

Each oracle re-derives its fixture from the raw views (``documents``,
``conversations``, ``embeddings``, ``events``) with plain SQL and computes the
operator the *sequential* way (windows over whole partitions, row_number
dedup, explicit joins) -- a different plan from the Spark one, so agreement
checks the Spark design, not just the expressions.
"""

from __future__ import annotations

import itertools

from bitextkit.plans import sqlfrag as S
from bitextkit.plans.fixtures import (BEYOND_BMP, DEFECT_MOD, PER_DOC, SEGMENT, DUP_MOD, DUP_OFFSET, PROMPT_BARE_MOD,
                                      PROMPT_CROSS_MOD, SEED, SRC_LANG, TGT_LANG)

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, deps: list[str] | None = None):
    CTES[name] = (body, deps or [])


def build(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + final


def _key(*cols: str, seed=SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(cols)}))"


# ------------------------------------------------------------ fixtures

_words = S.rr(S.rr("coalesce(text, '')", S.WSR, " "), "^ +| +$", "")
cte("_pw", f"SELECT doc_id AS pair_id, string_split({_words}, ' ') AS w FROM documents")
cte("_ps", f"SELECT pair_id AS doc_id, w, unnest(range(0, greatest((len(w) + {2 * SEGMENT - 1}) "
           f"// {2 * SEGMENT}, 1))) AS i FROM _pw", ["_pw"])
cte("_pb", f"SELECT doc_id * {PER_DOC} + i AS pair_id, "
           f"array_to_string(w[{2 * SEGMENT} * i + 1:{2 * SEGMENT} * i + {SEGMENT}], ' ') AS s0, "
           f"array_to_string(w[{2 * SEGMENT} * i + {SEGMENT + 1}:{2 * SEGMENT} * i + {2 * SEGMENT}], ' ') AS t0 "
           f"FROM _ps", ["_ps"])
cte("_pc", f"SELECT pair_id, s0, t0, {S.translit('s0')} AS s, {S.translit('t0')} AS t FROM _pb",
    ["_pb"])
cte("_pe", f"""SELECT pair_id,
  CASE pair_id % {DEFECT_MOD} WHEN 1 THEN '' WHEN 2 THEN substring(s, 1, 1)
    WHEN 4 THEN s || ' ....' WHEN 6 THEN s0
    WHEN 8 THEN '"' || chr(8203) || s || chr(160) || '"' WHEN 9 THEN NULL ELSE s END AS src,
  CASE pair_id % {DEFECT_MOD} WHEN 3 THEN s WHEN 5 THEN '{{' || t || '}}' WHEN 6 THEN t0
    WHEN 7 THEN concat_ws(' ', t, t, t, t) WHEN 10 THEN t || ' {BEYOND_BMP}' ELSE t END AS tgt
FROM _pc""", ["_pc"])
cte("parallel_fx", f"SELECT pair_id, src, tgt FROM _pe UNION ALL "
                   f"SELECT pair_id + {DUP_OFFSET}, src, tgt FROM _pe WHERE pair_id % {DUP_MOD} = 0",
    ["_pe"])
cte("normalized", f"SELECT pair_id, {S.norm_text('src')} AS src, {S.norm_text('tgt')} AS tgt "
                  f"FROM parallel_fx", ["parallel_fx"])
cte("_ff", f"""SELECT pair_id, src, tgt,
  CASE WHEN pre IS NOT NULL THEN pre WHEN rn > 1 THEN 'duplicate' ELSE post END AS first_fail
FROM (SELECT *, {S.pre_fail()} AS pre, {S.post_fail()} AS post,
        row_number() OVER (PARTITION BY src, tgt ORDER BY pair_id) AS rn FROM normalized)""",
    ["normalized"])
cte("clean", "SELECT pair_id, src, tgt FROM _ff WHERE first_fail IS NULL", ["_ff"])
cte("pairs", f"""SELECT pair_id, 'translate {SRC_LANG} to {TGT_LANG}: ' || src AS source, tgt AS target,
  'src2tgt' AS direction FROM clean
UNION ALL SELECT pair_id, 'translate {TGT_LANG} to {SRC_LANG}: ' || tgt, src, 'tgt2src' FROM clean""",
    ["clean"])
_pfx = "'^translate [a-z]+ to [a-z]+: '"
cte("prompts", f"""SELECT pair_id,
  CASE WHEN pair_id % {PROMPT_BARE_MOD} = 0 THEN regexp_replace(source, {_pfx}, '')
       WHEN pair_id % {PROMPT_CROSS_MOD} = 0 THEN regexp_extract(source, {_pfx}, 0)
            || CASE WHEN direction = 'src2tgt' THEN '{TGT_LANG} to {SRC_LANG} '
                    ELSE '{SRC_LANG} to {TGT_LANG} ' END
            || regexp_replace(source, {_pfx}, '')
       ELSE source END AS source,
  target, direction FROM pairs""", ["pairs"])

STEPS_VALUES = ("(VALUES (1,'empty'),(2,'too_short'),(3,'identical'),(4,'duplicate'),"
                "(5,'length_ratio'),(6,'artifact'),(7,'heavy_latin')) AS st(step_no, step)")
cte("funnel", f"""SELECT st.step_no::BIGINT AS step_no, st.step,
  coalesce(c.n, 0)::BIGINT AS dropped,
  ((SELECT count(*) FROM _ff) - sum(coalesce(c.n, 0)) OVER (ORDER BY st.step_no))::BIGINT AS remaining
FROM {STEPS_VALUES}
LEFT JOIN (SELECT first_fail, count(*) AS n FROM _ff GROUP BY first_fail) c ON c.first_fail = st.step""",
    ["_ff"])

ORACLE: dict[str, str] = {}



# ------------------------------------------------------------ P
ORACLE["p01_norm_text"] = build(
    f"SELECT pair_id, {S.norm_text('src')} AS src_norm, {S.norm_text('tgt')} AS tgt_norm "
    f"FROM parallel_fx", "parallel_fx")
ORACLE["p02_clean_text"] = build(
    f"SELECT pair_id, {S.clean_text('src')} AS src_clean, {S.clean_text('tgt')} AS tgt_clean "
    f"FROM parallel_fx", "parallel_fx")
ORACLE["p03_clean_text_sequential"] = build(
    f"SELECT pair_id, {S.clean_text('src', 'sequential')} AS src_clean, "
    f"{S.clean_text('tgt', 'sequential')} AS tgt_clean FROM parallel_fx", "parallel_fx")
ORACLE["p04_normalize_for_bleu"] = build(
    f"SELECT pair_id, {S.normalize_for_bleu('src')} AS src_bleu, "
    f"{S.normalize_for_bleu('tgt')} AS tgt_bleu FROM parallel_fx", "parallel_fx")
ORACLE["p05_strip"] = build(
    f"SELECT pair_id, {S.strip_ws('src')} AS src_strip, {S.strip_ws('tgt')} AS tgt_strip "
    f"FROM parallel_fx", "parallel_fx")
ORACLE["p06_add_prompt"] = build(
    f"SELECT pair_id, 'translate {SRC_LANG} to {TGT_LANG}: ' || src AS source FROM clean", "clean")
ORACLE["p08_latin_share"] = build(
    f"SELECT pair_id, round({S.latin_share('src')}, 6) AS src_latin, "
    f"round({S.latin_share('tgt')}, 6) AS tgt_latin FROM normalized", "normalized")
ORACLE["p09_has_artifact"] = build(
    f"SELECT pair_id, {S.has_artifact('src')} AS src_artifact, "
    f"{S.has_artifact('tgt')} AS tgt_artifact FROM normalized", "normalized")
ORACLE["p10_length_ratio"] = build(
    f"SELECT pair_id, round({S.length_ratio('src', 'tgt')}, 6) AS len_ratio FROM normalized",
    "normalized")
ORACLE["p11_direction_of"] = build(f"""SELECT pair_id, direction AS stored_direction,
  CASE WHEN contains(source, '{SRC_LANG} to {TGT_LANG}') THEN 'src2tgt'
       WHEN contains(source, '{TGT_LANG} to {SRC_LANG}') THEN 'tgt2src' END AS dir_substring,
  CASE WHEN contains(lower(source), 'translate {SRC_LANG} to {TGT_LANG}:') THEN 'src2tgt'
       ELSE 'tgt2src' END AS dir_prefix,
  coalesce(nullif(CASE WHEN pair_id % {PROMPT_BARE_MOD} = 0 THEN NULL ELSE direction END, ''),
           'unknown') AS dir_stored
FROM prompts""", "prompts")
ORACLE["p12_tokenize_13a"] = (
    f"SELECT doc_id, array_to_string({S.tokenize_13a('text')}, ' ') AS tokens, "
    f"len({S.tokenize_13a('text')})::BIGINT AS n_tokens FROM documents")
ORACLE["p13_chrf_units"] = (
    f"SELECT doc_id, {S.chrf_chars('text')} AS chars, "
    f"array_to_string({S.chrf_words('text')}, ' ') AS words, "
    f"len({S.chrf_words('text')})::BIGINT AS n_words FROM documents")
ORACLE["p14_ws_tokens"] = (
    f"SELECT doc_id, len({S.ws_tokens('text')})::BIGINT AS n_tokens, "
    f"array_to_string({S.ws_tokens('text')}, ' ') AS joined FROM documents")

# ------------------------------------------------------------ F
ORACLE["f01_drop_empty"] = build(
    "SELECT pair_id, src, tgt FROM normalized WHERE src <> '' AND tgt <> ''", "normalized")
ORACLE["f02_min_chars"] = build(
    "SELECT pair_id, src, tgt FROM normalized WHERE length(src) >= 2 AND length(tgt) >= 2",
    "normalized")
ORACLE["f03_drop_identity"] = build(
    "SELECT pair_id, src, tgt FROM normalized WHERE src <> tgt", "normalized")
ORACLE["f04_length_ratio"] = build(
    f"SELECT pair_id, src, tgt FROM normalized WHERE NOT {S.ratio_outlier('src', 'tgt')}",
    "normalized")
ORACLE["f05_drop_artifacts"] = build(
    f"SELECT pair_id, src, tgt FROM normalized WHERE NOT ({S.has_artifact('src')} OR "
    f"{S.has_artifact('tgt')})", "normalized")
ORACLE["f06_drop_heavy_latin"] = build(
    f"SELECT pair_id, src, tgt FROM normalized WHERE NOT ({S.heavy_latin('src')} OR "
    f"{S.heavy_latin('tgt')})", "normalized")
ORACLE["f07_clean_funnel"] = build("SELECT * FROM funnel", "funnel")
ORACLE["f07_clean_pairs"] = build("SELECT pair_id, src, tgt FROM clean", "clean")
ORACLE["f07_clean_pairs_fast"] = ORACLE["f07_clean_pairs"]
ORACLE["f08_dropna"] = build(
    "SELECT pair_id, src, tgt FROM parallel_fx WHERE src IS NOT NULL AND tgt IS NOT NULL",
    "parallel_fx")
ORACLE["f09_filter_direction"] = build(
    f"SELECT pair_id, source, direction FROM prompts "
    f"WHERE NOT contains(lower(source), 'translate {SRC_LANG} to {TGT_LANG}:')", "prompts")
_n = "sum(n)"
ORACLE["f10_quality_profile"] = build(f"""SELECT
  round(sum(CASE WHEN src = '' OR tgt = '' THEN n ELSE 0 END) * 100.0 / {_n}, 4) AS pct_empty,
  round(sum(CASE WHEN length(src) < 2 OR length(tgt) < 2 THEN n ELSE 0 END) * 100.0 / {_n}, 4)
    AS pct_too_short,
  round(sum(CASE WHEN src = tgt THEN n ELSE 0 END) * 100.0 / {_n}, 4) AS pct_identical,
  round(sum(CASE WHEN {S.ratio_outlier('src', 'tgt')} THEN n ELSE 0 END) * 100.0 / {_n}, 4)
    AS pct_ratio_outlier,
  round(sum(CASE WHEN {S.has_artifact('src')} OR {S.has_artifact('tgt')} THEN n ELSE 0 END)
    * 100.0 / {_n}, 4) AS pct_artifact,
  round(sum(CASE WHEN {S.heavy_latin('src')} OR {S.heavy_latin('tgt')} THEN n ELSE 0 END)
    * 100.0 / {_n}, 4) AS pct_heavy_latin,
  round(sum(n - 1) * 100.0 / {_n}, 4) AS pct_duplicate,
  round(sum(CASE WHEN src = '' OR tgt = '' OR length(src) < 2 OR length(tgt) < 2 OR src = tgt
    OR {S.has_artifact('src')} OR {S.has_artifact('tgt')} OR {S.heavy_latin('src')}
    OR {S.heavy_latin('tgt')} THEN n ELSE 0 END) * 100.0 / {_n}, 4) AS pct_noisy,
  {_n}::BIGINT AS rows
FROM (SELECT src, tgt, count(*) AS n FROM normalized GROUP BY src, tgt)""", "normalized")

# ------------------------------------------------------------ W / B / L / A (corpus shape)
ORACLE["w01_dedup"] = build(
    "SELECT pair_id, src, tgt FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt "
    "ORDER BY pair_id) AS rn FROM normalized) WHERE rn = 1", "normalized")
ORACLE["b01_expand_directions"] = build("SELECT pair_id, source, target, direction FROM pairs",
                                        "pairs")
cte("split3", f"""SELECT pair_id, direction,
  CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
       WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT pair_id, direction,
        row_number() OVER (PARTITION BY direction ORDER BY {_key('pair_id', 'direction')}, pair_id) AS rn,
        count(*) OVER (PARTITION BY direction) AS n FROM pairs)""", ["pairs"])
ORACLE["w02_split"] = build("SELECT pair_id, direction, split FROM split3", "split3")
ORACLE["b02_concat_parts"] = build(
    "SELECT * FROM split3 WHERE split = 'train' UNION ALL SELECT * FROM split3 WHERE split = 'val' "
    "UNION ALL SELECT * FROM split3 WHERE split = 'test'", "split3")
ORACLE["w03_split_train_val"] = build(f"""SELECT pair_id, direction,
  CASE WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split
FROM (SELECT pair_id, direction,
        row_number() OVER (ORDER BY {_key('pair_id', 'direction')}, pair_id, direction) AS rn,
        count(*) OVER () AS n FROM pairs)""", "pairs")
ORACLE["w04_batches"] = build(f"""SELECT pair_id, direction, ((rn - 1) // 8)::BIGINT AS batch_id
FROM (SELECT pair_id, direction,
        row_number() OVER (ORDER BY {_key('pair_id', 'direction')}, pair_id, direction) AS rn
      FROM pairs)""", "pairs")
ORACLE["a07_direction_counts"] = build(
    "SELECT direction, count(*)::BIGINT AS n FROM pairs GROUP BY direction", "pairs")
ORACLE["a19_cleaning_summary"] = build("""SELECT count(*)::BIGINT AS input_rows,
  count(*) FILTER (WHERE first_fail IS NULL)::BIGINT AS final_rows,
  (count(*) - count(*) FILTER (WHERE first_fail IS NULL))::BIGINT AS dropped_rows,
  round(count(*) FILTER (WHERE first_fail IS NULL) * 100.0 / greatest(count(*), 1), 4) AS kept_pct
FROM _ff""", "_ff")
ORACLE["a20_inspect"] = build("""SELECT count(*)::BIGINT AS n_rows, 'pair_id,src,tgt' AS columns,
  min(pair_id) AS first_pair_id,
  (SELECT src FROM parallel_fx ORDER BY pair_id LIMIT 1) AS first_src,
  (SELECT tgt FROM parallel_fx ORDER BY pair_id LIMIT 1) AS first_tgt
FROM parallel_fx""", "parallel_fx")
ORACLE["s12_funnel_report"] = build("""SELECT step_no, step, dropped, remaining,
  round(dropped * 100.0 / greatest((SELECT count(*) FROM _ff), 1), 4) AS dropped_pct FROM funnel""",
                                    "funnel")
ORACLE["l01_sample_k"] = build(f"""SELECT pair_id, source, target, direction FROM pairs
ORDER BY {_key('pair_id', 'direction')}, pair_id, direction LIMIT 256""", "pairs")
ORACLE["l02_sample_per_direction"] = build(f"""SELECT pair_id, direction, stratum, source FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum
           ORDER BY {_key('pair_id', 'direction', 'stratum')}, pair_id, direction) AS rn FROM (
    SELECT *, 'src2tgt' AS stratum FROM prompts WHERE contains(source, '{SRC_LANG} to {TGT_LANG}')
    UNION ALL
    SELECT *, 'tgt2src' AS stratum FROM prompts WHERE contains(source, '{TGT_LANG} to {SRC_LANG}')))
WHERE rn <= 5000""", "prompts")


# ------------------------------------------------------------ metric fixtures and statistics

from bitextkit.operators import mt_metrics as _M  # noqa: E402
from bitextkit.plans.fixtures import (ALL_MASKED_MOD, HYP_EMPTY_MOD, HYP_EQUAL_MOD,  # noqa: E402
                                      LABEL_MASK_MOD, LEDGER_NO_TRACK_MOD, LEDGER_NULL_MOD,
                                      NULL_DIR_MOD, GRID)


def _drop_every(x: str, k) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w, i: i % {k} <> 0), ' ')"


cte("hyps", f"""SELECT id, pair_id, source,
  CASE WHEN id % {NULL_DIR_MOD} = 0 THEN NULL ELSE direction END AS direction,
  target AS ref,
  CASE WHEN id % {HYP_EMPTY_MOD} = 0 THEN '' WHEN id % {HYP_EQUAL_MOD} = 0 THEN target
       ELSE {_drop_every('target', 5)} END AS hyp_a,
  {_drop_every('target', 3)} AS hyp_b
FROM (SELECT *, pair_id * 2 + CASE WHEN direction = 'tgt2src' THEN 1 ELSE 0 END AS id FROM pairs)""",
    ["pairs"])


# order codes of the gram table: BLEU 1..4, characters 11..16, words 21..22
_CHAR_CODES = [10 + n for n in range(1, 7)]
_WORD_CODES = [20 + n for n in range(1, 3)]


def stats_ctes(p: str, src: str, id_expr: str, hyp: str, ref: str, keep: list[str],
               deps: list[str]) -> str:
    """Register CTEs {p}_u, {p}_g, {p}_m, {p}_stats: per-sentence statistics
    computed the plain way (lateral ranges over positions, GROUP BY gram)."""
    kc = "".join(f", {k}" for k in keep)
    cte(f"{p}_u", f"""SELECT {id_expr} AS id{kc},
  {S.tokenize_13a(hyp)} AS tok_h, {S.tokenize_13a(ref)} AS tok_r,
  {S.chrf_chars(hyp)} AS chr_h, {S.chrf_chars(ref)} AS chr_r,
  {S.chrf_words(hyp)} AS wrd_h, {S.chrf_words(ref)} AS wrd_r FROM {src}""", deps)
    parts = []
    for side in ("h", "r"):
        parts.append(f"""SELECT id, '{side}' AS side, n AS o, array_to_string(tok_{side}[p:p + n - 1], ' ') AS g
  FROM {p}_u, range(1, len(tok_{side}) + 1) rp(p), range(1, 5) rn(n) WHERE p + n - 1 <= len(tok_{side})""")
        parts.append(f"""SELECT id, '{side}', 10 + n, substring(chr_{side}, p, n)
  FROM {p}_u, range(1, length(chr_{side}) + 1) rp(p), range(1, 7) rn(n) WHERE p + n - 1 <= length(chr_{side})""")
        parts.append(f"""SELECT id, '{side}', 20 + n, array_to_string(wrd_{side}[p:p + n - 1], ' ')
  FROM {p}_u, range(1, len(wrd_{side}) + 1) rp(p), range(1, 3) rn(n) WHERE p + n - 1 <= len(wrd_{side})""")
    cte(f"{p}_g", "\nUNION ALL ".join(parts), [f"{p}_u"])
    codes = _M.BLEU_CODES + _CHAR_CODES + _WORD_CODES
    piv = ", ".join(f"sum(least(hc, rc)) FILTER (WHERE o = {c}) AS m{c}" for c in codes)
    cte(f"{p}_m", f"""SELECT id, {piv} FROM (
  SELECT id, o, g, count(*) FILTER (WHERE side = 'h') AS hc, count(*) FILTER (WHERE side = 'r') AS rc
  FROM {p}_g GROUP BY id, o, g) GROUP BY id""", [f"{p}_g"])
    cols = [f"len(tok_h)::BIGINT AS bleu_hyp_len", f"len(tok_r)::BIGINT AS bleu_ref_len"]
    for n in _M.BLEU_CODES:
        cols.append(f"coalesce(m.m{n}, 0)::BIGINT AS bleu_m{n}")
        cols.append(f"greatest(len(tok_h) - {n} + 1, 0)::BIGINT AS bleu_t{n}")
    k = 0
    for hcol, rcol, codes_k, fn in (("chr_h", "chr_r", _CHAR_CODES, "length"),
                                    ("wrd_h", "wrd_r", _WORD_CODES, "len")):
        for code in codes_k:
            k += 1
            n = code % 10
            rc = f"greatest({fn}({rcol}) - {n} + 1, 0)"
            cols.append(f"(CASE WHEN {rc} > 0 THEN greatest({fn}({hcol}) - {n} + 1, 0) ELSE 0 END)::BIGINT AS chrf_h{k}")
            cols.append(f"{rc}::BIGINT AS chrf_r{k}")
            cols.append(f"coalesce(m.m{code}, 0)::BIGINT AS chrf_m{k}")
    kc2 = "".join(f", u.{kk}" for kk in keep)
    cte(f"{p}_stats", f"SELECT u.id{kc2}, {', '.join(cols)} FROM {p}_u u LEFT JOIN {p}_m m ON m.id = u.id",
        [f"{p}_u", f"{p}_m"])
    return f"{p}_stats"


stats_ctes("sa", "hyps", "id", "hyp_a", "ref", ["direction"], ["hyps"])
stats_ctes("sb", "hyps", "id", "hyp_b", "ref", [], ["hyps"])


def _list(name: str, ks) -> str:
    return "[" + ", ".join(f"{name}{k}::DOUBLE" for k in ks) + "]"


# The published definitions, written for DuckDB's lists apart from the engine's formulas.
_m, _t = _list("bleu_m", range(1, 5)), _list("bleu_t", range(1, 5))
_bp = ("CASE WHEN bleu_hyp_len >= bleu_ref_len THEN 1.0 WHEN bleu_hyp_len > 0 "
       "THEN exp(1.0 - bleu_ref_len::DOUBLE / bleu_hyp_len) ELSE 0.0 END")
_logs = (f"list_sum(list_transform([1, 2, 3, 4], lambda n: CASE WHEN ({_t})[n] = 0 THEN 0.0::DOUBLE "
         f"WHEN ({_m})[n] > 0 THEN ln(100 * ({_m})[n] / ({_t})[n]) "
         f"ELSE ln(100 / (pow(2::DOUBLE, len(list_filter(({_m})[1:n], lambda x: x = 0))) * ({_t})[n])) END))")
_BLEU_EFF = (f"(CASE WHEN list_sum({_m}) = 0 THEN 0.0::DOUBLE ELSE ({_bp}) * exp({_logs} "
             f"/ len(list_filter({_t}, lambda x: x > 0))) END)")
_BLEU = (f"(CASE WHEN list_sum({_m}) = 0 OR bleu_t4 = 0 THEN 0.0::DOUBLE ELSE ({_bp}) * exp({_logs} / 4) END)")
_h, _r, _c = (_list(f"chrf_{x}", range(1, 9)) for x in "hrm")
_used = f"list_filter(range(1, 9), lambda k: ({_h})[k] > 0 AND ({_r})[k] > 0)"
_prec = f"list_avg(list_transform({_used}, lambda k: ({_c})[k] / ({_h})[k]))"
_rec = f"list_avg(list_transform({_used}, lambda k: ({_c})[k] / ({_r})[k]))"
_CHRF = (f"(CASE WHEN len({_used}) = 0 OR {_prec} + {_rec} = 0 THEN 0.0::DOUBLE "
         f"ELSE 100 * 5 * {_prec} * {_rec} / (4 * {_prec} + {_rec}) END)")
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in _M.STAT_COLS_BLEU + _M.STAT_COLS_CHRF)

ORACLE["a01_corpus_bleu"] = build(f"""SELECT n, round({_BLEU}, 4) AS bleu, round({_BLEU_EFF}, 4) AS bleu_effective
FROM (SELECT count(*)::BIGINT AS n, {_SUMS} FROM sa_stats)""", "sa_stats")
ORACLE["a02_corpus_chrf"] = build(f"""SELECT n, round({_CHRF}, 4) AS chrf
FROM (SELECT count(*)::BIGINT AS n, {_SUMS} FROM sa_stats)""", "sa_stats")
ORACLE["j03_clipped_matches"] = build(
    "SELECT id, bleu_hyp_len, bleu_ref_len, " + ", ".join(f"bleu_m{n}" for n in _M.BLEU_CODES)
    + ", " + ", ".join(f"chrf_m{k}" for k in range(1, 9)) + " FROM sa_stats", "sa_stats")
ORACLE["a06_evaluate_by_direction"] = build(f"""SELECT direction, n, round({_BLEU}, 4) AS bleu,
  round({_BLEU_EFF}, 4) AS bleu_eff, round({_CHRF}, 4) AS chrf FROM (
  SELECT direction, count(*)::BIGINT AS n, {_SUMS} FROM sa_stats WHERE direction IS NOT NULL GROUP BY direction
  UNION ALL SELECT 'overall', count(*)::BIGINT, {_SUMS} FROM sa_stats)""", "sa_stats")
ORACLE["a06_evaluate_by_direction_matched"] = build(f"""SELECT direction, n, round({_BLEU}, 4) AS bleu,
  round({_BLEU_EFF}, 4) AS bleu_eff, round({_CHRF}, 4) AS chrf FROM (
  SELECT direction, count(*)::BIGINT AS n, {_SUMS} FROM sa_stats WHERE direction IS NOT NULL GROUP BY direction
  UNION ALL SELECT 'overall', count(*)::BIGINT, {_SUMS} FROM sa_stats WHERE direction IS NOT NULL)""",
    "sa_stats")


# METEOR: exact alignment by k-th-last occurrence, chunks by lag
def _meteor_ctes(p: str, hyp: str, ref: str, src: str = "hyps"):
    for side, col in (("h", hyp), ("r", ref)):
        cte(f"{p}_{side}t", f"""SELECT id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos
FROM (SELECT id, list_transform({S.ws_tokens(f"coalesce({col}, '')")}, lambda t: lower(t)) AS toks FROM {src})""",
            [src])
    cte(f"{p}_al", f"""SELECT h.id, h.pos AS hyp_pos, r.pos AS ref_pos FROM
  (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY pos DESC) AS k FROM {p}_ht) h
  JOIN (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY pos DESC) AS k FROM {p}_rt) r
  ON h.id = r.id AND h.word = r.word AND h.k = r.k""", [f"{p}_ht", f"{p}_rt"])
    cte(f"{p}_ch", f"""SELECT id, count(*)::BIGINT AS m,
  (1 + sum(CASE WHEN hyp_pos <> ph + 1 OR ref_pos <> pr + 1 THEN 1 ELSE 0 END))::BIGINT AS chunks
FROM (SELECT *, lag(hyp_pos) OVER (PARTITION BY id ORDER BY hyp_pos) AS ph,
             lag(ref_pos) OVER (PARTITION BY id ORDER BY hyp_pos) AS pr FROM {p}_al) GROUP BY id""",
        [f"{p}_al"])
    a, b = '0.9', '0.1'
    cte(f"{p}_sent", f"""SELECT s.id, s.direction, s.hyp_len, s.ref_len, coalesce(c.m, 0)::BIGINT AS m,
  coalesce(c.chunks, 0)::BIGINT AS chunks,
  CASE WHEN coalesce(c.m, 0) = 0 THEN 0.0::DOUBLE ELSE
    (1.0::DOUBLE - 0.5::DOUBLE * pow(c.chunks::DOUBLE / c.m, 3.0::DOUBLE))
    * ((c.m::DOUBLE / s.hyp_len) * (c.m::DOUBLE / s.ref_len)
       / ({a}::DOUBLE * (c.m::DOUBLE / s.hyp_len) + {b}::DOUBLE * (c.m::DOUBLE / s.ref_len))) END AS meteor
FROM (SELECT id, direction, len({S.ws_tokens(f"coalesce({hyp}, '')")})::BIGINT AS hyp_len,
             len({S.ws_tokens(f"coalesce({ref}, '')")})::BIGINT AS ref_len FROM {src}) s
LEFT JOIN {p}_ch c ON c.id = s.id""", [f"{p}_ch", src])


_meteor_ctes("ma", "hyp_a", "ref")
ORACLE["a03_corpus_meteor"] = build(
    "SELECT count(*)::BIGINT AS n, round(avg(meteor) * 100.0, 4) AS meteor FROM ma_sent", "ma_sent")
ORACLE["j04_meteor_alignment"] = build(
    "SELECT id, hyp_len, ref_len, m, chunks, round(meteor, 6) AS meteor FROM ma_sent", "ma_sent")
def _unit_tokens(col: str) -> str:
    vec = ("list_transform(range(0, 8), lambda k: len(list_filter(string_split(tok, ''), "
           "lambda c: unicode(c) % 8 = k))::DOUBLE)")
    return (f"SELECT id, pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ("
            f"SELECT id, pos, {vec} AS v FROM (SELECT id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos "
            f"FROM (SELECT id, {S.ws_tokens(f"coalesce({col}, '')")} AS t FROM hyps)))")


cte("_be", f"""SELECT h.id, h.pos AS hp, r.pos AS rp, list_dot_product(h.v, r.v) AS s
FROM ({_unit_tokens("hyp_a")}) h JOIN ({_unit_tokens("ref")}) r ON h.id = r.id""", ["hyps"])
cte("_bf", """SELECT id, p, q FROM (SELECT id, avg(m) AS p FROM (
  SELECT id, hp, max(s) AS m FROM _be GROUP BY id, hp) GROUP BY id) JOIN (SELECT id, avg(m) AS q FROM (
  SELECT id, rp, max(s) AS m FROM _be GROUP BY id, rp) GROUP BY id) USING (id)""", ["_be"])
_bert = """SELECT 'bertscore' AS metric, round(avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END) * 100.0, 4)
  AS score FROM hyps LEFT JOIN _bf USING (id)"""
ORACLE["a05_metric_bundle"] = build(f"""SELECT 'bleu' AS metric, round({_BLEU}, 4) AS score
  FROM (SELECT {_SUMS} FROM sa_stats)
UNION ALL SELECT 'chrf', round({_CHRF}, 4) FROM (SELECT {_SUMS} FROM sa_stats)
UNION ALL SELECT 'meteor', round(avg(meteor) * 100.0, 4) FROM ma_sent
UNION ALL {_bert}""", "sa_stats", "ma_sent", "_bf")
ORACLE["a05_metric_subset"] = build(f"""SELECT 'chrf' AS metric, round({_CHRF}, 4) AS score
  FROM (SELECT {_SUMS} FROM sa_stats) UNION ALL {_bert}""", "sa_stats", "_bf")
ORACLE["j01_pair_predictions"] = build("""SELECT id, prediction, ref, direction,
  CASE WHEN p.id IS NOT NULL AND r.id IS NOT NULL THEN 'matched'
       WHEN p.id IS NULL THEN 'missing_prediction' ELSE 'missing_reference' END AS status
FROM (SELECT id, hyp_a AS prediction FROM hyps WHERE id % 11 <> 0) p
FULL OUTER JOIN (SELECT id, ref, direction FROM hyps WHERE id % 23 <> 5) r USING (id)""", "hyps")

# ------------------------------------------------------------ embeddings


def _cos(a: str, b: str) -> str:
    A, B = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    return (f"(list_dot_product({A}, {B}) / (greatest(sqrt(list_dot_product({A}, {A})), 1e-8)"
            f" * greatest(sqrt(list_dot_product({B}, {B})), 1e-8)))")


cte("tok_emb", "SELECT vec_id // 10 AS sent_id, (vec_id % 2)::INTEGER AS side, "
               "((vec_id % 10) // 2)::INTEGER AS pos, embedding AS vec FROM embeddings")
cte("_gm", f"""SELECT sent_id, avg(best) FILTER (WHERE side = 0) AS p, avg(best) FILTER (WHERE side = 1) AS r
FROM (SELECT a.sent_id, a.side, a.pos, max({_cos('a.vec', 'b.vec')}) AS best
      FROM tok_emb a JOIN tok_emb b ON a.sent_id = b.sent_id AND a.side <> b.side
      GROUP BY a.sent_id, a.side, a.pos) GROUP BY sent_id""", ["tok_emb"])
ORACLE["a04_greedy_match"] = build("""SELECT sent_id, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM _gm""", "_gm")
ORACLE["a04_bertscore_f1"] = build(
    "SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) * 100.0, 4) AS bertscore_f1 FROM _gm",
    "_gm")
cte("vec_pairs", """SELECT e1.vec_id, e1.embedding AS a, e2.embedding AS b
FROM embeddings e1 JOIN embeddings e2 ON e2.vec_id = e1.vec_id + 1
UNION ALL SELECT -1, list_transform(embedding, lambda x: 0.0::FLOAT), embedding FROM embeddings WHERE vec_id = 0""")
cte("vp_cos", f"SELECT vec_id, {_cos('a', 'b')} AS c FROM vec_pairs", ["vec_pairs"])
ORACLE["a08_cosine"] = build("SELECT vec_id, round(c, 6) AS cosine FROM vp_cos", "vp_cos")
ORACLE["a09_gamma_reward"] = build(
    "SELECT vec_id, round(c * exp(-1.0::DOUBLE * c), 6) AS reward_phi1, "
    "round(c * exp(-2.0::DOUBLE * c), 6) AS reward_phi2 FROM vp_cos", "vp_cos")
ORACLE["u03_with_reward"] = build(
    "SELECT vec_id, round(c * exp(-1.0::DOUBLE * c), 6) AS reward FROM vp_cos", "vp_cos")
_PHIS = "[" + ", ".join(f"{p!r}::DOUBLE" for p in (0.1, 0.5, 1.0, 2.0)) + "]"
cte("phi_rows", f"SELECT vec_id, phi, c * exp(-phi * c) AS reward FROM vp_cos, "
                f"(SELECT unnest({_PHIS}) AS phi)", ["vp_cos"])
ORACLE["j07_phi_sweep"] = build("SELECT vec_id, phi, round(reward, 6) AS reward FROM phi_rows",
                                "phi_rows")
ORACLE["a10_mean_reward_by_phi"] = build("""SELECT phi, count(*)::BIGINT AS n,
  round(avg(reward), 6) AS mean_reward, round(avg(reward) + 0.1::DOUBLE, 4) AS weight
FROM phi_rows GROUP BY phi""", "phi_rows")
cte("token_lp", f"""SELECT vec_id, list_transform(embedding, lambda x: -abs(x::DOUBLE) * 5.0::DOUBLE) AS token_lp,
  list_transform(range(0, len(embedding)), lambda i: CASE WHEN vec_id % {ALL_MASKED_MOD} = 0
     OR i % {LABEL_MASK_MOD} = 0 THEN -100 ELSE i END) AS labels FROM embeddings""")
cte("seq_lp", """SELECT vec_id, list_sum(list_transform(token_lp, lambda x, i: CASE WHEN labels[i] <> -100
  THEN x ELSE 0.0::DOUBLE END)) / greatest(len(list_filter(labels, lambda l: l <> -100)), 1)::DOUBLE AS logp
FROM token_lp""", ["token_lp"])
ORACLE["a11_seq_logprob"] = build("SELECT vec_id, round(logp, 6) AS logp FROM seq_lp", "seq_lp")
cte("reward_rows", f"""SELECT v.vec_id, c * exp(-1.0::DOUBLE * c) AS reward, l.logp,
  (row_number() OVER (ORDER BY {_key('v.vec_id')}, v.vec_id) - 1) // 8 AS batch_id
FROM vp_cos v JOIN seq_lp l ON l.vec_id = v.vec_id""", ["vp_cos", "seq_lp"])
cte("reinforce_loss", """SELECT batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n,
  -avg((reward - rbar) * logp) AS reinforce_loss
FROM (SELECT *, avg(reward) OVER (PARTITION BY batch_id) AS rbar FROM reward_rows) GROUP BY batch_id""",
    ["reward_rows"])
ORACLE["a12_reinforce_loss"] = build(
    "SELECT batch_id, n, round(reinforce_loss, 6) AS reinforce_loss FROM reinforce_loss", "reinforce_loss")
cte("pref_lp", """SELECT a.vec_id AS id, a.logp AS pp, b.logp AS rp, c.logp AS pu, d.logp AS ru
FROM seq_lp a JOIN seq_lp b ON b.vec_id = a.vec_id + 1 JOIN seq_lp c ON c.vec_id = a.vec_id + 2
JOIN seq_lp d ON d.vec_id = a.vec_id + 3""", ["seq_lp"])


def _nls(z: str) -> str:
    return f"(-(least({z}, 0.0::DOUBLE) - ln(1.0::DOUBLE + exp(-abs({z})))))"


_Z = "(0.1::DOUBLE * ((pp - rp) - (pu - ru)))"
cte("dpo_loss", f"""SELECT batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n, avg({_nls(_Z)}) AS dpo_loss
FROM (SELECT *, (row_number() OVER (ORDER BY {_key('id')}, id) - 1) // 8 AS batch_id FROM pref_lp)
GROUP BY batch_id""", ["pref_lp"])
ORACLE["a13_dpo_loss"] = build(
    "SELECT batch_id, n, round(dpo_loss, 6) AS dpo_loss FROM dpo_loss", "dpo_loss")
ORACLE["a14_combined_loss"] = build("""SELECT d.batch_id, round(d.dpo_loss, 6) AS dpo_loss, round(h.reinforce_loss, 6) AS reinforce_loss,
  round(0.5::DOUBLE * d.dpo_loss + 0.5::DOUBLE * h.reinforce_loss, 6) AS total_loss
FROM dpo_loss d JOIN reinforce_loss h ON h.batch_id = d.batch_id""", "dpo_loss", "reinforce_loss")
ORACLE["a15_epoch_summary"] = build(f"""SELECT epoch, count(*)::BIGINT AS batches, round(avg(l), 6) AS mean_dpo_loss
FROM (SELECT epoch, batch_id, avg({_nls(_Z)}) AS l FROM (
  SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY {_key('id', 'epoch')}, id) - 1) // 8 AS batch_id
  FROM pref_lp, (SELECT unnest([0, 1]) AS epoch)) GROUP BY epoch, batch_id) GROUP BY epoch""", "pref_lp")

# ------------------------------------------------------------ significance
cte("scores", """SELECT a.id, a.s AS score_a, b.s AS score_b FROM
  (SELECT id, round(""" + _CHRF + """ * 10000.0::DOUBLE)::BIGINT AS s FROM sa_stats) a JOIN
  (SELECT id, round(""" + _CHRF + """ * 10000.0::DOUBLE)::BIGINT AS s FROM sb_stats) b ON a.id = b.id""",
    ["sa_stats", "sb_stats"])
ORACLE["j05_paired_scores"] = build("SELECT id, score_a, score_b FROM scores", "scores")
# splitmix64 in 128-bit arithmetic, modulo 2^64.
def _mix_step(x, shift, times):
    return f"((xor({x}, {x} >> {shift})::UHUGEINT * {times}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


cte("coin_rows", """SELECT (row_number() OVER (ORDER BY id) - 1) // 64 AS blk, (row_number() OVER (ORDER BY id) - 1) % 64 AS j,
  score_a - score_b AS d FROM scores""", ["scores"])
cte("coin_words", f"""SELECT blk, trial, xor(z2, z2 >> 31) AS w FROM (
  SELECT blk, trial, {_mix_step('z1', 27, 0x94D049BB133111EB)} AS z2 FROM (
    SELECT blk, trial, {_mix_step('z0', 30, 0xBF58476D1CE4E5B9)} AS z1 FROM (
      SELECT blk, trial, ((blk::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT + trial::UHUGEINT * {0xD1B54A32D192ED03}::UHUGEINT + 42)
        % 18446744073709551616::UHUGEINT)::UBIGINT AS z0
      FROM (SELECT DISTINCT blk FROM coin_rows), range(0, 10000) t(trial))))""", ["coin_rows"])
ORACLE["a16_randomization_test"] = build("""SELECT hits, trials, hits::DOUBLE / trials AS p_value, observed_abs_sum
FROM (SELECT count(*) FILTER (WHERE abs(s) >= (SELECT abs(sum(score_a - score_b)) FROM scores))::BIGINT AS hits,
             count(*)::BIGINT AS trials,
             (SELECT abs(sum(score_a - score_b)) FROM scores)::BIGINT AS observed_abs_sum
      FROM (SELECT trial, sum(CASE WHEN (w >> j::UBIGINT) & 1 = 1 THEN -d ELSE d END) AS s
            FROM coin_words JOIN coin_rows USING (blk) GROUP BY trial))""", "coin_words", "scores")
ORACLE["a17_cohens_d"] = build("""SELECT count(*)::BIGINT AS n,
  round(avg(d) / (stddev_samp(d) + 1e-10), 6) AS cohens_d, round(avg(d), 6) AS mean_diff
FROM (SELECT (score_a - score_b)::DOUBLE / 10000.0::DOUBLE AS d FROM scores)""", "scores")

# ------------------------------------------------------------ inference
_sent = "regexp_replace(source, '^translate [^:]*: ', '')"
cte("gen3", f"""SELECT pair_id, source, target AS preferred, direction,
  {S.strip_ws(_drop_every(_sent, 3))} AS unpreferred FROM pairs""", ["pairs"])
ORACLE["u01_generate_rejected"] = build(
    "SELECT pair_id, source, preferred, direction, unpreferred FROM gen3", "gen3")
ORACLE["p07_to_dpo"] = build(
    "SELECT pair_id, direction, source AS prompt, preferred AS chosen, unpreferred AS rejected FROM gen3",
    "gen3")
ORACLE["p15_tokenize_pairs"] = build(
    f"SELECT pair_id, direction, array_to_string(({S.ws_tokens('source')})[1:8], ' ') AS input_tokens, "
    f"array_to_string(({S.ws_tokens('target')})[1:6], ' ') AS label_tokens FROM pairs", "pairs")
ORACLE["u05_model_reward"] = build(
    "SELECT id, round((length(ref) + 1)::DOUBLE / (length(hyp_a) + 1), 6) AS reward FROM hyps", "hyps")
ORACLE["l03_inspection_sample"] = build(f"""SELECT id, source, ref AS reference, hyp_a AS prediction, direction
FROM hyps ORDER BY {_key('id')}, id LIMIT 30""", "hyps")

# ------------------------------------------------------------ sweep
_grid_rows = [f"({i}, {nb}, {ml}, {lp!r}::DOUBLE, {rp!r}::DOUBLE)"
              for i, (nb, ml, lp, rp) in enumerate(itertools.product(*GRID.values()))]
cte("grid", "SELECT * FROM (VALUES " + ", ".join(_grid_rows)
    + ") AS g(config_id, num_beams, max_length, length_penalty, repetition_penalty)")
cte("sw_out", f"""SELECT h.id, g.config_id, h.ref,
  {S.strip_ws("array_to_string(CASE WHEN g.length_penalty < 1 AND len(w) > 1 THEN w[1:len(w) - 1] ELSE w END, ' ')")} AS hyp
FROM (SELECT h.*, g.config_id AS cfg, list_filter(string_split({_sent.replace('source', 'h.source')}, ' '),
        lambda x, i: i % (g.num_beams // 2 + 1 + CASE WHEN g.repetition_penalty > 1 THEN 1 ELSE 0 END) <> 0)
        [1:g.max_length // 8] AS w
      FROM hyps h, grid g) h JOIN grid g ON g.config_id = h.cfg""", ["hyps", "grid"])
# equal outputs of a sentence are scored once
cte("sw_in", "SELECT row_number() OVER (ORDER BY id, hyp) AS sid, id, hyp, any_value(ref) AS ref FROM sw_out GROUP BY id, hyp",
    ["sw_out"])
stats_ctes("sw", "sw_in", "sid", "hyp", "ref", [], ["sw_in"])
cte("sweep", f"""SELECT g.config_id, g.num_beams, g.max_length, g.length_penalty, g.repetition_penalty,
  round({_BLEU_EFF}, 4) AS bleu, round({_CHRF}, 4) AS chrf
FROM (SELECT config_id, {_SUMS} FROM sw_stats t JOIN sw_in i ON i.sid = t.id
      JOIN sw_out o ON o.id = i.id AND o.hyp = i.hyp GROUP BY config_id) s JOIN grid g ON g.config_id = s.config_id""",
    ["sw_stats", "sw_in", "sw_out", "grid"])
ORACLE["u06_sweep"] = build("SELECT * FROM sweep", "sweep")
ORACLE["a18_best_decode"] = build("SELECT * FROM sweep ORDER BY bleu DESC, config_id LIMIT 1", "sweep")
ORACLE["l04_top_decodes"] = build("SELECT * FROM sweep ORDER BY bleu DESC, config_id LIMIT 10", "sweep")
ORACLE["j06_param_grid"] = build("SELECT (SELECT count(*) FROM hyps) AS n, g.* FROM grid g", "hyps", "grid")

# ------------------------------------------------------------ ledger
cte("ledger", f"""SELECT event_id AS iter,
  CASE WHEN event_id % {LEDGER_NO_TRACK_MOD} = 0 THEN NULL ELSE event_type END AS track,
  CASE WHEN event_id % {LEDGER_NULL_MOD} = 0 THEN NULL ELSE value END AS value FROM events""")
ORACLE["a18_best_run"] = build("SELECT * FROM ledger ORDER BY value DESC NULLS LAST, iter LIMIT 1", "ledger")
ORACLE["l04_top_k"] = build("SELECT * FROM ledger ORDER BY value DESC NULLS LAST, iter LIMIT 10", "ledger")
ORACLE["w06_running_best"] = build("""SELECT iter, track, value, prev_best,
  CASE WHEN prev_best IS NULL THEN value WHEN value IS NULL THEN prev_best ELSE greatest(prev_best, value) END
    AS best_so_far,
  (value IS NOT NULL AND (prev_best IS NULL OR value > prev_best)) AS keep
FROM (SELECT *, max(value) OVER (PARTITION BY track ORDER BY iter
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM ledger)""", "ledger")
ORACLE["w07_gap_to"] = build("""SELECT l.iter, l.track, round(l.value - b.baseline, 6) AS gap_to_baseline,
  round(l.value - 25.0::DOUBLE, 6) AS gap_to_target
FROM ledger l LEFT JOIN (SELECT track, arg_min(value, iter) AS baseline FROM ledger
                         WHERE value IS NOT NULL GROUP BY track) b ON b.track IS NOT DISTINCT FROM l.track""", "ledger")
ORACLE["j08_metric_delta"] = """SELECT metric, round(b, 6) AS baseline, round(c, 6) AS candidate,
  round(c - b, 6) AS delta
FROM (SELECT event_type AS metric, avg(value) FILTER (WHERE event_id % 2 = 0) AS b,
             avg(value) FILTER (WHERE event_id % 2 <> 0) AS c FROM events GROUP BY event_type)"""

# ------------------------------------------------------------ B2 dialogue funnel
cte("dialogue", """SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS src, a.text AS tgt
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")
cte("dnorm", f"SELECT pair_id, {S.norm_text('src')} AS src, {S.norm_text('tgt')} AS tgt FROM dialogue",
    ["dialogue"])
cte("_dff", f"""SELECT pair_id, src, tgt,
  CASE WHEN pre IS NOT NULL THEN pre WHEN rn > 1 THEN 'duplicate' ELSE post END AS first_fail
FROM (SELECT *, {S.pre_fail()} AS pre, {S.post_fail()} AS post,
        row_number() OVER (PARTITION BY src, tgt ORDER BY pair_id) AS rn FROM dnorm)""", ["dnorm"])
ORACLE["f07_dialogue_funnel"] = build(f"""SELECT st.step_no::BIGINT AS step_no, st.step,
  coalesce(c.n, 0)::BIGINT AS dropped,
  ((SELECT count(*) FROM _dff) - sum(coalesce(c.n, 0)) OVER (ORDER BY st.step_no))::BIGINT AS remaining
FROM {STEPS_VALUES}
LEFT JOIN (SELECT first_fail, count(*) AS n FROM _dff GROUP BY first_fail) c ON c.first_fail = st.step""",
                                      "_dff")

# ------------------------------------------------------------ sources and sinks
_NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', " \
      "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
ORACLE["s01_read_tolerant_csv"] = build(
    f"SELECT CASE WHEN src IN {_NA} THEN NULL ELSE src END AS src, CASE WHEN tgt IN {_NA} THEN NULL ELSE tgt END AS tgt "
    f"FROM parallel_fx", "parallel_fx")
ORACLE["s02_read_strict_csv"] = build("SELECT src, tgt FROM parallel_fx", "parallel_fx")
ORACLE["s03_csv_quality"] = build(
    "SELECT count(*)::BIGINT AS raw_lines, count(*)::BIGINT AS parsed, 0::BIGINT AS malformed FROM parallel_fx",
    "parallel_fx")
ORACLE["s01_read_multi_line_csv"] = """SELECT '"' || doc_id || '",' AS src, length(t) AS n_chars, md5(t) AS text_md5
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g') AS t FROM documents)"""
ORACLE["s04_load_jsonl"] = build("SELECT src AS source, tgt AS target FROM clean", "clean")
ORACLE["s05_triplet_round_trip"] = build("SELECT source, preferred, unpreferred, direction FROM gen3", "gen3")
ORACLE["s06_line_pairs"] = build(
    f"SELECT {S.strip_ws('hyp_a')} AS prediction, {S.strip_ws('ref')} AS reference FROM hyps", "hyps")
ORACLE["s07_read_ledger"] = build("SELECT iter, coalesce(track, 'main') AS track, value AS score FROM ledger", "ledger")
ORACLE["s08_scrape_metric"] = build("""SELECT arg_max(round(abs(value)::DECIMAL(24, 8), 2)::DOUBLE, iter) AS final_bleu,
  count(*)::BIGINT AS occurrences FROM ledger WHERE value IS NOT NULL""", "ledger")
ORACLE["s11_metrics_document"] = build(f"""SELECT d.direction, d.n, d.bleu, d.chrf, o.bleu AS overall_bleu, o.chrf AS overall_chrf
FROM (SELECT direction, n, round({_BLEU_EFF}, 4) AS bleu, round({_CHRF}, 4) AS chrf FROM (
      SELECT direction, count(*)::BIGINT AS n, {_SUMS} FROM sa_stats WHERE direction IS NOT NULL GROUP BY direction)) d,
  (SELECT round({_BLEU_EFF}, 4) AS bleu, round({_CHRF}, 4) AS chrf FROM (SELECT {_SUMS} FROM sa_stats)) o""", "sa_stats")
ORACLE["s13_split_round_trip"] = build("SELECT pair_id, direction, split FROM split3", "split3")

# ------------------------------------------------------------ promised by the reference, without code there
_bare = "regexp_replace(source, '^translate [^:]*: ', '')"
cte("sided", f"SELECT p.pair_id, p.direction, s.split, least({_bare}, p.target) AS k1, greatest({_bare}, p.target) AS k2 "
    "FROM pairs p JOIN split3 s ON s.pair_id = p.pair_id AND s.direction = p.direction", ["pairs", "split3"])
ORACLE["s210_leakage_exclusion"] = build(
    "SELECT pair_id, direction FROM sided a WHERE NOT EXISTS (SELECT 1 FROM sided t WHERE t.split = 'test' "
    "AND t.k1 = a.k1 AND t.k2 = a.k2)", "sided")
ORACLE["s210_shared_split"] = build(f"""SELECT p.pair_id, p.direction, g.split
FROM pairs p JOIN (
  SELECT pair_id, CASE WHEN place < floor(n * 0.8::DOUBLE) THEN 'train'
    WHEN place < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT pair_id, sum(w) OVER () AS n, coalesce(sum(w) OVER (ORDER BY {_key('pair_id')}, pair_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
        FROM (SELECT pair_id, count(*) AS w FROM pairs GROUP BY pair_id))) g ON g.pair_id = p.pair_id""", "pairs")

# The regularised incomplete beta function as its power series (the operator uses a continued fraction).
_TAIL = """(SELECT id, CASE WHEN flip THEN 1 - front * total / a ELSE front * total / a END AS p FROM (
  SELECT id, any_value(a) AS a, any_value(flip) AS flip,
    any_value(exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x))) AS front, sum(term) AS total
  FROM (SELECT *, exp(coalesce(sum(ln((a + b + m) / (a + 1 + m) * x)) OVER (PARTITION BY id ORDER BY m
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS term
        FROM (SELECT id, x0 > 0.9 AS flip, CASE WHEN x0 > 0.9 THEN 1 - x0 ELSE x0 END AS x,
                CASE WHEN x0 > 0.9 THEN b0 ELSE a0 END AS a, CASE WHEN x0 > 0.9 THEN a0 ELSE b0 END AS b FROM tails),
             range(0, 20000) AS r(m)) GROUP BY id))"""
_cells = """SELECT user_id, event_type, avg(value) AS x FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type"""
cte("cells", f"""SELECT * FROM ({_cells}) WHERE user_id IN (
  SELECT user_id FROM ({_cells}) GROUP BY user_id HAVING count(*) = 5)""")
cte("sums_of_squares", """SELECT count(DISTINCT user_id)::DOUBLE AS n, 5::DOUBLE AS k, sum((c.by_type - c.grand) ** 2) AS ss_systems,
  sum((c.by_user - c.grand) ** 2) AS ss_subjects, sum((c.x - c.by_user - c.by_type + c.grand) ** 2) AS ss_error
FROM (SELECT user_id, x, avg(x) OVER (PARTITION BY event_type) AS by_type, avg(x) OVER (PARTITION BY user_id) AS by_user,
        avg(x) OVER () AS grand FROM cells) c""", ["cells"])
cte("f_value", """SELECT *, (ss_systems / (k - 1)) / (ss_error / ((n - 1) * (k - 1))) AS f FROM sums_of_squares""", ["sums_of_squares"])
_F_TAILS = """(SELECT 1 AS id, (n - 1) * (k - 1) / ((n - 1) * (k - 1) + (k - 1) * f) AS x0,
  (n - 1) * (k - 1) / 2 AS a0, (k - 1) / 2 AS b0 FROM f_value)"""
ORACLE["s210_anova"] = build(f"""SELECT n::BIGINT AS n, (SELECT count(DISTINCT user_id) FROM events)::BIGINT - n::BIGINT AS n_dropped,
  k::BIGINT AS k, (k - 1)::BIGINT AS df_systems, ((n - 1) * (k - 1))::BIGINT AS df_error, round(ss_systems, 3) AS ss_systems,
  round(ss_subjects, 3) AS ss_subjects, round(ss_error, 3) AS ss_error, round(f, 6) AS f, round(p, 6) AS p_value
FROM f_value, {_TAIL.replace('FROM tails', 'FROM ' + _F_TAILS)}""", "f_value")
cte("t_value", """SELECT row_number() OVER (ORDER BY system_a, system_b) AS id, *, mean_diff / (s / sqrt(n)) AS t FROM (
  SELECT a.event_type AS system_a, b.event_type AS system_b, count(*) AS n, avg(a.x - b.x) AS mean_diff, stddev_samp(a.x - b.x) AS s
  FROM cells a JOIN cells b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2)""", ["cells"])
_T_TAILS = "(SELECT id, (n - 1) / (n - 1 + t * t) AS x0, (n - 1) / 2 AS a0, 0.5::DOUBLE AS b0 FROM t_value)"
ORACLE["s210_posthoc_t"] = build(f"""SELECT system_a, system_b, n, n - 1 AS df, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t,
  round(p, 6) AS p_value, round(max(least(1, step * p)) OVER (ORDER BY p, system_a, system_b), 6) AS p_holm
FROM (SELECT v.*, q.p, count(*) OVER () - row_number() OVER (ORDER BY q.p, system_a, system_b) + 1 AS step
      FROM t_value v JOIN {_TAIL.replace('FROM tails', 'FROM ' + _T_TAILS)} q ON q.id = v.id)""", "t_value")
