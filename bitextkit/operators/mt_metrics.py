"""Corpus MT metrics from sufficient statistics: BLEU (A01), chrF++ (A02),
metric bundle (A05), overall + per-direction rollups (A06), prediction /
reference pairing (J01) and clipped n-gram matches (J03).

Plan::

    rows(id, hyp, ref)
      -> Arrow batch: units (13a tokens, characters, words) of its different words,
         n-grams of all its sentences as numbers, clipped overlap per sentence
                                                         no row a gram, no exchange
      -> rollup(direction) sums -> closed-form score    partial aggregation, tiny

The units of a text are those of its words one after another, so each different word
of a batch is cut once.  The places of a slice are sorted by the units that follow
them inside their sentence: the occurrences of a gram stand together for every order
at once, and those of a gram that only one side has are left out of the longer ones.
Totals come from lengths, so empty hypotheses keep their brevity-penalty contribution.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextkit.functions.text import py_chrf_chars, py_chrf_words, py_tokenize_13a

BLEU_ORDER = 4      # fixed value: max n-gram order of BLEU
CHAR_ORDER = 6      # fixed values: chrF++ character and word orders, beta
WORD_ORDER = 2
CHRF_BETA = 2

BLEU_CODES = list(range(1, BLEU_ORDER + 1))
UNITS = 1 << 15     # units of both sides that are counted together: their sorts stay in a core's cache

SLICE_ROWS = 4096   # rows, and about the bytes, whose texts are laid out together
SLICE_BYTES = 4 << 20

KINDS = {"tok": BLEU_ORDER, "chr": CHAR_ORDER, "wrd": WORD_ORDER}     # kind of units -> their orders
WORD_CHARS = 64     # words of so many characters at most are kept with their units, the latest ones of a task


def _runs(first, length):
    """first, first + 1, ... of so many numbers a run, run after run."""
    import numpy as np
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def shared_grams(hyp, hyp_len, ref, ref_len, order: int):
    """The n-grams that both texts of a pair have.  ``hyp`` and ``ref`` are the units
    of all pairs as numbers from 0, one after another.

    Returns (start, pairs, orders): the place where each hypothesis begins; the pair of
    each place; an iterator over (n, at, size, ours, theirs): the places ``at`` where
    such grams begin, those of a gram together, ``size`` of each gram in all, ``ours``
    and ``theirs`` of both sides.  Places of hypotheses are below those of references."""
    import numpy as np
    n_pairs, gap = len(hyp_len), order - 1
    length = np.concatenate([hyp_len, ref_len]).astype(np.int64)
    start = np.cumsum(length + gap) - length - gap
    place = _runs(start, length)                     # a text is followed by ``gap`` places without a unit
    unit = np.concatenate([hyp, ref]).astype(np.int64) + 1
    pair = np.tile(np.arange(n_pairs), 2)
    size_of = int(length.sum()) + (len(length) + 1) * gap + 1
    bits, border = size_of.bit_length(), int(start[n_pairs]) if n_pairs else 0
    room = 63 - bits - n_pairs.bit_length()
    width = int(unit.max(initial=0)).bit_length()
    if width > room:
        unit = np.unique(unit, return_inverse=True)[1] + 1
        width = int(unit.max(initial=0)).bit_length()
    laid = np.zeros(size_of, dtype=np.int64)
    laid[place] = unit
    pairs = np.zeros(size_of, dtype=np.int64)
    pairs[place] = np.repeat(pair, length)

    def orders():
        step = max(1, min(order, room // max(width, 1)))     # units that a key holds beside pair and place
        at, rank, done = place, None, 0
        while len(at) and done < order:
            if rank is None:
                head, below, key = pairs[at], step * width, pairs[at]
                for j in range(step):
                    key = (key << width) | laid[at + j]
                wide = n_pairs.bit_length() + below + bits > 63
            else:                                    # so far equal units, then the rank of the next ``step``
                head, below, key = group, bits, (group << bits) | rank[at + done]
                wide = 3 * bits > 63
            if wide:
                by = np.argsort(key, kind="stable")
                key, at = key[by], at[by]
            else:
                key = np.sort((key << bits) | at)
                key, at = key >> bits, key & ((1 << bits) - 1)
            if rank is None and step < order:
                rank = np.zeros(size_of, dtype=np.int64)
                rank[at] = np.cumsum(np.r_[True, key[1:] != key[:-1]])
            head = key >> below
            same = np.r_[False, head[1:] == head[:-1]]       # as the place before, in the units so far
            for n in range(done + 1, min(done + step, order) + 1):
                u = laid[at + (n - 1)]
                same[1:] &= u[1:] == u[:-1]
                first = np.flatnonzero(~same)
                size = np.diff(first, append=len(at))
                before = np.r_[0, np.cumsum(at >= border)]
                theirs = before[first + size] - before[first]
                ours = size - theirs
                both = (theirs > 0) & (ours > 0) & (u[first] > 0)
                if not both.all():
                    stays = np.repeat(both, size)
                    at, same, size, ours, theirs = at[stays], same[stays], size[both], ours[both], theirs[both]
                if not len(at):
                    return
                yield n, at, size, ours, theirs
            done += step
            group = np.cumsum(~same)

    return start[:n_pairs], pairs, orders()


def clipped_matches(hyp, hyp_len, ref, ref_len, order: int):
    """Sum over grams of min(count in hyp, count in ref) for n = 1..order
    and every sentence (order x sentences).  ``hyp`` and ``ref`` are the units of
    all sentences as numbers, one after another."""
    import numpy as np
    n_pairs = len(hyp_len)
    out = np.zeros((order, n_pairs), dtype=np.int64)
    _, pairs, orders = shared_grams(hyp, hyp_len, ref, ref_len, order)
    for n, at, size, ours, theirs in orders:
        first = np.cumsum(size) - size
        out[n - 1] = np.bincount(pairs[at[first]], weights=np.minimum(ours, theirs), minlength=n_pairs)
    return out


def matches_of_beginnings(hyp, hyp_len, ref, ref_len, order: int, pair, units):
    """:func:`clipped_matches` of beginnings of the hypotheses: of the first ``units``
    units of the hypothesis ``pair``, for each of these (order x beginnings).

    A gram's occurrence counts if fewer than the reference has stand before it in its
    hypothesis, so sums up to a place are the matches of the text that ends there."""
    import numpy as np
    out = np.zeros((order, len(pair)), dtype=np.int64)
    start, _, orders = shared_grams(hyp, hyp_len, ref, ref_len, order)
    if not len(pair):
        return out
    border = int(start[-1]) + int(hyp_len[-1]) + order - 1      # the first place of a reference
    bits, begin = border.bit_length(), start[pair]
    for n, at, size, ours, theirs in orders:
        hit = np.zeros(border + 1, dtype=np.int64)
        own = at < border
        more = ours > theirs
        if more.any():
            doubt = np.repeat(more, size) & own
            places = np.sort((np.repeat(np.arange(len(size)), size)[doubt] << bits) | at[doubt])
            gram, places = places >> bits, places & ((1 << bits) - 1)
            kept = _runs(np.zeros(int(more.sum()), dtype=np.int64), ours[more]) < theirs[gram]
            hit[places[kept] + 1] = 1
            own &= ~doubt
        hit[at[own] + 1] = 1
        upto = np.cumsum(hit)
        out[n - 1] = upto[begin + np.maximum(units - n + 1, 0)] - upto[begin]
    return out


class _Numbers(dict):
    """Numbers of keys, in the order in which they are met."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _words(text: str) -> list[str]:
    # 13a joins lines at a dash: such a text is a word of its own
    return [text] if "\n" in text else text.split()


def _cutters(kinds) -> dict:
    """Kind of units -> the function that cuts a word; short words are kept with their units."""
    def cutter(cut):
        kept = functools.lru_cache(maxsize=1 << 16)(cut)
        return lambda w: kept(w) if len(w) <= WORD_CHARS else cut(w)
    return {k: cutter({"tok": py_tokenize_13a, "chr": py_chrf_chars, "wrd": py_chrf_words}[k]) for k in kinds}


class _Units:
    """Units of texts that are given as numbers of words."""

    def __init__(self, words, kind, cutter):
        import numpy as np
        cut = list(map(cutter, words))
        self.length = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        self.start = np.cumsum(self.length) - self.length
        if kind == "chr":
            code = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            seen = np.zeros(int(code.max(initial=0)) + 1, dtype=bool)
            seen[code] = True
            self.unit = (np.cumsum(seen) - 1)[code]
        else:
            number = _Numbers()
            units = map(number.__getitem__, itertools.chain.from_iterable(cut))
            self.unit = np.fromiter(units, dtype=np.int64, count=int(self.length.sum()))

    def of(self, words):
        """(units, units before each word and in all) of the texts."""
        import numpy as np
        length = self.length[words]
        return self.unit[_runs(self.start[words], length)], np.r_[0, np.cumsum(length)]


def _count_texts(hyps, refs, ref_of, cutters, pair=None, n_words=None) -> dict:
    """Totals and matches of the texts ``hyps``, given by their words, with the
    references ``refs[ref_of]``: {(kind, "h" or "r" or "m", n): numbers}; with ``pair``
    and ``n_words`` of the first ``n_words`` words of ``hyps[pair]``, for each of these."""
    import numpy as np
    number = _Numbers()
    count = np.fromiter(map(len, itertools.chain(hyps, refs)), dtype=np.int64, count=len(hyps) + len(refs))
    words = itertools.chain.from_iterable(itertools.chain(hyps, refs))
    flat, ends = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=int(count.sum())), np.r_[0, np.cumsum(count)]
    n_hyps, middle, out = len(hyps), int(ends[len(hyps)]), {}
    for kind, cutter in cutters.items():
        order, units = KINDS[kind], _Units(number, kind, cutter)
        (h, h_upto), (r, r_upto) = units.of(flat[:middle]), units.of(flat[middle:])
        h_ends, r_ends = h_upto[ends[:n_hyps + 1]], r_upto[ends[n_hyps:] - middle]
        hn, rn = np.diff(h_ends), np.diff(r_ends)[ref_of]
        of_n = hn if pair is None else h_upto[ends[pair] + n_words] - h_ends[pair]
        matches = np.zeros((order, len(of_n)), dtype=np.int64)
        total = np.r_[0, np.cumsum(hn + rn)]
        i = 0
        while i < n_hyps:                       # slices of so many units, one sentence at least
            j = max(i + 1, int(np.searchsorted(total, total[i] + UNITS, "right")) - 1)
            texts = h[h_ends[i]:h_ends[j]], hn[i:j], r[_runs(r_ends[ref_of[i:j]], rn[i:j])], rn[i:j]
            if pair is None:
                matches[:, i:j] = clipped_matches(*texts, order)
            else:
                a, b = np.searchsorted(pair, (i, j))
                matches[:, a:b] = matches_of_beginnings(*texts, order, pair[a:b] - i, of_n[a:b])
            i = j
        if pair is not None:
            hn, rn = of_n, rn[pair]
        for n in range(1, order + 1):
            out[kind, "h", n], out[kind, "r", n] = np.maximum(hn - n + 1, 0), np.maximum(rn - n + 1, 0)
            out[kind, "m", n] = matches[n - 1]
    return out


def _beginnings(texts: list[str]):
    """Which of the texts are others up to the end of a word: (the words of the others,
    the number of the one that a text begins and the words it has, for each text)."""
    whole, of, after, plain = [], {}, None, False
    for text in sorted(set(texts), reverse=True):        # what begins with a text stands just before it
        if after is None or not after.startswith(text) or (text and not after[len(text)].isspace()) or "\n" in after:
            whole.append(_words(text))
            plain = " ".join(whole[-1]) == text          # then blanks count words
            n = len(whole[-1])
        else:
            n = (text.count(" ") + 1 if text else 0) if plain else len(text.split())
        of[text] = len(whole) - 1, n
        after = text
    return whole, [of[t] for t in texts]


def _count_hypotheses(hyps, refs, cutters) -> dict:
    """:func:`_count_texts` of lists of hypotheses, one list a reference.  A hypothesis
    that another one of its list begins with is counted within that one."""
    import numpy as np
    whole, ref_of, parts, above = [], [], [], []
    for i, texts in enumerate(hyps):
        others, of = _beginnings(texts)
        above += [len(whole)] * len(of)
        parts += of
        whole += others
        ref_of += [i] * len(others)
    pair, n_words = np.array(parts, dtype=np.int64).reshape(-1, 2).T
    pair = pair + np.array(above, dtype=np.int64)
    by = np.argsort(pair, kind="stable")
    got = _count_texts(whole, refs, np.array(ref_of, dtype=np.int64), cutters, pair[by], n_words[by])
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return {k: v[back] for k, v in got.items()}


def _statistics(got: dict, bleu: bool, chrf: bool) -> dict:
    """The columns of :func:`sentence_stats` from counts."""
    import numpy as np
    cols = {}
    if bleu:
        cols["bleu_hyp_len"], cols["bleu_ref_len"] = got["tok", "h", 1], got["tok", "r", 1]
        for n in BLEU_CODES:
            cols[f"bleu_m{n}"], cols[f"bleu_t{n}"] = got["tok", "m", n], got["tok", "h", n]
    if chrf:
        orders = [("chr", n) for n in range(1, CHAR_ORDER + 1)] + [("wrd", n) for n in range(1, WORD_ORDER + 1)]
        for k, (kind, n) in enumerate(orders, start=1):
            r = got[kind, "r", n]
            cols[f"chrf_h{k}"] = np.where(r > 0, got[kind, "h", n], 0)
            cols[f"chrf_r{k}"], cols[f"chrf_m{k}"] = r, got[kind, "m", n]
    return cols


def _slices(batch):
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * len(batch) // max(batch.nbytes, 1)))
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def _same_values(columns, n_rows: int):
    """(a row of each different combination of values, the combination's number of each row)."""
    import numpy as np
    import pyarrow as pa
    number = np.zeros(n_rows, dtype=np.int64)
    for c in columns:
        if pa.types.is_list(c.type):                # lists of numbers without nulls, as bytes
            ends = (c.offsets.to_numpy().astype(np.int64) + c.values.offset) * (c.type.value_type.bit_width // 8)
            c = pa.Array.from_buffers(pa.large_binary(), len(c), [None, pa.py_buffer(ends), c.values.buffers()[1]])
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        number = np.unique(number * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return first, number


def sentence_stats(df: DataFrame, id_col: str = "id", hyp: str = "hyp", ref: str = "ref",
                   keep=("direction",), bleu: bool = True, chrf: bool = True, many=(), summed: bool = False) -> DataFrame:
    """Per-sentence sufficient statistics for BLEU and chrF++, map-only.

    Columns: id, keep..., bleu_hyp_len, bleu_ref_len, bleu_m{n}, bleu_t{n},
    chrf_h{k}, chrf_r{k}, chrf_m{k} for k = 1..8 (chars 1-6, words 1-2).  The texts
    of a batch are counted in one Arrow pass.  Rows that share an id stay apart.

    ``many`` names array columns that go with an array of hypotheses ``hyp``: a
    row for each of them, with its values of ``many``; hypotheses with a common
    beginning up to the end of one of them are counted together.

    ``summed``: instead of a row a sentence the partial sums of a batch, a row for each
    combination of ``keep`` and ``many`` there (strings, numbers, lists of numbers), with
    their number of sentences ``n_rows`` and without ids."""
    ids = [] if summed else ["id"]
    keep, many = list(keep), list(many)
    rows = df.select(*[F.col(id_col).alias("id") for _ in ids], *[F.col(k) for k in [*keep, *many]],
                     F.col(hyp).alias("_hyp"), F.col(ref).alias("_ref"))
    kinds = (["tok"] if bleu else []) + (["chr", "wrd"] if chrf else [])
    names = (["n_rows"] if summed else []) + (STAT_COLS_BLEU if bleu else []) + (STAT_COLS_CHRF if chrf else [])
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType.elementType if c in many else rows.schema[c].dataType)
                           for c in [*ids, *keep, *many]] + [T.StructField(c, T.LongType()) for c in names])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        cutters = _cutters(kinds)
        for batch in (part for b in batches for part in _slices(b)):
            refs = [_words(t or "") for t in batch.column("_ref").to_pylist()]
            kept = [batch.column(c) for c in [*ids, *keep]]
            if many:
                hyps = [[t or "" for t in texts] for texts in batch.column("_hyp").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(hyps)), [len(x) for x in hyps]).astype(np.int64))
                kept = [c.take(at) for c in kept] + [batch.column(c).flatten() for c in many]
                got = _count_hypotheses(hyps, refs, cutters)
            else:
                hyps = at = [_words(t or "") for t in batch.column("_hyp").to_pylist()]
                got = _count_texts(hyps, refs, np.arange(len(refs)), cutters)
            cols = _statistics(got, bleu, chrf)
            if summed:
                first, number = _same_values(kept, len(at))
                kept = [c.take(pa.array(first)) for c in kept]
                cols["n_rows"] = np.ones(len(at), dtype=np.int64)
                by, starts = np.argsort(number, kind="stable"), np.flatnonzero(np.diff(np.sort(number), prepend=-1))
                cols = {c: np.add.reduceat(x[by], starts) if len(by) else x for c, x in cols.items()}
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(np.asarray(cols[c], dtype=np.int64)) for c in names]],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


STAT_COLS_BLEU = (["bleu_hyp_len", "bleu_ref_len"]
                  + [f"bleu_m{n}" for n in BLEU_CODES] + [f"bleu_t{n}" for n in BLEU_CODES])
STAT_COLS_CHRF = [f"chrf_{x}{k}" for k in range(1, CHAR_ORDER + WORD_ORDER + 1) for x in "hrm"]


# ------------------------------------------------------------ closed-form scores (as SQL text)

def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def bleu_formula(prefix: str = "", effective_order: bool = False) -> str:
    """sacreBLEU corpus score from summed statistics, exp smoothing (all in
    double precision)."""
    m = [f"{prefix}bleu_m{n}" for n in BLEU_CODES]
    t = [f"{prefix}bleu_t{n}" for n in BLEU_CODES]
    c, r = f"{prefix}bleu_hyp_len", f"{prefix}bleu_ref_len"
    hundred, one, two = _d(100), _d(1), _d(2)
    lps = []
    for i in range(BLEU_ORDER):
        zeros = " + ".join(f"(CASE WHEN {m[j]} = 0 THEN 1 ELSE 0 END)" for j in range(i + 1))
        p = (f"(CASE WHEN {m[i]} > 0 THEN {hundred} * {_d(m[i])} / {_d(t[i])} "
             f"ELSE {hundred} / (power({two}, {_d(zeros)}) * {_d(t[i])}) END)")
        lps.append(f"(CASE WHEN {t[i]} > 0 THEN ln({p}) ELSE {_d(0)} END)")
    bp = (f"(CASE WHEN {c} >= {r} THEN {one} WHEN {c} > 0 THEN exp({one} - {_d(r)} / {_d(c)}) "
          f"ELSE {_d(0)} END)")
    any_match = " + ".join(m)
    if effective_order:
        order = "(" + " + ".join(f"(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)" for x in t) + ")"
        body = f"{bp} * exp(({' + '.join(lps)}) / {_d(f'greatest({order}, 1)')})"
        return f"(CASE WHEN {any_match} = 0 THEN {_d(0)} ELSE {body} END)"
    body = f"{bp} * exp(({' + '.join(lps)}) / {_d(BLEU_ORDER)})"
    return f"(CASE WHEN {any_match} = 0 THEN {_d(0)} WHEN {t[-1]} = 0 THEN {_d(0)} ELSE {body} END)"


def chrf_formula(prefix: str = "", beta: int = CHRF_BETA) -> str:
    """chrF++: average precision and recall over orders with hyp > 0 and
    ref > 0, then the F-beta of the averages, x 100."""
    ks = range(1, CHAR_ORDER + WORD_ORDER + 1)
    ok = [f"({prefix}chrf_h{k} > 0 AND {prefix}chrf_r{k} > 0)" for k in ks]
    eff = "(" + " + ".join(f"(CASE WHEN {o} THEN 1 ELSE 0 END)" for o in ok) + ")"
    prec = "(" + " + ".join(
        f"(CASE WHEN {o} THEN {_d(f'{prefix}chrf_m{k}')} / {_d(f'{prefix}chrf_h{k}')} "
        f"ELSE {_d(0)} END)" for o, k in zip(ok, ks)) + ")"
    rec = "(" + " + ".join(
        f"(CASE WHEN {o} THEN {_d(f'{prefix}chrf_m{k}')} / {_d(f'{prefix}chrf_r{k}')} "
        f"ELSE {_d(0)} END)" for o, k in zip(ok, ks)) + ")"
    p = f"({prec} / {_d(f'greatest({eff}, 1)')})"
    r = f"({rec} / {_d(f'greatest({eff}, 1)')})"
    f2 = _d(beta * beta)
    return (f"(CASE WHEN {eff} = 0 OR {p} + {r} = {_d(0)} THEN {_d(0)} "
            f"ELSE {_d(100)} * ({_d(1)} + {f2}) * {p} * {r} / ({f2} * {p} + {r}) END)")


def sum_stats(cols: list[str]) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in cols]


def _sentences(stats: DataFrame) -> Column:
    """Their number, of statistics by sentence or of partial sums."""
    n = F.coalesce(F.sum("n_rows"), F.lit(0)) if "n_rows" in stats.columns else F.count(F.lit(1))
    return n.cast("long").alias("n")


def corpus_scores(stats: DataFrame, by=(), bleu: bool = True, chrf: bool = True,
                  digits: int = 4) -> DataFrame:
    """A01/A02 by group: sums of the sufficient statistics, then the closed form."""
    cols = (STAT_COLS_BLEU if bleu else []) + (STAT_COLS_CHRF if chrf else [])
    agg = stats.groupBy(*by).agg(_sentences(stats), *sum_stats(cols))
    return _scores_from_sums(agg, list(by), bleu, chrf, digits)


def _scores_from_sums(agg: DataFrame, by: list[str], bleu: bool, chrf: bool,
                      digits: int) -> DataFrame:
    out = [F.col(c) for c in by] + [F.col("n")]
    if bleu:
        out += [F.round(F.expr(bleu_formula()), digits).alias("bleu"),
                F.round(F.expr(bleu_formula(effective_order=True)), digits).alias("bleu_eff")]
    if chrf:
        out.append(F.round(F.expr(chrf_formula()), digits).alias("chrf"))
    return agg.select(*out)


def corpus_bleu(df: DataFrame, hyp: str = "hyp", ref: str = "ref", id_col: str = "id",
                by=(), effective_order: bool = False) -> DataFrame:
    """Corpus BLEU (0-100) overall or per ``by`` group."""
    st = sentence_stats(df, id_col, hyp, ref, keep=tuple(by), chrf=False)
    res = corpus_scores(st, by, bleu=True, chrf=False)
    keep = "bleu_eff" if effective_order else "bleu"
    return res.select(*by, "n", F.col(keep).alias("bleu"))


def corpus_chrf(df: DataFrame, hyp: str = "hyp", ref: str = "ref", id_col: str = "id",
                by=()) -> DataFrame:
    """Corpus chrF++ (0-100) overall or per ``by`` group."""
    st = sentence_stats(df, id_col, hyp, ref, keep=tuple(by), bleu=False)
    return corpus_scores(st, by, bleu=False, chrf=True)


def sentence_chrf() -> Column:
    """chrF++ of one row of :func:`sentence_stats`."""
    return F.expr(chrf_formula())


def evaluate_by(stats: DataFrame, by: str = "direction", overall: str = "all",
                overall_label: str = "overall", digits: int = 4,
                bleu: bool = True, chrf: bool = True) -> DataFrame:
    """Per-direction scores plus an overall row from one rollup over the
    sufficient statistics (never an average of per-direction scores).

    ``overall="all"``: rows without a direction count in the overall row only;
    ``overall="matched"``: they are excluded everywhere."""
    if overall not in ("all", "matched"):
        raise ValueError("overall must be 'all' or 'matched'")
    src = stats if overall == "all" else stats.filter(F.col(by).isNotNull())
    cols = (STAT_COLS_BLEU if bleu else []) + (STAT_COLS_CHRF if chrf else [])
    agg = (src.rollup(by)
              .agg(F.grouping(by).alias("_g"), _sentences(stats), *sum_stats(cols))
              .filter((F.col("_g") == 1) | F.col(by).isNotNull())
              .withColumn(by, F.when(F.col("_g") == 1, F.lit(overall_label)).otherwise(F.col(by)))
              .drop("_g"))
    return _scores_from_sums(agg, [by], bleu, chrf, digits)


def pair_predictions(hyps: DataFrame, refs: DataFrame, on: str = "id") -> DataFrame:
    """Keyed pairing of predictions with references (replaces positional
    zip).  A full outer join keeps unmatched keys visible in ``status``
    instead of silently shifting every later pair."""
    hk, rk = F.col("_hk"), F.col("_rk")
    j = hyps.withColumn("_hk", F.lit(True)).join(refs.withColumn("_rk", F.lit(True)), on,
                                                 "full_outer")
    status = (F.when(hk.isNotNull() & rk.isNotNull(), F.lit("matched"))
               .when(hk.isNull(), F.lit("missing_prediction"))
               .otherwise(F.lit("missing_reference")))
    return j.withColumn("status", status).drop("_hk", "_rk")


def require_matched(paired: DataFrame) -> DataFrame:
    """Only the matched pairs (evaluation input)."""
    return paired.filter(F.col("status") == "matched").drop("status")
