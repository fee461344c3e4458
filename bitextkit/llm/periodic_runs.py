"""Operator 11, periodic runs of words, found in tiles per period octave.

A run is a stretch of words that equal the words ``q`` before them, ``q`` its
smallest period, of ``max(MIN_LENGTH, MIN_POWER * q)`` words or more, that
cannot be extended.  Periods are searched by octaves ``P <= q < 2P``.  A run of
such a period holds several of the boundaries that stand every ``P`` or ``2P``
words; at a boundary b the Z-function of the words from b on gives, for every q,
how far the text agrees with itself q words later, and the Z-function of the
reversed words how far before b.  Both look ``4P`` words back and ``6P`` ahead at
most, so a boundary needs its own tile of words only, and what it finds are
interval fragments; a fragment whose first q words are a power of a shorter word
has a smaller period and goes.

A text of up to ``TILE`` words is one tile.  A longer one is exploded: tiles of
``TILE`` words serve all octaves up to ``TILE_PERIOD``, every further octave has
tiles of ``16 P`` words, all of them with the words that their boundaries look at
around them; these rows are dealt out anew, so one very long text is solved by
many tasks.  Fragments are shuffled by document and period and stitched where
they overlap by a period or more.  Natural text has hardly any, so only the last
step, which cuts the words out, shuffles texts.

Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words and no runs; a null id counts
as the empty text in its checksum; rows equal in id and text have equal results,
each its own row; only the id and text columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.llm.common import cut, text_of, ws_words

MIN_LENGTH, MIN_POWER = 6, 4
TILE, TILE_PERIOD = 8192, 512
BACK, AHEAD = 4, 6                # octaves (P) that a boundary looks back and ahead
PREFIX = 3                        # words that have to agree before a tile is solved
CHUNK = 1 << 21                   # word pairs compared at a time
SHORT_TEXT = 2 * TILE             # characters that cannot hold more than TILE words


# ------------------------------------------------------------ one tile

def z_function(s: list) -> list:
    """z[i]: how many items from i on agree with those from 0 on."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def agreement(a: np.ndarray, shifts: list[int]) -> list[int]:
    """Z-function of ``a`` at the ``shifts``; few of them are read off directly."""
    if len(shifts) > 8:
        z = z_function(a.tolist())
        return [z[q] if q < len(a) else 0 for q in shifts]
    out = []
    for q in shifts:
        differ = a[:len(a) - q] != a[q:]
        out.append(int(differ.argmax()) if differ.any() else len(differ))
    return out


@lru_cache(maxsize=1 << 16)
def root_shifts(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    out, rest, d = [], q, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(q // d)
            while rest % d == 0:
                rest //= d
        d += 1
    return tuple(out + ([q // rest] if rest > 1 else []))


def boundary_fragments(words: np.ndarray, b: int, octave: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """(period, start, end) of the periodic stretches around boundary b in
    ``words``, as far as the boundary looks."""
    low, high = max(0, b - BACK * octave), min(len(words), b + AHEAD * octave)
    ahead = agreement(words[b:high], periods)
    behind = words[low:min(high, b + 2 * octave)][::-1]               # from the end backwards
    out = []
    for q, fwd in zip(periods, ahead):
        tail = words[b:b + q]
        if any((tail[:q - d] == tail[d:]).all() for d in root_shifts(q)):
            continue
        out.append((q, fwd))
    if not out:
        return []
    # suffixes of words[low:b] against those of words[low:b + q]: agreement of the reversed words
    left = words[low:b][::-1]
    if len(out) > 8:
        both = z_function(left.tolist() + [None] + behind.tolist())
        at = len(left) + 1 + len(behind) - (b - low)
        backs = [both[at - q] for q, _ in out]
    else:
        backs = []
        for q, _ in out:
            other = words[low:b + q][::-1][:len(left)]
            differ = left != other
            backs.append(int(differ.argmax()) if differ.any() else len(left))
    return [(q, b - back, b + q + fwd) for (q, fwd), back in zip(out, backs)]


def spacing(octave: int) -> int:
    return octave if octave < 4 else 2 * octave


def solve(batch: pa.RecordBatch) -> list[tuple]:
    """(row, period, start, end) in the documents' word numbers of all tiles of a batch."""
    start, lo, hi, pmin, pmax, n = (batch.column(c).to_numpy() for c in ("start", "lo", "hi", "pmin", "pmax", "n"))
    lists = batch.column("h")
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    found = set()
    octave = 1
    while octave <= (n // MIN_POWER).max(initial=0):
        rows = np.flatnonzero((pmin <= octave) & (octave <= pmax) & (MIN_POWER * octave <= n))
        step = spacing(octave)
        first = -(-lo[rows] // step) * step
        count = np.maximum(0, -(-(hi[rows] - first) // step))
        row = np.repeat(rows, count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[row] + np.repeat(first, count) + nth * step - start[row]
        q = np.arange(octave, 2 * octave)
        size = max(1, CHUNK // octave)
        for c in range(0, len(at), size):
            b, r = at[c:c + size], row[c:c + size]
            same = flat[np.minimum(b[:, None] + q, len(flat) - 1)] == flat[b][:, None]
            i, j = np.nonzero(same)
            pb, pq, limit = b[i], q[j], end[r[i]]
            ok = pb + pq + PREFIX <= limit
            pb, pq, pr = pb[ok], pq[ok], r[i][ok]
            for k in range(1, PREFIX):
                ok = flat[pb + k] == flat[pb + pq + k]
                pb, pq, pr = pb[ok], pq[ok], pr[ok]
            if not len(pb):
                continue
            cuts = np.flatnonzero(np.diff(pb)) + 1
            for bs, qs, rs in zip(np.split(pb, cuts), np.split(pq, cuts), np.split(pr, cuts)):
                x = int(rs[0])
                place = int(bs[0] - begin[x])
                words = flat[begin[x]:end[x]]
                edge_low, edge_high = place - BACK * octave, place + AHEAD * octave
                for p, s, e in boundary_fragments(words, place, octave, qs.tolist()):
                    cut_off = (s == edge_low and s + start[x] > 0) or (e == edge_high and e + start[x] < n[x])
                    if e - s >= (3 * p if cut_off else max(MIN_LENGTH, MIN_POWER * p)):
                        found.add((x, p, s + int(start[x]), e + int(start[x])))
        octave *= 2
    return sorted(found)


def _solver(batches):
    for batch in batches:
        found = solve(batch)
        rows = pa.array([x[0] for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(rows), batch.column("th").take(rows),
             *[pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3)]], names=["id", "th", "q", "s", "e"])


# ------------------------------------------------------------ documents

def with_words(docs: DataFrame, *more: str) -> DataFrame:
    """(id, th, w) of ``docs`` (id, text), and more of its columns: words after
    the rule of the contract: with h = crc32 of the id, where h ends in 0 the
    words from a on repeat."""
    d = docs.select("id", *more, F.xxhash64(text_of()).alias("th"), ws_words(text_of()).alias("_w"),
                    F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")).alias("_h"))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    rule = (F.col("_h") % 10 == 0) & (n > 0)
    a = F.when(rule, g % n).cast("int")
    d = d.withColumn("_a", a)
    d = d.withColumn("_p", F.when(rule, 1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    moved = F.transform("_w", lambda x, i: F.when(i < F.col("_a"), x).otherwise(
        F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return d.select("id", "th", *more, F.when(F.col("_p").isNotNull(), moved).otherwise(F.col("_w")).alias("w"))


def tiles(words: DataFrame) -> DataFrame:
    """The tiles of documents (id, th, w) as rows for :func:`solve`: tile words
    ``h`` begin at ``start``; boundaries are those from ``lo`` to ``hi``, octaves
    those from ``pmin`` to ``pmax``."""
    n = F.col("n")
    d = words.select("id", "th", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))

    def cover(size, low, high):
        return F.transform(F.sequence(F.lit(0), n - 1, size), lambda i: F.struct(
            i.alias("lo"), F.least(i + size, n).alias("hi"), low.alias("pmin"), high.alias("pmax")))

    octaves = F.filter(F.array(*[F.lit(1 << o) for o in range(TILE_PERIOD.bit_length(), 27)]), lambda p: p <= n / MIN_POWER)
    many = F.concat(cover(F.lit(TILE), F.lit(1), F.lit(TILE_PERIOD)),
                    F.flatten(F.transform(octaves, lambda p: cover(p * 16, p, p))))
    one = F.array(F.struct(F.lit(0).alias("lo"), n.alias("hi"), F.lit(1).alias("pmin"), n.alias("pmax")))
    # not a filter on n: it would be pushed down with the splitting of the text inside
    d = d.select("id", "th", "n", "h", F.explode(F.when(n < MIN_LENGTH, None).when(n <= TILE, one).otherwise(many)).alias("_t"))
    d = d.select("id", "th", "n", "h", "_t.*")
    start = F.greatest(F.col("lo") - BACK * F.col("pmax"), F.lit(0))
    stop = F.least(F.col("hi") + AHEAD * F.col("pmax"), n)
    return d.select("id", "th", "n", "lo", "hi", "pmin", "pmax", start.alias("start"),
                    F.when(n <= TILE, F.col("h")).otherwise(F.slice("h", start + 1, stop - start)).alias("h"))


def runs(docs: DataFrame) -> DataFrame:
    """(id, th, start, length, period) of all runs of ``docs`` (id, text)."""
    size = F.length(text_of())
    short = tiles(with_words(docs.filter(size <= SHORT_TEXT)))
    long = tiles(with_words(docs.filter(size > SHORT_TEXT)))
    kind = "id long, th long, q long, s long, e long"
    solved = [x.mapInArrow(_solver, kind) for x in (short, long.repartition("id", "th", "lo", "pmin"))]
    found = cut(solved[0].unionByName(solved[1]).distinct(), "fragments")
    by = Window.partitionBy("id", "th", "q").orderBy("s", "e")
    upto = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_new", (F.col("s") > F.coalesce(upto, F.lit(-1)) - F.col("q")).cast("int"))
    found = found.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    r = found.groupBy("id", "th", "q", "_run").agg(F.min("s").alias("start"), F.max("e").alias("_e"))
    length = F.col("_e") - F.col("start")
    return r.filter(length >= F.greatest(F.lit(MIN_LENGTH), MIN_POWER * F.col("q"))).select(
        "id", "th", "start", length.alias("length"), F.col("q").alias("period"))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_runs``, the run of greatest exponent
    (``start, length, period, exponent_milli``) and two digests: of all runs,
    and of the words that stay if every run is cut to its first period."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    per = runs(d).groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    per = cut(per, "runs")
    # texts are shuffled, not their words, and not sorted: the runs are the smaller side
    found = per.withColumnsRenamed({"id": "_i", "th": "_t"}).hint("shuffle_hash")
    out = d.join(found, F.col("id").eqNullSafe(F.col("_i")) & (F.xxhash64(text_of()) == F.col("_t")), "left")
    out = with_words(out, "_runs")
    none = F.array().cast(per.schema["_runs"].dataType)
    all_runs = F.coalesce(F.col("_runs"), none)
    best = F.aggregate(all_runs, F.get(all_runs, F.lit(0)), lambda acc, r: F.when(
        r["length"] * acc["period"] > acc["length"] * r["period"], r).otherwise(acc))
    gone = F.flatten(F.transform("_runs", lambda r: F.sequence(
        (r["start"] + r["period"]).cast("int"), (r["start"] + r["length"] - 1).cast("int"))))
    kept = F.when(F.col("_runs").isNull(), F.col("w")).otherwise(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("w") - 1), gone), lambda i: F.get("w", i)))
    lines = F.transform(all_runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = out.select(F.col("id").alias("doc_id"), F.size(all_runs).cast("long").alias("n_runs"), best.alias("_b"),
                     F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                     F.sha2(F.array_join(kept, " "), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period",
                      F.floor(F.col("_b.length") * 1000 / F.col("_b.period")).alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
