"""Operator 13, collocations counted by double-array tries.

Every language is counted by itself.  Texts are read in Arrow batches whose words
are numbered at once, so all positions of a language's texts (up to ``SLICE_BYTES``
of them at a time) are numpy arrays:

1. Words are counted exactly.  Word pairs are proposed: the numbers of a batch's
   pairs are added up under 40-bit keys, the shards of all batches are merged by
   key range, and keys under ``MIN_COUNT`` fall away.  Keys can only collide, which
   makes a count too large, so no frequent pair is lost.  What stays is a bit map of
   fixed size.
2. Triples are proposed alike, but only where both pairs inside are in the bit map
   (the Apriori rule: no phrase is more frequent than its parts).
3. The phrases under the proposed keys are the candidates.  Their keys deal them
   out to tries; a task sends each trie its candidates as arrays of word numbers,
   with the number of their places.  The task of a trie numbers the words anew,
   makes a double-array trie of the distinct candidates and lets the states of all
   arrays advance one word at a time: the state after word c is ``base[state] + c``
   if ``check`` there names the state.  The places are added up by accepting state:
   the exact counts.

Scores, cuts and the suppression of phrases inside longer ones are DataFrame
expressions over the candidates, in decimals of 38 digits.

Scale: no row is made for a place of the text; a task sends packed arrays of its
distinct keys or candidates.  Key ranges and tries follow the input size, and every
text is read four times however many candidates there are.  A word or phrase that a
third of all positions hold is one number a slice; a trie is chosen by the whole
phrase, so the phrases around a frequent word lie in all tries.  Bit maps have
``2 ** MAP_BITS`` bits at any size and are all that the driver gets.

Defined results: null and empty texts have no words; a null language is ``und``;
repeated rows count as often as they stand; an empty table has no phrases; only
the text and language columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.llm.common import SALTS, cut
from bitextkit.session import input_bytes

MIN_COUNT = 10
INSIDE_PERCENT = 50               # a phrase goes if a longer one around it has this share of its count
TOP = 2000
KEY_BITS, MAP_BITS = 40, 28       # bits of a proposed phrase's key, and of its place in the bit map (32 MB)
RANGE_BYTES = 8 << 20             # input bytes for each key range
TRIE_BYTES = 16 << 20             # input bytes for each trie, and
TRIE_PHRASES = 300_000            # its share of the keys in the bit maps
SLICE_BYTES = 4 << 20             # bytes of text whose words are numbered together
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]   # odd multipliers

# A-Z in lower case; the piece separators all as line feeds; tabs as spaces.
_FOLD = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _FOLD[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_c] = 0x0A
_FOLD[0x09] = 0x20
_FOLD = bytes(_FOLD)


# ------------------------------------------------------------ batches of words

def slices(batch: pa.RecordBatch):
    """(lang, texts) of a batch (lang, text): every language's texts, at most
    ``SLICE_BYTES`` at a time or one text."""
    langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())
    size = pc.binary_length(texts).to_numpy()
    by_lang: dict[str, list] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    for lang, rows in by_lang.items():
        part = np.cumsum(size[rows], dtype=np.int64) // SLICE_BYTES
        for some in np.split(np.array(rows), np.flatnonzero(np.diff(part)) + 1):
            yield lang, texts.take(pa.array(some)).to_pylist()


def word_batches(batch: pa.RecordBatch):
    """(lang, codes, words) for every slice of a batch (lang, text): the
    positions of all its texts, -1 between pieces, and the words of the codes."""
    for lang, group in slices(batch):
        blob = b"\n".join(group).translate(_FOLD).replace(b"\n", b" \n ")
        tokens = pc.split_pattern(pa.array([blob], pa.large_binary()), b" ").values
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = np.arange(len(words))
        for mark, value in ((b"", -2), (b"\n", -1)):
            if mark in words:
                code[words.index(mark)] = value
        codes = code[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, int)
        yield lang, codes[codes != -2], words


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def phrase_keys(h: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of all phrases of ``n`` words that lie in one piece."""
    if len(codes) < n:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    whole = np.ones(len(codes) - n + 1, dtype=bool)
    for k in range(n):
        whole &= codes[k:len(codes) - n + 1 + k] >= 0
    at = np.flatnonzero(whole)
    key = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        key = (key + h[codes[at + k]]) * MIX[k]
    return at, key >> np.uint64(64 - KEY_BITS)


SHARD = "range int, keys binary, counts binary"


def shards(keys: np.ndarray, counts: np.ndarray, range_bits: int) -> pa.RecordBatch:
    """Sorted distinct keys and their counts, packed, one row a key range
    (``range_bits``: the low bits that keys of a range may differ in)."""
    part = (keys >> np.uint64(range_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    ends = list(zip(np.r_[0, cuts], np.r_[cuts, len(keys)])) if len(keys) else []
    return pa.RecordBatch.from_arrays([
        pa.array([part[i] for i, _ in ends], pa.int32()), pa.array([keys[i:j].tobytes() for i, j in ends], pa.binary()),
        pa.array([counts[i:j].astype(np.uint32).tobytes() for i, j in ends], pa.binary())], names=["range", "keys", "counts"])


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(found: DataFrame, parts: int, use, kind: str) -> DataFrame:
    """``use(range, keys, counts)`` over the summed shards of every range."""
    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            new: dict[int, list] = {}
            for r, k, c in zip(*(b.column(x) for x in ("range", "keys", "counts"))):
                new.setdefault(r.as_py(), []).append((np.frombuffer(k.as_buffer(), np.uint64),
                                                      np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)))
            for r, pieces in new.items():
                pieces += [held[r]] if r in held else []
                held[r] = add_up(*(np.concatenate(x) for x in zip(*pieces)))
        for r, (keys, counts) in held.items():
            yield use(r, keys, counts)
    return found.repartition(parts, "range").mapInArrow(run, kind)


# ------------------------------------------------------------ proposals

def proposals(docs: DataFrame, n: int, range_bits: int, bits: np.ndarray | None = None) -> DataFrame:
    """Shards of the keys of phrases of ``n`` words; with ``bits`` only of those
    whose two parts of n - 1 words are in that bit map."""
    shared = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for lang, codes, words in word_batches(batch):
                h = hashes(lang, words)
                at, keys = phrase_keys(h, codes, n)
                if shared is not None:
                    part_at, part = phrase_keys(h, codes, n - 1)
                    ok = np.zeros(len(codes) + 1, dtype=bool)
                    ok[part_at] = in_map(shared.value, part)
                    keys = keys[ok[at] & ok[at + 1]]
                found.append(keys)
            yield shards(*np.unique(np.concatenate(found), return_counts=True), range_bits)
    return docs.mapInArrow(run, SHARD)


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(KEY_BITS - MAP_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_map(found: DataFrame, range_bits: int) -> np.ndarray:
    """The bit map of the keys that reach ``MIN_COUNT``.  Every range fills its
    own stretch; the driver gets ``2 ** MAP_BITS`` bits in all, or less."""
    ranges = 1 << (KEY_BITS - range_bits)
    size = (1 << MAP_BITS) // 8 // ranges

    def use(r, keys, counts):
        at = (keys[counts >= MIN_COUNT] >> np.uint64(KEY_BITS - MAP_BITS)).astype(np.int64) - r * size * 8
        piece = np.zeros(size, np.uint8)
        np.bitwise_or.at(piece, at >> 3, (1 << (at & 7)).astype(np.uint8))
        some = at.any() or len(at) > 0
        return pa.RecordBatch.from_arrays([pa.array([r] if some else [], pa.int32()),
                                           pa.array([piece.tobytes()] if some else [], pa.binary())], names=["range", "piece"])
    out = np.zeros(size * ranges, np.uint8)
    for row in merged(found, ranges, use, "range int, piece binary").collect():      # 2 ** MAP_BITS bits at most
        out[row["range"] * size:(row["range"] + 1) * size] = np.frombuffer(row["piece"], np.uint8)
    return out


PHRASES = "trie int, lang string, words array<string>, codes binary, counts binary"


def candidates(docs: DataFrame, maps: dict[int, np.ndarray], tries: int) -> DataFrame:
    """The distinct phrases of every slice whose keys, and whose parts' keys, are
    in the bit maps of their lengths, one row a slice and trie: the slice's words
    that they hold, the phrases as rows of 3 numbers of these words (from 1; 0 for
    none) and how many places each has."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        for batch in batches:
            for lang, codes, words in word_batches(batch):
                h, ok, number = hashes(lang, words), codes >= 0, codes
                rows, places, trie = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for n, bits in sorted(shared.value.items()):
                    at, keys = phrase_keys(h, codes, n)
                    some = in_map(bits, keys) & ok[at] & ok[at + 1]
                    at, keys = at[some], keys[some]
                    ok = np.zeros(len(codes) + 1, dtype=bool)
                    ok[at] = True
                    # phrases numbered by the numbers of their first words and their last word
                    pair = number[at] * len(words) + codes[at + n - 1]
                    _, first, back, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                    number = np.zeros(len(codes) + 1, dtype=np.int64)
                    number[at] = back
                    held = np.zeros((len(first), 3), np.int64)
                    held[:, :n] = codes[at[first][:, None] + np.arange(n)] + 1
                    rows.append(held)
                    places.append(count)
                    trie.append((keys[first] % np.uint64(tries)).astype(np.int64))
                yield packed_phrases(lang, pa.array(words, pa.binary()).cast(pa.string()),
                                     *(np.concatenate(x) for x in (rows, places, trie)))
    return docs.mapInArrow(run, PHRASES)


def packed_phrases(lang: str, words: pa.Array, rows: np.ndarray, places: np.ndarray, trie: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(trie, kind="stable")
    rows, places, trie = rows[order], places[order], trie[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(trie)) + 1, len(trie)] if len(trie) else np.zeros(1, int)
    used, codes = [np.zeros(0, np.int64)], []
    for i, j in zip(cuts[:-1], cuts[1:]):
        own, back = np.unique(np.append(rows[i:j].ravel(), 0), return_inverse=True)      # 0 always is the first
        used.append(own[1:] - 1)
        codes.append(back[:-1].astype(np.uint32).tobytes())
    ends = np.cumsum([0, *(len(x) for x in used[1:])])
    return pa.RecordBatch.from_arrays([
        pa.array(trie[cuts[:-1]], pa.int32()), pa.array([lang] * len(codes), pa.string()),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(np.concatenate(used)))),
        pa.array(codes, pa.binary()), pa.array([places[i:j].astype(np.uint32).tobytes() for i, j in zip(cuts[:-1], cuts[1:])],
                                               pa.binary())], names=["trie", "lang", "words", "codes", "counts"])


# ------------------------------------------------------------ tries

WINDOW = 4096                     # slots looked at for a free place at a time


class DoubleArray:
    """A trie of phrases over numbered words (1 .. ``n_words``).  State c is word
    c; the state after another word c is ``base[state] + c`` where ``check`` names
    the state.  ``phrases`` is an array of 3 columns, the last 0 for pairs;
    ``states`` has the accepting state of each row."""

    def __init__(self, phrases: np.ndarray, n_words: int):
        self.base = np.zeros(n_words + 1, np.int64)
        self.check = np.zeros(n_words + 1, np.int64)
        self.top = self.free = self.start = n_words + 1
        second = self._level(phrases[:, 0], phrases[:, 1])
        third = phrases[:, 2] > 0
        self.states = second.copy()
        self.states[third] = self._level(second[third], phrases[third, 2])

    def _level(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places the states after ``parents`` for ``codes``; returns them row by row."""
        if not len(parents):
            return np.zeros(0, np.int64)
        width = int(codes.max()) + 1
        keys, back = np.unique(parents * width + codes, return_inverse=True)
        parent, code = keys // width, keys % width
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        size = np.diff(np.r_[first, len(parent)])
        for g in first[np.argsort(-size, kind="stable")][:int((size > 1).sum())]:
            n = int(np.searchsorted(parent, parent[g], "right")) - g
            self._place(int(parent[g]), code[g:g + n])
        # states after which one word only follows take the free slots in order
        alone = first[size == 1]
        self._grow(self.top + len(alone) + 1)
        slots = self.free + np.flatnonzero(self.check[self.free:] == -1)[:len(alone)]
        self.base[parent[alone]], self.check[slots] = slots - code[alone], parent[alone]
        self.top = max(self.top, int(slots[-1]) + 1 if len(slots) else 0)
        self.free += int((np.append(self.check[self.free:], -1) == -1).argmax())
        return (self.base[parent] + code)[back]

    def _place(self, parent: int, codes: np.ndarray):
        """Slots that take all ``codes``: the first found in some windows, else
        the end.  Windows that are nearly full are not looked at again; the states
        that stand alone fill them."""
        span, at, looked = codes - codes[0], self.start, 0
        while True:
            self._grow(at + WINDOW + int(span[-1]) + 1)
            open_ = np.flatnonzero(self.check[at:at + WINDOW] == -1)
            if at == self.start and len(open_) < WINDOW // 8:
                self.start += WINDOW
            tried = at + open_[:max(64, 100_000 // len(codes))]
            fits = (self.check[tried[:, None] + span] == -1).all(axis=1)
            if fits.any():
                break
            looked += 1
            at = at + WINDOW if looked < 400 else max(self.top, at + WINDOW)
        slots = tried[int(fits.argmax())] + span
        self.base[parent], self.check[slots] = slots[0] - codes[0], parent
        self.top = max(self.top, int(slots[-1]) + 1)

    def _grow(self, size: int):
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def tables(self):
        return self.base[:self.top], self.check[:self.top]


def advance(base: np.ndarray, check: np.ndarray, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The next states of all positions; 0 where there is none."""
    to = base[states] + codes
    to[(states == 0) | (codes == 0) | (to < 0) | (to >= len(base))] = 0
    return np.where((to > 0) & (check[to] == states), to, 0)


def coded_phrases(held: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """The phrases of rows of ``PHRASES`` as rows of 3 word numbers, 0 for none;
    their places; the languages and words of the numbers 1, 2, ..."""
    words = held.column("words").combine_chunks()
    starts = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
    langs = held.column("lang").combine_chunks().dictionary_encode()
    of_word = langs.indices.take(pa.array(np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())))
    named = pc.binary_join_element_wise(of_word.cast(pa.string()), words.flatten(), pa.scalar(" ")).dictionary_encode()
    number = np.append(named.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, 0)
    out, places = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    for start, codes, counts in zip(starts, held.column("codes"), held.column("counts")):
        c = np.frombuffer(codes.as_buffer(), np.uint32).astype(np.int64).reshape(-1, 3)
        out.append(number[np.where(c > 0, start + c - 1, -1)])
        places.append(np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
    names = [x.split(" ", 1) for x in named.dictionary.to_pylist()]
    return (np.concatenate(out), np.concatenate(places), langs.dictionary.take(pa.array([int(x) for x, _ in names], pa.int32())),
            pa.array([x for _, x in names], pa.string()))


def count_in_trie(held: pa.Table) -> pa.Table:
    """(lang, words, a): the phrases of one trie that reach ``MIN_COUNT``, with their exact counts."""
    rows, places, langs, words = coded_phrases(held)
    width = len(words) + 1
    _, pair = np.unique(rows[:, 0] * width + rows[:, 1], return_inverse=True)
    _, first = np.unique(pair * width + rows[:, 2], return_index=True)
    trie = DoubleArray(rows[first], len(words))
    base, check = trie.tables()
    states = advance(base, check, rows[:, 0], rows[:, 1])
    third = rows[:, 2] > 0
    states[third] = advance(base, check, states[third], rows[third, 2])
    total = np.zeros(len(base), np.int64)
    np.add.at(total, states, places)
    often = total[trie.states] >= MIN_COUNT
    found = rows[first[often]]
    size = 2 + (found[:, 2] > 0)
    return pa.table({"lang": langs.take(pa.array(found[:, 0] - 1)),
                     "words": pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, size]), pa.int32()),
                                                       words.take(pa.array(found[found > 0] - 1))),
                     "a": pa.array(total[trie.states[often]])})


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    def run(batches):
        for batch in batches:
            for lang, codes, words in word_batches(batch):
                count = np.bincount(codes[codes >= 0], minlength=len(words))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(
                    [words[i].decode() for i in some], pa.string()), pa.array(count[some], pa.int64())], names=["lang", "word", "f"])
    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame) -> DataFrame:
    """(lang, words, a): all phrases of 2 or 3 words of ``docs`` (lang, text) that
    stand ``MIN_COUNT`` times or more."""
    ranges = max(16, min(1 << 16, 1 << (input_bytes(docs) // RANGE_BYTES).bit_length()))
    range_bits = KEY_BITS - ranges.bit_length() + 1
    maps = {2: bit_map(proposals(docs, 2, range_bits), range_bits)}
    maps[3] = bit_map(proposals(docs, 3, range_bits, maps[2]), range_bits)
    keys = sum(int(np.bitwise_count(bits).sum()) for bits in maps.values())
    tries = max(64, input_bytes(docs) // TRIE_BYTES, -(-keys // TRIE_PHRASES))
    found = candidates(docs, maps, tries).groupBy("trie").applyInArrow(count_in_trie, "lang string, words array<string>, a long")
    return cut(found, "phrase-counts")


# ------------------------------------------------------------ scores

def collocations(docs: DataFrame, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` of every language."""
    d = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    words = cut(word_counts(d), "words")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = cut(words.filter(F.col("f") >= MIN_COUNT), "frequent-words")
    found = phrase_counts(d)
    w = F.col("words")
    pairs = found.filter(F.size(w) == 2).select("lang", w[0].alias("w1"), w[1].alias("w2"), "a")
    triples = found.filter(F.size(w) == 3).select("lang", w[0].alias("w1"), w[1].alias("w2"), w[2].alias("w3"), "a")

    def word(name, count):
        return often.select("lang", F.col("word").alias(name), F.col("f").alias(count))

    def pair(first, second, count):
        return pairs.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(count))

    wide = "decimal(14,0)"

    def score(l, r):
        return F.expr(f"cast(1000000 as decimal(7,0)) * cast(a as {wide}) * cast(a as {wide}) "
                      f"div (cast({l} as {wide}) * cast({r} as {wide}))")

    around = triples.select("lang", "a", F.inline(F.array(
        F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")),
        F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(around, ["lang", "w1", "w2"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_PERCENT * F.col("a")))
    two = two.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", score("l", "r").alias("score"))
    three = triples.join(word("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(
        pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(word("w3", "r2"), ["lang", "w3"])
    three = three.withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                         F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first the best of every part of a language, so that no task ranks a whole language
    best = two.unionByName(three).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_part"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(F.broadcast(n), "lang").select(          # one row a language
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
