"""Operator 8, token counts by a compiled finite-state tokenizer.

The vocabulary file of a lower-casing, word-end BPE tokenizer is compiled into
a deterministic transducer that never builds the tokens themselves:

* A state is what a prefix of a word leaves behind: the longest suffix that can
  still begin a token, the last token of the BPE result at each position of
  that suffix, and how many tokens those positions are ahead or behind.
* A transition reads one byte and is annotated with the change of the token
  count; an end transition reads the last byte of the word (whose symbol
  carries the word-end mark).  The result of BPE on a prefix is the result on a
  shorter prefix plus one token, and which token is decided by whether it may
  stand beside its left neighbour; so a transition needs the state alone.
  Transitions are compiled when first used and kept (bounded, see
  ``MAX_STATES``).
* A text is cut into chunks.  The map of a chunk from the state it is entered
  with to (tokens, state it is left with) is held as (head, inner count, tail):
  only the fragments before the first and after the last separator depend on
  the neighbours.  These maps compose associatively and are combined pairwise
  (a log-depth scan).

Null and empty texts have 0 tokens.  Special-token strings inside a text count
as one token each, which is the library's default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import text_of, worker_cache

TOKENIZER = "word_bpe_49k.json"
MAX_STATES = 400_000        # compiled states kept per worker; cleared when reached
MAX_WORDS = 400_000         # counted words kept per worker; cleared when reached
CHUNK = 1 << 16             # code points per chunk
INF = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    """Token counts of word-end BPE without building tokens."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        names, self.pair, self.parts = {}, {}, {}
        for letter, b in letters.items():
            names[letter], names[letter + end] = b, 256 + b
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            token = 512 + rank
            self.pair[names[a], names[b]] = token
            self.parts[token] = (names[a], names[b])
            names[a + b] = token
        self.inside, self.final, self.begins = {}, {}, {b""}
        for name, token in names.items():
            last = name.endswith(end)
            raw = bytes(letters[c] for c in (name[:-len(end)] if last else name))
            (self.final if last else self.inside)[raw] = token
            self.begins.update(raw[:i] for i in range(1, len(raw)))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = tuple({s[:2] for s in special})
        self.right, self.left, self.beside = {}, {}, {}
        self.reset()
        self.words: dict[str, int] = {}

    def reset(self):
        self.ids, self.states, self.steps, self.ends = {}, [], [], []
        self.start = self._state(b"", (None,), (0,))

    def _state(self, tail: bytes, tokens: tuple, ahead: tuple) -> int:
        key = (tail, tokens, ahead)
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.ends.append({})
        return n

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge while the token is being merged,
        each with the merge that ends it."""
        known = self.right if side else self.left
        out = known.get(token)
        if out is None:
            chain = [token]
            while chain[-1] in self.parts:
                chain.append(self.parts[chain[-1]][side])
            chain.reverse()
            out = known[token] = [*zip(chain, [*chain[1:], INF])]
        return out

    def may_stand(self, a: int, b: int) -> bool:
        """Whether BPE on the symbols of ``a`` then ``b`` leaves them apart."""
        known = self.beside.get((a, b))
        if known is not None:
            return known
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        apart = True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            merge = self.pair.get((x, y))
            if merge is not None and merge < x_ends and merge <= y_ends:
                apart = False        # the merge across the edge comes first
                break
            if x_ends == y_ends == INF:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        self.beside[a, b] = apart
        return apart

    def _last(self, key, byte: int, table: dict) -> tuple[int, int, bytes]:
        tail, tokens, ahead = key
        raw = tail + bytes((byte,))
        for at in range(len(raw)):
            token = table.get(raw[at:])
            if token is not None and (tokens[at] is None or self.may_stand(tokens[at], token)):
                return token, ahead[at] + 1, raw
        raise ValueError("a byte without a token")

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        key = self.states[state]
        token, delta, raw = self._last(key, byte, self.inside)
        tokens, ahead = (*key[1], token), (*key[2], delta)
        at = 0
        while raw[at:] not in self.begins:
            at += 1
        out = (self._state(raw[at:], tokens[at:], tuple(a - delta for a in ahead[at:])), delta)
        self.steps[state][byte] = out
        return out

    def piece(self, raw: bytes) -> int:
        """Tokens of one word of the split pattern."""
        state, n = self.start, 0
        for byte in raw[:-1]:
            step = self.steps[state].get(byte)
            state, delta = step if step is not None else self._step(state, byte)
            n += delta
        last = self.ends[state].get(raw[-1])
        if last is None:
            last = self.ends[state][raw[-1]] = self._last(self.states[state], raw[-1], self.final)[1]
        if len(self.states) > MAX_STATES:
            self.reset()
        return n + last

    def word(self, word: str) -> int:
        """Tokens between two separators (may hold several pieces)."""
        n = self.words.get(word)
        if n is None:
            n = 0
            plain = [word]
            if self.special and any(m in word for m in self.marks):
                plain = self.special.split(word)
                n = len(plain) - 1
            for part in plain:
                # lower() knows a final form of sigma, the library does not
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                n += sum(self.piece(p.encode("utf-8", "replace")) for p in self.pieces(part))
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = n
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, inner count, tail); tail None if the chunk has no separator."""
        parts = chunk.replace("\n", " ").split(" ")
        if len(parts) == 1:
            return chunk, 0, None
        known, inner = self.words.get, 0
        for w in parts[1:-1]:
            n = known(w)
            inner += self.word(w) if n is None else n
        return parts[0], inner, parts[-1]

    def compose(self, a, b):
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.word(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i]
                    for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        head, inner, tail = maps[0]
        return self.word(head) + inner + (self.word(tail) if tail is not None else 0)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``path``: vocabulary file, readable on every executor.  One row per input
    row, repeated rows included; other columns are not read.  Map-only: no
    shuffle, one Arrow batch in memory at a time."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = worker_cache(("count", path), lambda: CountTransducer(path))
        for texts in batches:
            yield pd.Series([t.count(x, chunk) for x in texts], dtype="int64")

    n = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).select(
        "doc_id", F.octet_length("_t").cast("long").alias("n_bytes"),
        count("_t").alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
