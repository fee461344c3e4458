"""Operator 9, packing by best-fit decreasing.

Documents are tokenised where they lie; a document longer than a window is
first cut into full windows, and only its rest (shorter than a window) has to
be packed.  The shuffle carries piece descriptions (32 bytes and a few), never
texts or ids.  Rests are dealt by a hash into groups of about
``docs_per_group`` and every group is packed on its own, longest first, into
the open window with the least room that still holds the piece; a segment tree
over the possible remaining capacities finds that window in
log2(window) steps.  A group ends with a handful of windows that are not full,
so more groups cost little padding and no group grows with the data.

A null text is an empty document: its only id is the end id.  Repeated rows are
packed one by one.
"""

from __future__ import annotations

import base64
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import text_of, worker_cache

RANKS, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
WINDOW, END_ID = 2048, 1
DOCS_PER_GROUP = 8192
MAX_WORDS = 400_000         # encoded words kept per worker; cleared when reached
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
PACKED = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Ids of a text as little-endian 32-bit bytes.

    A single space or line break between two visible characters always opens
    its own piece of the vocabulary's split pattern, so text between them is
    encoded by itself and kept.  Lines with other white space at an edge take
    the plain way."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("llm", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens=SPECIAL).encode_ordinary
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.line_break = self._plain("\n")

    def _plain(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ordinary(self, text: str) -> bytes:
        out = []
        lines = text.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return self._plain(text)
        for n, line in enumerate(lines):
            words = line.split(" ")
            if any(not w or w[0].isspace() or w[-1].isspace() for w in words):
                return self._plain(text)
            if n:
                out.append(self.line_break)
            for known, lead, part in ((self.first, "", words[:1]), (self.later, " ", words[1:])):
                get = known.get
                for w in part:
                    ids = get(w)
                    if ids is None:
                        ids = self._plain(lead + w)
                        if len(known) >= MAX_WORDS:
                            known.clear()
                        if len(w) <= 64:
                            known[w] = ids
                    out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        out = []
        for name, number in SPECIAL.items():     # the library's default reads it as its id
            for n, part in enumerate(text.split(name)):
                out += [struct.pack("<I", number)] * bool(n) + [self._ordinary(part) if part else b""]
        return b"".join(out)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stacks: dict[int, list[int]] = {}

    def _add(self, room: int, by: int):
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1

    def push(self, room: int, sequence: int):
        self.stacks.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) of a window with the least room >= ``size``."""
        node, tree, leaves = self.leaves + size, self.tree, self.leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < leaves:
                node <<= 1
                if not tree[node]:
                    node += 1
        room = node - leaves
        self._add(room, -1)
        return room, self.stacks[room].pop()


def best_fit(lengths, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` must not increase."""
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, windows = 0, OpenWindows(window)
    for i, size in enumerate(lengths):
        found = windows.tightest(size) if size < window else None
        if found is None:
            room, n = window, opened
            opened += 1
        else:
            room, n = found
        seq[i], off[i] = n, window - room
        if room > size:
            windows.push(room - size, n)
    return seq, off


def pieces(docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The full windows and the rest of every document (map-only)."""
    if ranks_path is None:
        import public_tokenizers
        ranks_path = public_tokenizers.path(RANKS)

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = worker_cache(("encode", ranks_path), lambda: Encoder(ranks_path))
        last, step = struct.pack("<I", end_id), 4 * window
        for df in batches:
            rows = []
            for doc, text in zip(df["doc_id"].tolist(), df["_t"]):
                ids = encode(text) + last
                for at in range(0, len(ids), step):
                    part = ids[at:at + step]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_of(text_col).alias("_t")).mapInPandas(tokenise, PIECES)


def pack(docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         docs_per_group: int = DOCS_PER_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every id of every document in exactly one piece of one sequence.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``; ``sequence_id = group * 2^32 + number in the group``.  The number
    of groups follows the number of documents (a count that Parquet answers
    from its footers)."""
    groups = max(1, math.ceil(docs.count() / docs_per_group))
    dealt = pieces(docs, ranks_path, window, end_id, id_col, text_col).withColumn(
        "g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def pack_group(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True],
                            ignore_index=True)
        seq, off = best_fit(df["length"].tolist(), window)
        return df.drop(columns="g").assign(
            doc_id=df["doc_id"].astype("Int64"), sequence_id=seq + (int(df["g"].iloc[0]) << 32 if len(df) else 0),
            offset=off)

    return dealt.groupBy("g").applyInPandas(pack_group, PACKED)
