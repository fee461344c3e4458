"""Operators 8 and 9 against the tokenizer libraries."""
import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from bitextkit.llm import packing, token_counts

WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COUNTER = token_counts.CountTransducer(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ODD = ["", " ", "  a  b ", "I'm you're it's'll 'd", "\"'s ''s '''re", "Ünïcödé é ΣΑΣ İstanbul ß", "a\n\n b \t c\n",
       "a<|endoftext|>b <|startoftext|><|endoftext|> x<|endo", "日本語テキスト と漢字", "\x1cfoo\x85bar\xa0baz q",
       "\U0001f600\U0001f601x", "12345 3.14 a1b2", "x" * 300, "don't stop\tme\r\nnow  ok", "a" * 24 + "!!!???...", "ﬁ ½ ² Ⅷ"]


def ids(t):
    return BYTE.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_counts_and_ids_of_odd_texts(text):
    assert COUNTER.count(text) == len(WORD.encode(text, add_special_tokens=False).ids)
    assert ENCODER(text) == struct.pack(f"<{len(ids(text))}I", *ids(text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs",)), max_size=60))
def test_counts_and_ids_of_any_text(text):
    assert COUNTER.count(text) == len(WORD.encode(text, add_special_tokens=False).ids)
    assert ENCODER(text) == struct.pack(f"<{len(ids(text))}I", *ids(text))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_chunk_maps_compose(texts001, chunk):
    for text in [*ODD, *list(texts001.values())[:20]]:
        assert COUNTER.count(text[:4000], chunk) == COUNTER.count(text[:4000])


def test_bounded_caches_do_not_change_counts(texts001, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 20)
    small = token_counts.CountTransducer(public_tokenizers.path("word_bpe_49k.json"))
    for text in list(texts001.values())[:10]:
        assert small.count(text) == COUNTER.count(text)


def test_token_counts_query(docs001, texts001):
    for r in token_counts.token_counts(docs001).collect():
        n = len(WORD.encode(texts001[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts001[r.doc_id].encode()), n, n > 2048)


def test_token_count_edges(edge, empty):
    got = token_counts.token_counts(edge).collect()
    assert len(got) == edge.count() and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert token_counts.token_counts(empty).collect() == []


def check_packing(rows, texts, window=2048):
    """Every id once, no gap in a sequence, right checksums."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for k, parts in docs.items():
        want = [*ids(texts[k] or ""), 1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *want[at:at + r.length]))
            at += r.length
        assert at == len(want)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sequences


def test_packing_query(docs001, texts001):
    rows = packing.pack(docs001).collect()
    n = len(check_packing(rows, texts001))
    assert sum(r.length for r in rows) >= 0.95 * 2048 * (n - 1)


def test_packing_in_several_groups(docs001, texts001):
    check_packing(packing.pack(docs001, docs_per_group=30, window=256).collect(), texts001, 256)


def test_packing_edges(plain_edge, edge, empty):
    unique = plain_edge.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    check_packing(packing.pack(unique).collect(), {r.doc_id: r.text for r in unique.collect()})
    one = [r for r in packing.pack(edge).collect() if r.start == 0]
    assert len(one) == edge.count()
    assert packing.pack(empty).collect() == []


def brute_best_fit(lengths, window):
    rooms, out = [], []
    for size in lengths:
        fits = [r for r in rooms if r >= size]
        if fits:
            room = min(fits)
            rooms.remove(room)
        else:
            room = window
        out.append(window - room)
        rooms.append(room - size)
    return sorted(out), sorted(rooms)


@pytest.mark.parametrize("window", [1, 7, 100, 2048])
def test_best_fit_takes_the_tightest_window(window):
    rnd = random.Random(window)
    lengths = sorted((rnd.randrange(1, window + 1) for _ in range(400)), reverse=True)
    seq, off = packing.best_fit(lengths, window)
    room = {}
    for s, o, n in zip(seq, off, lengths):
        assert o == window - room.get(s, window)
        room[s] = room.get(s, window) - n
    assert brute_best_fit(lengths, window) == (sorted(off), sorted(room.values()))
