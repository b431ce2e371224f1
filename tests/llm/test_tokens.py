"""Operators 2 and 5 against the libraries themselves."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from revspark.llm import byte_bpe, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(BYTES)
BPE = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["a", "B", "The", "in", "É", "ß", "\n", " ", "  ", "'s", "'LL", "1", "%%%", "!!", "日本", "\U0001f600", "\xa0", "Σ", "ς", "İ", "ŀ", "²", "\x1c", "x̸", "<|endoftext|>", "ﬁ", "\x85", "'"]


def odd_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_word_tokens_equal_the_library():
    texts = odd_texts(3000)
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordTokens(WORDS).ids(pa.array(texts, pa.string()))] == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_equals_tiktoken(text):
    ids = BPE.encode(text.encode("utf-8", "ignore").decode())
    assert ids == TIKTOKEN.encode_ordinary(text.encode("utf-8", "ignore").decode())
    assert BPE.decode(ids) == text.encode("utf-8", "ignore")


def test_byte_bpe_of_long_matches():
    rng = random.Random(1)
    for text in ["a" * 3000, "=" * 20000, " " * 4000, "ab" * 4000, "".join(rng.choice("etaoinshr") for _ in range(15000)), *odd_texts(1500)]:
        assert BPE.encode(text) == TIKTOKEN.encode_ordinary(text)


def test_byte_bpe_column_round_trip(messy, empty):
    pattern = public_tokenizers.PATTERN
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(messy, BYTES, pattern), BYTES, pattern).collect()
    want = sorted((r.doc_id, (r.text or "").encode()) for r in messy.select("doc_id", "text").collect())
    assert sorted((r.doc_id, bytes(r.decoded)) for r in got) == want
    assert all(list(r.ids) == TIKTOKEN.encode_ordinary(bytes(r.decoded).decode()) for r in got)
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(empty, BYTES, pattern), BYTES, pattern).collect() == []


def test_sum_of_squares_by_definition():
    rng = random.Random(2)
    for _ in range(30):
        cap = rng.choice([10, 64])
        lengths = np.array([rng.randint(1, cap) for _ in range(120)])
        where, offset = packing.sum_of_squares(lengths, cap)
        fill = defaultdict(int)
        for b, o, s in zip(where.tolist(), offset.tolist(), lengths.tolist()):
            gaps = [cap - f for f in fill.values() if f < cap]

            def cost(h):
                new = list(gaps)
                if h is not None:
                    new.remove(h)
                left = (cap if h is None else h) - s
                new += [left] if left else []
                return sum(new.count(g) ** 2 for g in set(new))

            chosen = cap - fill[b] if b in fill else None
            assert fill[b] == o
            assert cost(chosen) == min(cost(h) for h in [None, *(g for g in set(gaps) if g >= s)])
            fill[b] += s
        assert max(fill.values()) <= cap


def test_packing_places_every_piece_once(messy, empty):
    got = packing.pack(packing.pieces(messy, WORDS, with_ids=True)).collect()
    tok = Tokenizer.from_file(WORDS)
    want = []
    for r in messy.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, k, k * 4096, ids[k * 4096:(k + 1) * 4096]) for k in range(-(-len(ids) // 4096))]
    assert sorted((r.doc_id, r.piece, r.start, list(r.ids)) for r in got) == sorted(want)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(packing.pieces(empty, WORDS)).collect() == []


def test_packing_keeps_large_ids_beside_null_and_spreads_equal_rows(spark):
    rows = [(2**53 + 1, "a"), (2**53 + 3, "b"), (None, "c"), (None, None)] + [(5, "same")] * 200
    pieces = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(pieces, capacity=8, shard_pieces=20).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    # Equal rows fall into many shards, none much larger than asked for.
    shards = [r.sequence_id >> 32 for r in got]
    assert len(set(shards)) == 11 and max(map(shards.count, shards)) < 60
    seen = {}
    for r in got:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 8
