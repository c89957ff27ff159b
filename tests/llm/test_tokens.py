import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe, packing, token_counts
from tests.llm.conftest import TEXTS

BYTES, WORDS = bpe.vocabulary_path("byte_bpe_50k.json"), bpe.vocabulary_path("word_bpe_49k.json")
ALPHABET = [*"ab  \n\t　\xa0'sé漢😀1.,", "<|endoftext|>", " the", "\x1c", "́", "don't"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 40))) for _ in range(n)]


def test_segment_trees_equal_the_library():
    t, e = Tokenizer.from_file(BYTES), bpe.ChunkedEncoder(bpe.SegmentTreeBpe(BYTES))
    texts = [*random_texts(1500), "ab" * 700, "a" * 3000, "abc" * 999 + "é" * 200]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want
    assert [e.model.decode(i) for i in want] == [t.decode(i, skip_special_tokens=False) for i in want] == texts
    rank = bpe.rank_encoding("byte_bpe_50k.json")
    assert [rank.encode_to_numpy(x, allowed_special="all").tolist() for x in texts] == want


def test_caches_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    e, texts = bpe.ChunkedEncoder(bpe.SegmentTreeBpe(BYTES)), random_texts(200, 2)
    t = Tokenizer.from_file(BYTES)
    assert [e.encode([x])[0] for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_broken_ids_decode_like_the_library():
    t, model = Tokenizer.from_file(BYTES), bpe.SegmentTreeBpe(BYTES)
    r = random.Random(3)
    for _ in range(300):
        ids = [r.randrange(256) for _ in range(8)]
        assert model.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_word_counts_equal_the_library():
    t, c = Tokenizer.from_file(WORDS), token_counts.WordCounter(WORDS)
    texts = random_texts(1500, 4)
    assert c.count([x.encode() for x in texts]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_encode_documents(docs, none):
    t = Tokenizer.from_file(BYTES)
    rows = bpe.encode_documents(docs, with_ids=True).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, with_ids=True)).collect()
    assert {(r["doc_id"], r["text"]) for r in back} == {(i, x or "") for i, x in enumerate(TEXTS)}
    assert bpe.encode_documents(none).count() == 0


def test_count_tokens(docs, none):
    t = Tokenizer.from_file(WORDS)
    for r in token_counts.count_tokens(docs, limit=100).collect():
        text = TEXTS[r["doc_id"]] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)
    assert token_counts.count_tokens(none).count() == 0
    assert token_counts.count_tokens(docs, "piece_bpe_32k.model").filter("n_tokens > 0").count() > 0


@pytest.mark.parametrize("size", [8, 64])
def test_packing_is_gapless_and_near_the_least(docs, none, size):
    t = Tokenizer.from_file(BYTES)
    rows = packing.pack_documents(docs, size=size).collect()
    encoded = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in TEXTS]
    seqs = {}
    for r in rows:
        ids = encoded[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= -(-total // size) + 2
    assert packing.pack_documents(none).count() == 0


def test_fullest_against_all_subsets():
    from itertools import product

    r = random.Random(18)
    for _ in range(200):
        room = r.randint(5, 40)
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, room + 1), min(room, r.randint(1, 6)))}
        lengths = sorted(counts, reverse=True)
        got = packing.fullest(counts, lengths, room)
        assert all(1 <= m <= counts[n] for n, m in got) and got[0][0] == lengths[0]
        sums = (sum(n * m for n, m in zip(lengths, take)) for take in product(*(range(counts[n] + 1) for n in lengths)) if take[0])
        assert sum(n * m for n, m in got) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("ranked", [3, 50_000])
def test_packing_of_a_hot_length(spark, ranked):
    """Most pieces have one length; columns with the operator's own names stay."""
    rows = [(i, 0, 64 if i % 3 else 1 + i % 40, i) for i in range(500)]
    out = packing.pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long, _rank long"), 64, ranked=ranked)
    got = out.collect()
    assert out.columns == ["doc_id", "piece", "length", "_rank", "sequence_id", "offset"] and sorted(r["_rank"] for r in got) == list(range(500))
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 64
    assert len(seqs) <= -(-sum(r[2] for r in rows) // 64) + 1


def test_ids_equal_the_library_on_a_whole_table(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rank, t = bpe.rank_encoding("byte_bpe_50k.json"), Tokenizer.from_file(BYTES)
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [rank.encode_to_numpy(x, allowed_special="all").tolist() for x in texts] == want
    assert bpe.encoder("byte_bpe_50k.json").encode(texts) == want


def test_vocabulary_that_keeps_white_space_is_counted_whole():
    t, c = Tokenizer.from_file(BYTES), token_counts.WordCounter(BYTES)
    assert token_counts.WordCounter(WORDS).by_word and not c.by_word
    texts = random_texts(200, 19)
    assert c.count([x.encode() for x in texts]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_plan_fills_bins_by_subset_sums():
    plan = packing.plan_bins({7: 2, 5: 3, 4: 1, 3: 3, 2: 2}, 10)
    bins = max(r[4] + (r[2] - r[1]) // r[3] for r in plan)
    assert bins == -(-(14 + 15 + 4 + 9 + 4) // 10)
    assert packing.fullest({6: 1, 5: 2}, [6, 5], 10) == [(6, 1)]
    assert packing.plan_bins({}, 10) == []
