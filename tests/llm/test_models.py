"""Whitening against numpy, toxicity on held-out rows, spelling variants against all pairs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import spelling, toxicity, whitening
from gridloom.llm.queries import op11_whitening, op12_toxicity, op13_spelling
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.001"


def whitened_by_numpy(vectors: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return ((n * x - sums) ** 2).sum(1), values / values.sum(), c @ axes[:, :components] / np.sqrt(values[:components])


def table_of(rows, key="vec_id"):
    keys = sorted({r[key] for r in rows})
    out = np.full((len(keys), max(r["component"] for r in rows)), np.nan)
    for r in rows:
        if r["whitened"] is not None:
            out[keys.index(r[key]), r["component"] - 1] = r["whitened"]
    return keys, out


def test_whitening_of_the_whole_table(spark):
    given_rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    vectors = np.array([r["embedding"] for r in given_rows], float)
    rows = op11_whitening(spark, SF).collect()
    assert len(rows) == len(vectors) * 32 and {r["n"] for r in rows} == {len(vectors)}
    deviation, share, want = whitened_by_numpy(vectors, 32)
    keys, got = table_of(rows)
    assert keys == [r["vec_id"] for r in given_rows]
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in rows} == dict(zip(keys, deviation.tolist()))
    assert all(abs(r["explained"] - share[r["component"] - 1]) < 1e-12 for r in rows)
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_whitening_over_several_blocks(spark, monkeypatch):
    """Rows and columns that don't fill their blocks, and more blocks than one in both directions."""
    for name, size in (("ROWS", 7), ("COLUMNS", 3), ("BLOCKS_A_TASK", 2)):
        monkeypatch.setattr(whitening, name, size)
    vectors = np.random.default_rng(1).normal(size=(60, 8)) * np.arange(1, 9)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    _, got = table_of(whitening.whiten(table, components=5).collect())
    want = whitened_by_numpy(vectors, 5)[2]
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, math.nan, 2.0]), (94, [1.0, math.inf, 2.0]), (95, [1.0, 2.0])]
    kind = "vec_id long, embedding array<double>, index long, x long, at long, whitened double, key long"
    table = spark.createDataFrame([(*r, *[None] * 5) for r in [*good, *bad, (None, [0.5, 0.5, 0.5]), good[0]]], kind)
    rows = whitening.whiten(table).collect()
    assert {r["n"] for r in rows} == {22} and len(rows) == 66 and {r["component"] for r in rows} == {1, 2, 3}
    assert Counter(r["vec_id"] for r in rows)[0] == 6 and Counter(r["vec_id"] for r in rows)[None] == 3
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: (r["vec_id"], r["component"]))[:3]] == [False, True, True]
    assert flat[0]["identity_error"] < 1e-9
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None for r in same)
    assert whitening.whiten(table.filter("vec_id = 90")).count() == 0
    assert [n for n, _ in whitening.whiten(table.limit(0)).dtypes] == [n for n, _ in whitening.whiten(table).dtypes]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op12_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    ones, zeros = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in ones) >= 0.75 * len(ones) and sum(r["predicted"] for r in zeros) <= 0.005 * len(zeros)
    away = np.array([r["score"] for r in ones])[:, None] - np.array([r["score"] for r in zeros])[None]
    assert ((away > 0) + 0.5 * (away == 0)).mean() > 0.95  # area under the curve; equal scores count half


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(3, None, 1), (77, 1, 1)], "doc_id long, toxic int, _text long")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in got)
    alone = {r["score"] for r in got if not (TEXTS[r["doc_id"]] or "").strip()}
    assert len(alone) == 1
    assert toxicity.score_documents(none, model).count() == 0
    for given_labels in (labels.filter("doc_id < 0"), labels.filter("toxic = 1")):
        bias = toxicity.fit(docs, given_labels)
        assert len(bias.keys) == 0 and toxicity.score_documents(docs, bias).select("score").distinct().count() == 1
    assert toxicity.fit(none, labels).bias == 0.0


def test_features_of_a_text():
    hashes = toxicity.Hashes()
    keys = {int(k) for g in toxicity.grams("One two, THREE four!", hashes) for k in g}
    assert keys >= {hashes["one"][0], hashes["three"][0], hashes["three"][1]} and hashes["three"][1] != hashes["thre"][0]
    pair = lambda a, b, s: int(toxicity.mixed(np.array([hashes[a][0]], np.uint64), np.array([hashes[b][0]], np.uint64), s)[0])
    assert {pair("one", "two", 1), pair("one", "three", 2), pair("one", "four", 3)} <= keys and pair("two", "one", 1) not in keys
    assert toxicity.grams(" 12 !", hashes) == []


@given(st.sets(st.integers(0, 499)))
def test_places_as_bytes(at):
    raw = toxicity.as_bytes(np.array(sorted(at), np.int64), 500)
    assert toxicity.from_bytes(raw, 500).tolist() == sorted(at) and len(raw) <= 64


def test_ftrl_keeps_what_tells_and_drops_the_rest():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(60) < 0.3) for _ in range(800)]
    labels = np.array([float(4 in r) for r in rows])
    zeros = []
    for l1 in (0.0, 4.0, 20.0):
        bias, w = toxicity.ftrl(rows, labels, 60, l1=l1)
        zeros.append(int((w == 0).sum()))
        assert w.argmax() == 4 and w[4] > 3 and bias < 0
    assert zeros[0] == 0 < zeros[1] < zeros[2]  # the stronger the term, the fewer weights


def brute(rows, least=5, most=3):
    """Counts by zlib, near words by deleting and replacing each letter."""
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= most}
    shorter = {}
    for w in words:
        for i in range(len(w)):
            shorter.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), ws in shorter.items():
        for w in ws | ({a + b} & words.keys()):
            near[w] |= ws - {w}
            if w == a + b:
                for x in ws:
                    near[x].add(w)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def told(df):
    rows = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_variants_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert told(op13_spelling(spark, SF)) == want and any(v[0] for v in want.values())


def test_variants_by_hand(spark, docs, none):
    texts = ["colour " * 9, "color " * 40, "colours " * 4, "colr " * 9, "colou " * 3, "Éclair éclair " * 5, "ÉCLAIR " * 3, "aaaaa " * 3 + "aaaaaa " * 7 + "aaaaab " * 7, "b" * 90 + " ", "loops spool " * 3]
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(None, "b" * 90 + " " + "b" * 91), (7 * 8, texts[8]), (5, "b" * 91), (6, "b" * 91 + " " + "b" * 91), (1, None), (2, "")]
    got = told(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert got["colours"][:2] == ("colour", "color") and got["colour"][0] == "color" and got["aaaaa"][0] == "aaaaaa" and got["loops"][3] == 0
    assert told(spelling.group_variants(docs)) == brute([*enumerate(TEXTS), (0, TEXTS[0])])
    assert spelling.group_variants(none).count() == 0

def test_signatures_are_not_broadcast(spark):
    """Each word has 24 signatures, and the words' own size says little about that."""
    r = random.Random(20)
    words = spark.createDataFrame([("".join(r.choices("abcdef", k=r.randint(5, 9))), 3) for _ in range(3000)], "word string, n long").distinct()
    pairs = spelling.near_pairs(words, 4)
    assert len(pairs.collect()) > 100
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=300, deadline=None)
@given(st.text("abéÀz", min_size=5, max_size=12), st.integers(0, 12), st.sampled_from("abéÀz"), st.sampled_from(["insert", "delete", "replace"]))
def test_words_one_edit_apart_share_a_signature(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = word[:at] + {"insert": letter + word[at], "delete": "", "replace": letter}[kind] + word[at + 1 :]
    shorter = min(len(word), len(other))
    a, b = spelling.part_codes([word, other])
    assert (a == b).sum() >= spelling.PARTS - 2
    assert any(spelling.anchor(word, shorter, last) == spelling.anchor(other, shorter, last) for last in (0, 1))


def test_hash_by_the_table():
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in (0, 17, 123456789)], np.uint32)
    moved = spelling.moved_on(heads, spelling.SHORT)
    for w in ("a", "word", "é" * 20):
        raw = w.encode()
        assert [int(moved[k, len(raw)]) ^ zlib.crc32(raw) for k in range(3)] == [zlib.crc32(raw, int(h)) for h in heads]


def test_variants_equal_sql(spark):
    from gridloom.llm.queries import OP13_SQL
    from tests.compare import connection, differences

    assert differences(spark, connection(SF), SF, op13_spelling, OP13_SQL) == ""
