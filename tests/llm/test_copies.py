import random

import numpy as np
import pytest

import gridloom.llm.simhash as simhash
from gridloom.llm import passages, tiles
from gridloom.staging import staged
from tests.llm.conftest import TEXTS


def components(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_by_hand():
    import xxhash

    text = "Foo bar BAZ foo bar baz qux"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint("É É".encode()) == xxhash.xxh64_intdigest("É É", 42)


def test_near_duplicates_edges(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in enumerate(TEXTS)}
    want = components(fps, 3)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_copies(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if t not in TEXTS[:i] and (t is None or t.strip())]
    assert simhash.keep_first(none).count() == 0


def test_repeated_rows_of_one_id_keep_the_least_text(spark):
    rows = [(1, "b text", 2), (1, "a text", 9), (1, "a text", 4), (2, None, 1), (2, "other words here", 1), (None, "x y", 1), (None, "x y", 1)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert len(kept) == 4 and {(r["doc_id"], r["text"]) for r in kept} == {(1, "a text"), (2, None), (None, "x y")}


def reached(edges, nodes):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize("tile", [2000, 7, 1])
def test_links_of_hot_blocks(spark, tile):
    """Fingerprints around a few centres: tiles of any size give the components of all links."""
    r = random.Random(6)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(40 if tile > 1 else 8)})
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    got = simhash.linked_fingerprints(spark.createDataFrame(rows, "node long, fp0 long"), 3, 5, 1, tile).collect()
    assert reached([(x["src"], x["dst"]) for x in got], range(len(fps))) == components(dict(enumerate(fps)), 3)


def test_links_of_one_large_block_grow_with_its_rows(spark):
    """16,000 fingerprints near one centre, in tiles of 500: few links, and the components of all pairs."""
    r = random.Random(21)
    centre, low = r.getrandbits(64), 24  # all share the upper bits, so every choice of upper blocks is one block
    fps = set()
    while len(fps) < 16_000:
        fps.add(centre ^ sum(1 << b for b in r.sample(range(low), r.randint(0, 9))))
    values = np.array(sorted(fps), np.uint64)
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values.view(np.int64).tolist())], "group long, node long, data long").repartition(4)
    got = [(x["src"], x["dst"]) for x in tiles.links(rows, tiles.Hamming(3), 500).collect()]
    assert len(got) < 2 * len(values)
    want = {i: i for i in range(len(values))}
    for x, ys in tiles.forest(tiles.Hamming(3).near(values), len(values)):
        for y in ys.tolist():
            want[y] = x
    assert reached(got, want) == reached(want.items(), want)


@pytest.mark.parametrize("tile", [2000, 5])
def test_near_copies_by_brute_force(spark, tile):
    """Jaccard of five-word shingles over all pairs; edits keep words near, so fingerprints lose none of these links."""
    r = random.Random(7)
    docs, shingles = {}, {}
    for base in range(8):
        words = [f"w{r.randrange(3000)}x" for _ in range(200)]
        for n in range(12):
            own = list(words)
            for i in r.sample(range(200), r.choice((0, 1, 2, 3, 5, 8))):
                own[i] = f"e{r.randrange(3000)}"
            docs[base * 100 + n] = own
    docs[999] = sorted(docs[0])  # the words of another, in another order
    docs[998], docs[997] = ["a", "b"], ["A", "b"]
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(x.lower() for x in w)} for i, w in docs.items()}
    edges = [(i, j) for i in docs for j in docs if j < i and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    want = reached(edges, docs)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(df, tile_rows=tile).collect()}
    assert {i: got.get(i, i) for i in docs} == want and len(set(want.values())) > 8
    assert sorted(x["doc_id"] for x in simhash.keep_first(df, tile_rows=tile).collect()) == sorted(set(want.values()))


def sentence(r, n):
    return [f"t{r.randrange(5000)}" for _ in range(n)]


def test_passages_against_brute_force(spark):
    r = random.Random(8)
    shared, line = sentence(r, 70), sentence(r, 12)
    fuzzy = list(shared)
    fuzzy[20], fuzzy[45] = "edited", "changed"
    del fuzzy[60]
    docs = {
        1: [*sentence(r, 40), *shared, *sentence(r, 30)],
        2: [*sentence(r, 80), *line, *sentence(r, 80)],
        3: [*shared, *sentence(r, 50)],
        4: [*sentence(r, 33), *fuzzy, *sentence(r, 33), *line],
        5: sentence(r, 200),
        6: [*line, *sentence(r, 49)],
        7: [],
        8: [*sentence(r, 10), *shared[:40], *sentence(r, 60)],
    }
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for x in passages.repeated_passages(df).collect():
        got.setdefault(x["doc_id"], []).append((x["start_word"], x["end_word"], x["first_id"]))
    assert set(got) == {3, 4}
    (s, e, f), = got[3]
    assert (s, f) == (0, 1) and 70 <= e <= 72
    (s, e, f), = got[4]
    assert f == 1 and abs(s - 33) <= 2 and abs(e - 102) <= 2
    out = {x["doc_id"]: x["text"] for x in passages.drop_passages(df).collect()}
    assert all(out[i] == t for i, t in rows if i not in (3, 4)) and len(out[3].split()) <= 50
    assert passages.repeated_passages(df.filter("doc_id < 0")).count() == 0


def test_exact_copies_of_long_passages_are_covered(spark):
    """Every run of 60 words that an earlier document holds is covered, over documents patched from a few passages."""
    r = random.Random(9)
    pool = [sentence(r, r.randint(60, 120)) for _ in range(6)]
    docs = {i: [w for part in (sentence(r, r.randint(5, 60)) if r.random() < 0.5 else r.choice(pool) for _ in range(5)) for w in part] for i in range(40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    covered = {i: set() for i in docs}
    for x in passages.repeated_passages(df).collect():
        covered[x["doc_id"]].update(range(x["start_word"], x["end_word"]))
    first, total, missed = {}, 0, 0
    for i, w in docs.items():
        for j in range(len(w) - 59):
            if first.setdefault(tuple(w[j : j + 60]), i) < i:
                total += 1
                missed += not covered[i].issuperset(range(j, j + 60))
    assert total > 500 and missed == 0


def test_passages_whose_lines_occur_elsewhere(spark):
    """Passages of frequent lines are found between the two documents that hold them whole, not lost to those of one line."""
    r = random.Random(11)
    for size, n, least in ((14, 4, 0.95), (10, 6, 0.95)):
        lines = [sentence(r, size) for _ in range(60)]
        docs = {i: [*sentence(r, 25), *lines[i % 60], *sentence(r, 25)] for i in range(120)}
        shared = [[w for line in r.sample(lines, n) for w in line] for _ in range(20)]
        for i, words in enumerate(shared):
            docs[1000 + i] = [*sentence(r, 30), *words, *sentence(r, 30)]
            docs[2000 + i] = [*sentence(r, 40), *words, *sentence(r, 20)]
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
        found = {x["doc_id"] - 2000 for x in passages.repeated_passages(df).collect() if x["start_word"] <= 40 and x["end_word"] >= 40 + size * n}
        assert sum(i in found for i in range(20)) >= least * 20, (size, n, len(found))


def test_edited_passages_against_brute_force_alignment(spark):
    """Of the passages that a whole alignment puts at LEAST_IDENTITY or above, nearly all are found at every rate of edits."""
    r = random.Random(13)
    docs, planted = {}, {}
    for every in (20, 12, 10, 8, 6, 5):
        for _ in range(25):
            words = sentence(r, r.choice((60, 100, 200)))
            edited = list(words)
            for i in range(every // 2, len(words), every):
                edited[i] = f"edit{r.randrange(5000)}"
            n = len(planted)
            docs[n], docs[1000 + n] = [*sentence(r, 30), *words, *sentence(r, 30)], [*sentence(r, 40), *edited, *sentence(r, 20)]
            assert passages.equal_words(words, edited) >= passages.LEAST_IDENTITY * len(words)
            planted[n] = (every, 40, 40 + len(words))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    spans = {x["doc_id"] - 1000: (x["start_word"], x["end_word"]) for x in passages.repeated_passages(df).collect()}
    for every in (20, 12, 10, 8, 6, 5):
        those = [(n, s, e) for n, (v, s, e) in planted.items() if v == every]
        hit = sum(n in spans and min(e, spans[n][1]) - max(s, spans[n][0]) >= 0.8 * (e - s) for n, s, e in those)
        assert hit >= 0.9 * len(those), (every, hit)


def test_links_of_a_stream_are_those_of_the_whole():
    r = random.Random(12)
    rows = np.array(sorted((r.randrange(12), r.randrange(9), r.randrange(40)) for _ in range(300)))
    seed, doc, at = rows.T
    whole = sorted(zip(*passages.partners(doc, at, seed, 0)[0]))
    want = set()
    for i, (s, d, a) in enumerate(rows.tolist()):
        earlier = sorted({int(x) for x in doc[(seed == s) & (doc < d)]})
        nth = int(((seed[:i] == s) & (doc[:i] == d)).sum()) if s % 2 else 0
        want |= {(d, a, o, int([*at[(seed == s) & (doc == o)]][: nth + 1][-1])) for o in {*earlier[:1], *earlier[-1:]}}
    assert {x[:4] for x in whole} == want
    for size in (1, 7, 50):
        held, got = [np.zeros(0, np.int64)] * 3, []
        for i in range(0, len(rows), size):
            part = [np.append(h, x[i : i + size]) for h, x in zip(held, (doc, at, seed))]
            out, carry = passages.partners(*part, len(held[0]))
            got += zip(*out)
            held = [x[carry] for x in part]
        assert sorted(got) == whole


@pytest.mark.parametrize("holders", [1, 3, 12])
def test_passages_whose_seeds_have_smaller_and_nearer_holders(spark, holders):
    """An edited passage is found though other documents, smaller and nearer ones than its origin, hold each of its lines."""
    r = random.Random(17)
    docs = {}
    for n in range(4):
        words = sentence(r, 104)
        edited = [f"edit{n}x{i}" if i % 8 == 7 else w for i, w in enumerate(words)]
        docs[50_000 + n], docs[90_000 + n] = [*sentence(r, 30), *words, *sentence(r, 30)], [*sentence(r, 40), *edited, *sentence(r, 20)]
        for line in range(13):
            for h in range(holders):
                for first in (0, 60_000):
                    docs[first + 1000 * n + 20 * line + h] = [*sentence(r, 30), *words[8 * line : 8 * line + 7], *sentence(r, 30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in passages.repeated_passages(df).collect()}
    assert set(got) == {90_000 + n for n in range(4)}
    for n in range(4):
        x = got[90_000 + n]
        assert x["first_id"] == 50_000 + n and x["start_word"] <= 42 and x["end_word"] >= 140


def test_rare_seeds_link_all_documents_and_common_ones_are_given_out_in_any_stream():
    r = random.Random(18)
    rows = np.array(sorted((r.choice((1, 2, 3, 4, 5, r.randrange(90))), r.randrange(40), r.randrange(9)) for _ in range(2000)))
    rows = np.unique(rows, axis=0)
    seed, doc, at = rows.T
    want, single = set(), set()
    for i, (s, d, a) in enumerate(rows.tolist()):
        of = sorted({int(x) for x in doc[seed == s]})
        if len(of) > passages.COMMON:
            single.add((d, a, s))
            continue
        nth = int(((seed[:i] == s) & (doc[:i] == d)).sum()) if s % 2 else 0
        want |= {(d, a, o, int([*at[(seed == s) & (doc == o)]][: nth + 1][-1])) for o in of[1:] if o < d and o != max(x for x in of if x < d)}
    assert len(want) > 50 and len(single) > 50
    for size in (1, 7, 50, 2000):
        held, got, alone, common = [np.zeros(0, np.int64)] * 3, [], [], False
        for i in [*range(0, len(rows), size), None]:
            part = [np.append(h, x[i : i + size] if i is not None else x[:0]) for h, x in zip(held, (doc, at, seed))]
            _, ends = passages.partners(*part, len(held[0]))
            out, given, kept, common = passages.middle(*part, len(held[0]), common, i is None)
            got += [x[:4] for x in zip(*(c.tolist() for c in out))]
            alone += zip(*(x[given].tolist() for x in part))
            held = [x[ends if common else kept] for x in part]
        assert sorted(got) == sorted(want) and sorted(alone) == sorted(single), size


def test_text_of_a_short_period_makes_few_chains(spark):
    r = random.Random(14)
    rows = [(i, " ".join([*sentence(r, 40), *["a", "b"] * (200 + i), *sentence(r, 40)])) for i in range(20)]
    found = passages.chains(passages.links(passages.seeds(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")))
    assert 19 <= found.count() <= 20 * 20


def test_a_common_text_that_stays_no_passage_makes_links_by_its_documents(spark):
    r = random.Random(21)
    text, made = sentence(r, 30), {}
    for n in (30, 120):
        docs = spark.createDataFrame([(i, " ".join([*sentence(r, 60), *text, *sentence(r, 60)])) for i in range(n)], "doc_id long, text string")
        chained = staged(passages.chains(passages.links(passages.seeds(docs, "doc_id", "text"))), "chains")
        found = passages.merged(passages.aligned(chained.filter("ats is null"), docs, "doc_id", "text", "aligned"), 50)
        assert found.count() == 0
        made[n] = passages.further(chained, found).count()
    assert 0 < made[120] <= 6 * made[30]


def test_seeds_are_linked_in_turns(spark, monkeypatch):
    """No shuffle holds the seeds of all hashes, and the passages are those of one turn."""
    r = random.Random(22)
    whole = sentence(r, 90)
    rows = [(i, " ".join([*sentence(r, 40), *whole[i : 60 + i], *sentence(r, 40)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every, held = passages.seeds(docs, "doc_id", "text").count(), []
    links = passages.links
    monkeypatch.setattr(passages, "links", lambda found, *pairs: (None if pairs else held.append(found.count())) or links(found, *pairs))
    got = passages.repeated_passages(docs).collect()
    assert sum(held) == every and max(held) < 0.6 * every
    monkeypatch.setattr(passages, "TURNS", 1)
    assert sorted(got) == sorted(passages.repeated_passages(docs).collect()) and len(got) == 29


def test_places_beside_a_link_by_brute_force():
    r = random.Random(23)
    for _ in range(100):
        rows = [[sorted((r.randrange(120), r.randrange(120)) for _ in range(r.randint(1, 4))), *([(r.randrange(120), r.randrange(6)) for _ in range(r.randint(1, 12))] for _ in "ab")] for _ in range(r.randint(1, 5))]
        want = set()
        for n, (linked, here, there) in enumerate(rows):
            for a, s in here:
                for x, y in linked:
                    near = [b for b, t in there if t == s]
                    if near and abs(a - x) <= passages.MOST_GAP:
                        away = min(abs(b - (a + y - x)) for b in near)
                        want |= {(n, a, frozenset(b for b in near if abs(b - (a + y - x)) == away and abs(b - y) <= passages.MOST_GAP + passages.LEAST_SPAN))}
        flat = lambda k: [np.array(c, np.int64) for c in zip(*((n, *v) for n, row in enumerate(rows) for v in row[k]))]
        got = list(zip(*(c.tolist() for c in passages.beside(*flat(0), *flat(1), *flat(2)))))
        want = {w for w in want if w[2]}
        assert all(any(g[:2] == w[:2] and g[2] in w[2] for w in want) for g in got)
        ties = {w for w in want if len(w[2]) == 1}
        assert all((*w[:2], next(iter(w[2]))) in got for w in ties) and len(set(got)) == len(got)


def test_a_repeated_word_is_a_passage_too(spark):
    r = random.Random(16)
    rows = [(i, " ".join([*sentence(r, 30), *["spam"] * n, *sentence(r, 30)])) for i, n in enumerate((80, 70, 20))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x["doc_id"], x["first_id"], x["end_word"] - x["start_word"]) for x in got] == [(1, 0, 70)]


def test_chain_is_the_best_by_brute_force():
    r = random.Random(10)
    for _ in range(200):
        n = r.randint(1, 9)
        x = sorted(r.sample(range(30), n))
        y = [r.randrange(30) for _ in range(n)]
        best = [0.0] * n
        for i in range(n):
            best[i] = passages.WEIGHT + max([0.0, *(best[j] - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if y[j] < y[i])])
        parts = passages.chain(x, y)
        got = max(passages.WEIGHT * len(p) - sum(passages.GAP_COST * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(p, p[1:])) for p in parts)
        assert got == pytest.approx(max(best))
        assert sorted(i for p in parts for i in p) == list(range(n))


def test_passages_edges(docs, none):
    got = passages.repeated_passages(docs).collect()
    assert got == []
    assert passages.drop_passages(docs).count() == docs.count() and passages.drop_passages(none).count() == 0
