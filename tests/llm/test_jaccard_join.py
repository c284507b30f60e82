import random

import numpy as np
import pyarrow as pa
import pytest

from veilwright.llm import jaccard_join as J
from veilwright.llm.components import components


def brute(rows, shingle=3, percent=90):
    """component by doc_id, from all pairs of word-shingle sets."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, families=12, copies=14):
    rng = random.Random(seed)
    rows, i = [(0, None), (1, ""), (2, "  \t"), (3, "one two"), (4, "One two"), (5, "one two x"), (6, "one")], 7
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([4, 9, 12, 20, 40, 75, 150, 400]))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                k = rng.randrange(len(words))
                what = rng.random()
                if what < 0.4:
                    words[k] = rng.choice(vocabulary)
                elif what < 0.7:
                    words.insert(k, rng.choice(vocabulary))
                elif len(words) > 1:
                    words.pop(k)
            rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = J.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=4).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_have_enough_signatures_in_common(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    for _ in range(6000):
        n = int(rng.integers(1, 900))
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        cut = int(rng.integers(0, n // (100 // (100 - percent)) + 1))
        x = np.delete(s, rng.permutation(len(s))[:cut])
        # New elements, up to what the threshold leaves.
        room = max(0, int((100 * len(x) - percent * len(s)) / percent))
        y = np.union1d(s, rng.integers(0, 2**64, int(rng.integers(room // 2, room + 1)), dtype=np.uint64)) if room else s
        if len(x) and J.linked(x, y, percent) and not np.array_equal(x, y):
            tried += 1
            common = sorted(set(J.signatures(x, percent).tolist()) & set(J.signatures(y, percent).tolist()))
            by = {k: sum(1 for c in common if c & J.KIND == k) for k in range(4)}
            a, b = J.least_shared(len(x), percent), J.least_shared(len(y), percent)
            assert any(k in b and by[k] >= a[k] and by[k] >= b[k] for k in a), (len(x), len(y))
    assert tried > 2000


def test_signatures_lose_no_link():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, len(s) // 9) + 1))
        x = np.delete(s, rng.permutation(len(s))[:cut])
        y = np.union1d(x if rng.random() < 0.3 else s, rng.integers(0, 2**64, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64))
        if J.linked(x, y) and not np.array_equal(x, y):
            missed += not set(J.signatures(x)) & set(J.signatures(y))
    assert missed == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    names = rng.sample(range(10**12), 400)
    edges = [(names[k], names[k + 1]) for k in range(150)] + [(names[200], n) for n in names[200:300]] + [(names[k], names[k]) for k in range(300, 310)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(names[:151]) for n in names[:151]} | {n: min(names[200:300]) for n in names[200:300]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.similarity_components(empty).count() == 0
    rows = spark.createDataFrame([(2, "a b c d"), (2, "a b c d"), (1, "A b c d"), (None, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, J.similarity_components(rows).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 2, 1), (9, 0, 9)], key=str)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_of_regular_patterns_have_hashes_of_their_own():
    # A polynomial modulo 2**64 gives such a word and its swap one hash, whatever its base.
    texts = []
    for n in (64, 1024, 2048, 4096):
        w = thue_morse(n)
        texts += [w, w.translate(str.maketrans("ab", "ba")), w[::-1], w + "a", "a" + w]
    distinct = sorted(set(texts))
    sets = [s.tolist() for s in J.sets_of(pa.array(distinct))]
    assert len({x[0] for x in sets}) == len(distinct)


def test_null_ids_in_a_chain_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    near = lambda gone: " ".join(w for k, w in enumerate(words) if k not in gone)
    a, b, c = near({5}), near({5, 59, 0}), near({5, 59, 0, 1, 58, 2, 57})
    schema = "doc_id long, text string, c string, label string"
    rows = [(1, a), (None, b), (2, c), (None, "p q r s"), (None, "p q r s"), (7, "one two three"), (7, "four five six"), (8, "Four five six")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = sorted(((r.doc_id, r.component_id) for r in J.similarity_components(docs).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (7, 7), (7, 7), (8, 7)], key=str)
    # One of each component, and both texts of the id 7.
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (None, "p q r s"), (7, "one two three"), (7, "four five six")], key=str)
    assert J.keep_one(docs).columns == docs.columns


def test_string_ids_and_very_long_texts(spark):
    long = " ".join(f"x{k}" for k in range(200_000))
    rows = [("b", long), ("a", long + " y z"), ("c", long[: len(long) // 2]), ("d", "Q " * 300_000), ("e", "q q q")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_components(spark.createDataFrame(rows, "doc_id string, text string"), tile_bytes=1000).collect()}
    assert got["a"] == (200_000, "a") and got["b"] == (199_998, "a") and got["c"][1] == "c" and got["d"] == (1, "d") and got["e"] == (1, "d")


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(7)
    for _ in range(200):
        s = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        x, y = s[:50], s[rng.integers(0, 20) :]
        m = J.bitmaps([x, y], 512)
        apart = int(np.bitwise_count(m[0] ^ m[1]).sum())
        assert J.overlap(x, y) <= (len(x) + len(y) - apart) // 2


def test_sets_are_of_whole_texts():
    text = " ".join(f"x{k}" for k in range(50_000))
    assert [len(s) for s in J.sets_of(pa.array([text, None, "a a a a a"]))] == [49_998, 0, 1]


def test_parts_of_signatures_and_tiles_lose_no_link(spark, monkeypatch):
    """All are sent part by part, and what a step has used up goes before the next."""
    for name, value in (("PASS_ROWS", 400), ("PASS_BYTES", 3000), ("PASS_COPIES", 0)):
        monkeypatch.setattr(J, name, value)
    tags, gone, kept, drop = [], [], J.materialise, J.drop_cut
    monkeypatch.setattr(J, "materialise", lambda df, tag: (tags.append(tag), kept(df, tag))[1])
    monkeypatch.setattr(J, "drop_cut", lambda df: (gone.append({f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in df.inputFiles()}), drop(df))[1])
    rows = corpus(3)
    got = J.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert tags.count("common-signatures") == J.PASSES and 3 < tags.count("tile-links")
    assert {"shingle-sets", "common-signatures", "shared-signatures", "held-signatures", "named"} <= set().union(*gone)
