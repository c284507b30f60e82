"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import types as T

from veilwright.llm import spelling

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def counted(docs, slips):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, times=5):
    out = {}
    for w, n in words.items():
        near = sorted((-m, x) for x, m in words.items() if x != w and one_edit(w, x))
        form = near[0][1] if near and -near[0][0] >= times * n else None
        out[w] = [form, None, n, len(near), -near[0][0] if form else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def rows(df):
    got = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def typo(rng, w):
    k, c = rng.randrange(len(w)), rng.choice("abcdefghijklmnopqrstuvwxyzéß")
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w + c, c + w])


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abeinrstÀéÿ×") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    docs = []
    for i in range(400):
        words = [rng.choice(base[: 1 + int(40 * rng.random() ** 2)]) for _ in range(60)]
        words = [typo(rng, w) if rng.random() < 0.3 else w for w in words]
        docs.append((i, rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    docs += [(None, "repeated " * 7), (7, None), (8, ""), (9, "short abc 123"), (3, docs[3][1]), (10, "x" * 5000 + " " + "x" * 5001 + " " + ("y" * 7000 + " ") * 5)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], DOCS).repartition(5)
    for slips in (199, 3, None):
        words = {w: n for w, n in counted(docs, slips).items() if n >= 5}
        want = grouped(words)
        assert rows(spelling.spelling_groups(df, slips=slips)) == want
        assert slips is None or any(x[0] for x in want.values())


def test_chains_ties_and_repeated_letters(spark):
    words = {"aaaaaa": 1, "aaaaaaa": 5, "aaaaaaaa": 25, "aaaaaaab": 125, "baaaaaab": 625, "ccccca": 10, "cccccb": 50, "cccccd": 50, "zzzzzz": 3, "mamama": 4, "aamama": 40}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows(spelling.variants(df))
    assert got == grouped(words)
    assert got["aaaaaa"][1] == "baaaaaab" and got["ccccca"][0] == "cccccb" and got["zzzzzz"] == (None, "zzzzzz", 3, 0, None)


def test_long_texts_and_parts_of_a_task_change_nothing(spark):
    text = " ".join(f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    want = {r.word: r.n for r in spelling.occurrences(df, remembered=3, long_text=10).collect()}
    assert want == dict(counted([(1, text), (2, text)], 199))


def test_empty_table(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_no_side_of_a_join_is_broadcast(spark):
    """The steps of a search are many times its words, which Spark's estimates don't show."""
    df = spark.createDataFrame([("aaaaaa", 1), ("aaaaaaa", 5)], "word string, n long")
    for x in (spelling.near_words(df), spelling.variants(df)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
