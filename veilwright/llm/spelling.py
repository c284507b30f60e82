"""Spelling variants: words one edit apart, found by tries of letter-group counts.

A word is arranged by how many letters of each of ``GROUPS`` groups it has. One
inserted, deleted or replaced letter changes these counts by a surplus of one, a
deficit of one, or one of each, so a search goes down the trie of counts with a
budget of one surplus and one deficit and drops a branch when it is spent. What
it reaches at a leaf is verified on the letters.

There is a trie for every half: an edit leaves the first or the last half of a
word as it is, so a word is looked for below its own two halves only, and tries
stay small when the vocabulary is large. Tries are tables of nodes; all searches
go down one level (``SPAN`` groups) at a time by a join, so that no task holds a
trie, AQE may split a node with many words, and every step can be run again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffled

#: Letter groups, and how many of them make a level of the trie.
GROUPS, SPAN = 12, 4
#: The letters of a word: lower-case a-z (A-Z become these) and U+00C0 to U+00FF.
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
#: Words that a task remembers before it sends their counts on; and the length of text above which runs are read one by one.
REMEMBERED, LONG_TEXT = 200_000, 1_000_000


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, slips: int | None = 199, remembered: int = REMEMBERED, long_text: int = LONG_TEXT) -> DataFrame:
    """(word, n): how often each word of at least ``least`` letters occurs in all texts.

    Runs of letters are lower-cased in A-Z only. With ``slips`` the crc32 of
    ``<id>:<run>``, where that number divides it, names a letter that is left out.
    Null and empty texts have no words, a null id is '', repeated rows count each
    time, and other columns are not read. Texts are counted one by one and sums of
    a task are sent on in parts, so memory doesn't grow with the table.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if not text:
                    continue
                # Bytes are lower-cased in A-Z only.
                text = text.encode().lower().decode()
                found = Counter(runs.findall(text) if len(text) < long_text else (m.group() for m in runs.finditer(text)))
                start = zlib.crc32(f"{b.column(0)[i].as_py()}:".encode())
                for run, n in found.items():
                    if slips and (h := zlib.crc32(run.encode(), start)) % slips == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least:
                            continue
                    total[run] += n
                if len(total) >= remembered:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})
                    total.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(total.values(), pa.int64())})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(word: Column, level: int) -> list[Column]:
    """How many letters of each group of a level the word has."""
    out = []
    for g in range(level * SPAN, (level + 1) * SPAN):
        letters = "".join(c for c in LETTERS if ord(c) % GROUPS == g)
        out.append(F.length(word) - F.length(F.translate(word, letters, "")))
    return out


def _root(word: Column, length: Column, last: bool) -> Column:
    """The trie of the first or last half, for searches from words of ``length``."""
    half = F.floor(length / 2).cast("int")
    part = word.substr(F.length(word) - (length - half) + 1, length - half) if last else word.substr(F.lit(1), half)
    return F.xxhash64(F.lit(last), length, part)


def _steps(node: Column, state: Column, counts: list[Column]) -> Column:
    """array<struct<node, state>>: the children that a search may visit. State 0: nothing spent; 1: the surplus; 2: both.

    Of two words with a letter replaced, that with the surplus in the earlier group
    finds the other, so a deficit is spent after the surplus only.
    """

    def child(changed: dict[int, int], to: Column | int) -> Column:
        at = F.xxhash64(node, *(c + changed[i] if i in changed else c for i, c in enumerate(counts)))
        return F.struct(at.alias("node"), (F.lit(to) if isinstance(to, int) else to).cast("int").alias("state"))

    out = [child({}, state)]
    for i, c in enumerate(counts):
        out.append(F.when((state == 0) & (c > 0), child({i: -1}, 1)))
        out.append(F.when(state == 1, child({i: 1}, 2)))
        out += [F.when((state == 0) & (c > 0), child({i: -1, j: 1}, 2)) for j in range(i + 1, len(counts))]
    return F.array_compact(F.array(*out))


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): pairs of ``words`` (word, n; words distinct, of two letters or more) that differ by exactly one inserted, deleted or replaced letter, once each.

    Node names are hashes of the path; two paths of one name would cost a
    comparison, not a result.
    """
    word, length, levels = F.col("word"), F.length("word"), range(GROUPS // SPAN)
    halves = F.explode(F.array(*(_root(word, n, last) for n in (length, length + 1) for last in (False, True)))).alias("n0")
    trie = words.select("word", "n", halves)
    for k in levels:
        trie = trie.withColumn(f"n{k + 1}", F.xxhash64(F.col(f"n{k}"), *_counts(word, k)))
    trie = materialise(trie.drop("n0"), "tries")
    roots = F.explode(F.array(*(F.struct(_root(word, length, last).alias("node"), F.lit(last).alias("last")) for last in (False, True)))).alias("r")
    at = words.select("word", "n", roots).select("word", "n", "r.*", F.lit(0).alias("state"))
    for k in levels:
        seen = at.select("word", "n", "last", F.explode(_steps(F.col("node"), F.col("state"), _counts(word, k))).alias("s")).select("word", "n", "last", "s.*")
        if k < levels[-1]:
            there = trie.select(F.col(f"n{k + 1}").alias("node")).distinct()
            at = seen.join(shuffled(there), "node")
    leaves = trie.select(F.col(f"n{GROUPS // SPAN}").alias("node"), F.col("word").alias("b"), F.col("n").alias("nb"))
    met = seen.withColumnsRenamed({"word": "a", "n": "na"}).join(shuffled(leaves), "node")
    # A pair that shares its first half is found there; words of equal counts find each other, so one way is enough.
    half = F.floor(F.length("a") / 2).cast("int")
    once = (~F.col("last") | (F.col("a").substr(F.lit(1), half) != F.col("b").substr(F.lit(1), half))) & ((F.col("state") != 0) | (F.col("a") < F.col("b")))
    lengths = F.length("a") - F.length("b") == (F.col("state") == 1).cast("int")
    return met.filter(once & lengths & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): the near word of largest n, smallest word of equal ones, if n is ``times`` the word's own.

    Forms have larger counts, so the way from form to form ends; it is followed by
    doubling. A word has a bounded number of near words (edits times letters).
    """
    words = materialise(words, "words")
    pairs = materialise(near_words(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), "b")).alias("best"))
    out = words.join(shuffled(best), "word", "left").withColumn("form", F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.b")))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.m")).alias("form_n"))
    out = materialise(out, "forms")
    up = materialise(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("at"), F.col("root").alias("to"))
        step = materialise(up.join(shuffled(further), F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return out.join(shuffled(up), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, at_least: int = 5, times: int = 5, slips: int | None = None) -> DataFrame:
    """``variants`` of the words of ``docs`` with ``least`` letters and ``at_least`` occurrences; words of one root are a group."""
    return variants(occurrences(docs, id_col, text_col, least, slips).filter(F.col("n") >= at_least), times)
