"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks
are sorted and get integer names; adjacent names are paired, the distinct pairs
are sorted and named again, and so on, until one name stands for each document.
Two documents have the same (level, name) exactly if their texts are equal: a
name is given to a content, never to a hash of it. Names are sorted within hash
partitions, not over all of them: a partition's number is part of a name, which
keeps names distinct and the same for equal contents.

Scale: the content of the blocks is shuffled once, after map-side combination
(a block that a third of the rows share reaches the naming once per map task).
All later steps move integers. Blocks find their names by a 128-bit key that is
proved free of collisions on the actual blocks before it is used; should two
different blocks ever share a key, the blocks are joined by content instead.
Tables of names are written to the shared folder, so that a recomputed task
sees the same names, and joins on them can be split by AQE if a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialise, without_spaces

BLOCK_BYTES = 8192


def _key(block: Column) -> list[Column]:
    return [F.xxhash64(block).alias("k1"), F.xxhash64(F.lit("second"), block).alias("k2")]


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys in sorted order within each partition, with integer names."""
    return rows.distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], list[Column]] = _key
) -> DataFrame:
    """(doc_id, n_chars, sha, level, name) for every row of ``docs``, repeated rows too.

    Null texts count as empty, and an empty text is one empty block. ``sha`` is
    the SHA-256 of the normalised text, as bytes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), without_spaces(text).alias("norm"))
    base = base.select("doc_id", "n_chars", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), F.encode("norm", "utf-8").alias("bytes"))
    base = base.withColumn("m", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes).cast("int")))
    blocks = base.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("idx"))
    blocks = blocks.withColumn("block", F.substring("bytes", F.col("idx") * block_bytes + 1, F.lit(block_bytes)))
    blocks = blocks.select("doc_id", "n_chars", "sha", "m", "idx", "block", *key(F.col("block")))

    names = materialise(_named(blocks.select("k1", "k2", "block"), ["k1", "k2", "block"]).select("k1", "k2", "name"), "block-names")
    on = ["k1", "k2"]
    if not names.groupBy(*on).count().filter("count > 1").isEmpty():
        on = ["k1", "k2", "block"]
        names = materialise(_named(blocks.select(*on), on), "block-names-by-content")
    level = materialise(blocks.join(names, on).select("doc_id", "n_chars", "sha", "m", "idx", "name"), "blocks-0")

    rows = level.filter("idx = 0").select("doc_id", "n_chars", "sha", "m", F.lit(0).alias("level"), "name")
    most = level.agg(F.max("m")).first()[0] or 1
    if most == 1:
        return rows.drop("m")
    level, done, depth = level.filter("m > 1").select("doc_id", "sha", "m", "idx", "name"), None, 0
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        half = F.col("idx") % 2 == 0
        pairs = level.groupBy("doc_id", "sha", ((F.col("m") + 1) / 2).cast("int").alias("m"), (F.col("idx") / 2).cast("int").alias("idx"))
        pairs = materialise(pairs.agg(F.max(F.when(half, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("b")), f"pairs-{depth}")
        names = materialise(_named(pairs.select("a", "b"), ["a", "b"]), f"pair-names-{depth}")
        named = pairs.join(names, ["a", "b"]).select("doc_id", "sha", "m", "idx", "name")
        level = materialise(named, f"level-{depth}")
        one = level.filter("m = 1").select("doc_id", "sha", F.lit(depth).alias("level"), "name")
        done = one if done is None else done.unionByName(one)
        level = level.filter("m > 1")
    long = rows.filter("m > 1").select(F.col("doc_id").alias("d"), "n_chars", F.col("sha").alias("s"))
    long = long.join(done, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("sha"))).select("doc_id", "n_chars", "sha", "level", "name")
    return rows.filter("m = 1").drop("m").unionByName(long)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], list[Column]] = _key) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null is
    empty. Of equal texts the row with most code points, then with the smallest
    doc_id, stays; a null doc_id comes after all others. Of rows that are
    repeated with doc_id and length, one is kept. An empty table gives no rows.
    """
    ids = block_identities(docs, id_col, text_col, block_bytes, key)
    rows = materialise(ids.groupBy("doc_id", "n_chars", "sha", "level", "name").agg(F.count(F.lit(1)).alias("times")), "identities")
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("best")
    groups = materialise(rows.groupBy("level", "name").agg(F.sum("times").alias("group_size"), best).select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_chars")), "groups")
    out = rows.join(groups, ["level", "name"]).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("nth") == 1)
    return out.select("doc_id", "n_chars", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one of each text, white space left aside.

    Where rows of one doc_id have texts that are equal so and of one length, any
    one of them stays. Other columns may have any name. Null and empty texts are
    one text; a null doc_id comes after all others.
    """
    groups = exact_groups(docs, id_col, text_col)
    gone, times, chars, sha = (fresh_name(docs, x) for x in ("_gone", "_times", "_chars", "_sha"))
    stay = groups.groupBy("doc_id", "n_chars", "text_sha256").agg(F.sum((~F.col("kept")).cast("long")).alias(gone), F.count(F.lit(1)).alias(times)).filter(f"{gone} > 0")
    stay = stay.select(F.col("doc_id").alias(fresh_name(docs, "_id")), F.col("n_chars").alias(chars), F.col("text_sha256").alias(sha), gone, times)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = docs[id_col].eqNullSafe(stay[stay.columns[0]]) & (F.length(text) == stay[chars])
    # The SHA-256 of a text tells rows of one doc_id and length apart; it is taken of those alone that match so far.
    joined = docs.join(stay, same & (F.sha2(without_spaces(text), 256) == stay[sha]), "left")
    clear = joined.filter(F.col(gone).isNull()).select(*[docs[c] for c in docs.columns])
    # Rows that are alike in id, length and normalised text, of which one stays.
    again = joined.filter(F.col(gone) < F.col(times)).dropDuplicates([id_col, chars, sha])
    return clear.unionByName(again.select(*docs.columns))
