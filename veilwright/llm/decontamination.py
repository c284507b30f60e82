"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over token windows.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] of the text with A-Z
lower-cased. Every 13 consecutive words of a benchmark item are a window; an
item with fewer words, but not none, is one window. A word of a document that
lies in an occurrence of a window is hit.

The windows of a benchmark of up to ``BLOCK_CHARS`` characters are sent to the
executors as a hash set: sorted 64-bit hashes with the place of each window in
the benchmark's text, about five bytes a character. The documents are scanned
once, in a map, and never shuffled. A larger benchmark stays a table of windows;
a Bloom filter of ``BLOOM_BITS`` bits goes to the executors, and what passes it
is joined with the table. So the broadcast is bounded however large the
benchmark is. Hash hits are verified on the words themselves in both cases.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as W
from .common import fresh_name, materialise

WINDOW = 13
#: Characters of benchmark text in a broadcast set: some 40 MB.
BLOCK_CHARS = 8_000_000
#: Bits of the filter for larger benchmarks (32 MB), and bits that a window sets.
BLOOM_BITS, BLOOM_HASHES = 28, 3
#: Texts of windows whose items a task remembers.
REMEMBERED = 20_000
_LOW_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normalised(data: np.ndarray, start: int, end: int) -> bytes:
    """The words of a stretch of text, lower-cased, with single spaces."""
    return b" ".join(_LOW_WORD.findall(W.lowered(data, start, end)))


def windows_of(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, row, hashes, first byte, end byte, size) of the windows of each text that has words."""
    for lo, hi, data, offs in W.slices(column):
        s, e, first = W.words(data, offs, W.ALNUM)
        h = W.word_hashes(data, s, e)
        for r in range(lo, hi):
            a, b = int(first[r - lo]), int(first[r - lo + 1])
            if a < b:
                size = min(window, b - a)
                yield data, r, W.window_hashes(h[a:b], size), s[a : b - size + 1], e[a + size - 1 : b], size


class WindowSet:
    """The windows of benchmark items as sorted arrays by size."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        found: dict[int, list[tuple]] = defaultdict(list)
        texts, total, last = [], 0, None
        for data, r, h, start, end, size in windows_of(pa.array([t for _, t in items], pa.large_string()), window):
            if data is not last:
                total += len(last) if last is not None else 0
                texts.append(data.copy())
                last = data
            found[size].append((h, np.full(len(h), r, np.int32), (start + total).astype(np.int32), (end + total).astype(np.int32)))
        self.data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.windows = {}
        for size, parts in found.items():
            h, item, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.windows[size] = (h[order], item[order], start[order], end[order])
        self.filters: dict[int, tuple[int, np.ndarray]] = {}
        self.memory: dict[bytes, frozenset] = {}

    def _filter(self, size: int) -> tuple[int, np.ndarray]:
        """(bits, which of the first bits occur), made where it is used."""
        if size not in self.filters:
            known = self.windows[size][0]
            bits = max(10, min(24, int(16 * len(known)).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.filters[size] = (bits, seen)
        return self.filters[size]

    def items_with(self, size: int, h: np.uint64, at: int, text: bytes) -> frozenset:
        """The items with this window; ``at`` is the first of its hash."""
        got = self.memory.get(text)
        if got is None:
            known, item, start, end = self.windows[size]
            ids = set()
            while at < len(known) and known[at] == h:
                if normalised(self.data, start[at], end[at]) == text:
                    ids.add(self.ids[item[at]])
                at += 1
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            got = self.memory[text] = frozenset(ids)
        return got

    def scan(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """Of each row with a hit: (first word, size) of its hit windows, and their items."""
        h, found = W.word_hashes(data, s, e), {}
        for size, (known, *_) in self.windows.items():
            w = W.window_hashes(h, size)
            if not len(w):
                continue
            bits, seen = self._filter(size)
            at = np.flatnonzero(seen[(w >> np.uint64(64 - bits)).astype(np.int64)])
            place = np.searchsorted(known, w[at])
            row = np.searchsorted(first, at, "right") - 1
            ok = (known[np.minimum(place, len(known) - 1)] == w[at]) & (at + size <= first[row + 1])
            for i, r, q in zip(at[ok].tolist(), row[ok].tolist(), place[ok].tolist(), strict=True):
                ids = self.items_with(size, w[i], q, normalised(data, s[i], e[i + size - 1]))
                if ids:
                    spots, own = found.setdefault(r, ([], set()))
                    spots.append((i - int(first[r]), size))
                    own.update(ids)
        return found


def _spans(mask: np.ndarray) -> list[int]:
    """First word and last word + 1 of each run of hit words, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.tolist()


def _code_points(raw: bytes, at: list[int]) -> list[int]:
    """Byte offsets in ascending order as code points."""
    out, done, so_far = [], 0, 0
    for x in at:
        so_far, done = so_far + len(raw[done:x].decode("utf-8", "replace")), x
        out.append(so_far)
    return out


_ADDED = {"n_words": (T.LongType(), pa.int64()), "hits": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "chars": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "items": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}


def _described(text: pa.Array, hits_of) -> list[pa.Array]:
    """The four new columns; ``hits_of`` gives the hits of a slice of rows as ``WindowSet.scan`` does."""
    made: dict[str, list] = {k: [] for k in _ADDED}
    for lo, hi, data, offs in W.slices(text):
        s, e, first = W.words(data, offs, W.ALNUM)
        count = np.diff(first)
        made["n_words"] += count.tolist()
        for k in ("hits", "chars", "items"):
            made[k] += [[] for _ in range(hi - lo)]
        for r, (spots, ids) in hits_of(lo, hi, data, s, e, first).items():
            mask = np.zeros(int(count[r]), bool)
            for i, size in spots:
                mask[i : i + size] = True
            runs, at = _spans(mask), []
            for i in range(0, len(runs), 2):
                at += [int(s[first[r] + runs[i]] - offs[r]), int(e[first[r] + runs[i + 1] - 1] - offs[r])]
            made["hits"][lo + r], made["items"][lo + r] = runs, sorted(x for x in ids if x is not None)
            made["chars"][lo + r] = _code_points(data[offs[r] : offs[r + 1]].tobytes(), at)
    return [pa.array(made[k], kind) for k, (_, kind) in _ADDED.items()]


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four more columns; the second value gives their names.

    n_words (long), hits (array of word numbers: first and last + 1 of each hit
    run), chars (the same in code points of the text), items (array of the item
    ids as strings, sorted, distinct). New columns get underscores in front
    where ``docs`` has a column of that name. A null text has no words. A null
    item id hits like others, but isn't listed. Repeated rows are rows of their
    own. Empty tables are no case of their own: no documents give no rows, no
    items give no hits.
    """
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    names = {x: fresh_name(docs, x) for x in _ADDED}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[k], kind) for k, (kind, _) in _ADDED.items())])
    if chars > block_chars:
        return _scan_by_join(docs, items, text_col, schema, window), names
    # At most block_chars characters come to the driver.
    known = docs.sparkSession.sparkContext.broadcast(WindowSet([(r[0], r[1]) for r in items.collect()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value

        def hits_of(lo: int, hi: int, data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> dict:
            return windows.scan(data, s, e, first)

        for b in batches:
            new = _described(b.column(b.schema.get_field_index(text_col)), hits_of)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), *new], names=schema.names)

    return docs.mapInArrow(run, schema), names


def _window_table(items: DataFrame, window: int) -> DataFrame:
    """(h, words, size, item) of the windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, r, h, start, end, size in windows_of(b.column(1), window):
                words = pa.array([normalised(data, x, y) for x, y in zip(start, end, strict=True)], pa.binary())
                item = pa.array([b.column(0)[r].as_py()] * len(h), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), words, pa.array(np.full(len(h), size, np.int32)), item], names=["h", "words", "size", "item"])

    return items.mapInArrow(run, "h long, words binary, size int, item string")


def bloom_positions(h: np.ndarray) -> list[np.ndarray]:
    return [(W.mix(h + np.uint64(k)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for k in range(BLOOM_HASHES)]


def _bloom(table: DataFrame) -> np.ndarray:
    """The filter of all windows, as 64-bit words; at most 2 ** (BLOOM_BITS - 6) rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.unique(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bloom_positions(h)))], names=["at"])

    at = table.select("h").mapInArrow(run, "at long")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _text_key(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _scan_by_join(docs: DataFrame, items: DataFrame, text_col: str, schema: T.StructType, window: int) -> DataFrame:
    """The same for benchmarks of any size: windows that pass the filter are joined with those of the benchmark; a text is known by 128 bits."""
    table = materialise(_window_table(items, window), "benchmark-windows")
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # up to ``window`` of them
    known = docs.sparkSession.sparkContext.broadcast(_bloom(table))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = known.value
        for b in batches:
            for lo, _, data, offs in W.slices(b.column(2)):
                s, e, first = W.words(data, offs, W.ALNUM)
                h = W.word_hashes(data, s, e)
                for size in sizes:
                    w = W.window_hashes(h, size)
                    at = np.arange(len(w))
                    for k in range(BLOOM_HASHES):
                        p = bloom_positions(w[at])[k]
                        at = at[(bloom[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    row = np.searchsorted(first, at, "right") - 1
                    ok = at + size <= first[row + 1] if len(at) else np.zeros(0, bool)
                    at, row = at[ok], row[ok]
                    words = pa.array([normalised(data, s[i], e[i + size - 1]) for i in at.tolist()], pa.binary())
                    take = pa.array(lo + row)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(take), b.column(1).take(take), pa.array(w[at].view(np.int64)), words, pa.array((at - first[row]).astype(np.int32))],
                        names=["k1", "k2", "h", "words", "at"],
                    )

    k1, k2 = _text_key(text_col)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
    found = keyed.mapInArrow(candidates, "k1 long, k2 long, h long, words binary, at int").join(table, ["h", "words"])
    c1, c2, spots, ids = (fresh_name(docs, x) for x in ("_k1", "_k2", "_spots", "_ids"))
    found = found.groupBy(F.col("k1").alias(c1), F.col("k2").alias(c2)).agg(F.collect_set(F.struct("at", "size")).alias(spots), F.collect_set("item").alias(ids))
    joined = docs.join(materialise(found, "hits"), (k1 == F.col(c1)) & (k2 == F.col(c2)), "left").select(*[docs[c] for c in docs.columns], spots, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 2
            where, own = b.column(n), b.column(n + 1)

            def hits_of(lo: int, hi: int, data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, where=where, own=own) -> dict:
                return {r - lo: ([(x["at"], x["size"]) for x in where[r].as_py()], set(own[r].as_py())) for r in range(lo, hi) if where[r].is_valid}

            new = _described(b.column(b.schema.get_field_index(text_col)), hits_of)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *new], names=schema.names)

    return joined.mapInArrow(run, schema)


def _n_hit(hits: str) -> str:
    return f"aggregate(sequence(1, size(`{hits}`), 2), 0L, (s, i) -> s + coalesce(try_element_at(`{hits}`, i + 1) - try_element_at(`{hits}`, i), 0))"


def contamination(docs: DataFrame, benchmark: DataFrame, **kw) -> tuple[DataFrame, dict[str, str]]:
    """As ``scan``, with n_hit and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    out, names = scan(docs, benchmark, **kw)
    names["n_hit"] = fresh_name(out, "n_hit")
    out = out.withColumn(names["n_hit"], F.when(F.size(names["hits"]) == 0, F.lit(0).cast("long")).otherwise(F.expr(_n_hit(names["hits"]))))
    names["contaminated"] = fresh_name(out, "contaminated")
    flag = (F.col(names["n_hit"]) > 0) & (20 * F.col(names["n_hit"]) >= F.col(names["n_words"]))
    return out.withColumn(names["contaminated"], flag), names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    out, names = contamination(docs, benchmark, **kw)
    return out.filter(~F.col(names["contaminated"])).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """All documents, without the characters from the first to the last word of each hit run."""
    out, names = scan(docs, benchmark, text_col=text_col, **kw)
    c = names["chars"]
    text = F.expr(f"""concat(aggregate(sequence(1, size(`{c}`), 2), struct(0 as at, '' as kept),
        (s, i) -> struct(try_element_at(`{c}`, i + 1) as at, concat(s.kept, substring(`{text_col}`, s.at + 1, try_element_at(`{c}`, i) - s.at)) as kept),
        s -> s.kept), substring(`{text_col}`, try_element_at(`{c}`, -1) + 1))""")
    return out.withColumn(text_col, F.when(F.size(c) == 0, F.col(text_col)).otherwise(text)).select(*docs.columns)
