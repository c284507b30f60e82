"""N-gram Jaccard join: exact components of documents whose 3-word shingle sets are 90 % alike.

1. *Sets.* Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the
   64-bit hashes of the distinct 3-word shingles, sorted. Equal sets form a
   class, named by a 64-bit hash of the set that is proved to be of one set (by
   a second hash and the size); only classes are compared.
2. *Candidates.* Sets that link differ in at most k = (|x| + |y|) / 19 elements
   (from the threshold 90/100). Sizes are cut into bands; for a band the hash
   range is cut into m > k parts, so that linked sets have equal parts, and a
   signature of each part is emitted. Smaller sets of a band differ in fewer
   elements, so they have several signatures in common with what they link with;
   classes with fewer common ones go. As many parts as may be empty are added,
   and a set with still more empty parts says so by extra signatures, so no
   link is lost. Pairs across a band's border have signatures of their own.
3. *Stars.* Each class is paired with one other, the smallest class of most of
   its common signatures, found by a combined minimum and a join; these pairs
   are verified. Copies and near copies of one text are linked here, by a number
   of pairs linear in the size of their group.
4. *Size-banded tiles.* Where a signature still holds classes of different
   components, its candidates are cut into tiles of one size band and at most
   ``TILE`` members and about ``TILE_BYTES`` of sets. Tiles of equal and adjacent bands meet (those of the largest
   component of a group not among themselves); within a pair of tiles, hashed
   bitmaps bound the overlap of two sets from above by their differing bits,
   and what passes is intersected exactly as sorted arrays. Only links between
   components are returned, never all pairs.

Scale: 16 bytes per signature, about 0.17 signatures a word, shuffled twice,
part by part of their hash range, so that a sixth of them lies on disk at a time;
tiles of sets are sent out in parts, too. Words and sets are never exploded. Joins are on tables read back from the
shared folder, so AQE splits hot keys. Links are joined into components by
contraction of the edge table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as W
from .common import drop_cut, fresh_name, materialise
from .components import components

SHINGLE = 3
#: Linked when PERCENT * union <= 100 * intersection.
PERCENT = 90
TILE = 256
#: Bytes of the sets of a tile; a larger set is a tile of its own, as far as hashing deals them apart.
TILE_BYTES = 32_000_000
BAND_RATIO = 1.5
#: The low bits of a signature: the three tags of a set differ in them.
KIND = 3
#: Signatures, and bytes of sets sent to tiles, that are shuffled at once; the most passes over signatures, and bytes of tiles as a multiple of those of their sets.
PASS_ROWS, PASS_BYTES, PASSES, PASS_COPIES = 8_000_000, 256_000_000, 6, 2
#: Classes of text hashes by which texts are sorted out before a shuffle.
SLOTS = 1 << 22


def bands(up_to: int) -> list[int]:
    """First sizes of the bands, from 1."""
    out = [1]
    while out[-1] <= up_to:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND_RATIO))))
    return out


_BANDS = np.array(bands(1 << 40), np.int64)


def _parts(most: int, percent: int) -> tuple[int, int]:
    """(parts, empty ones allowed) for pairs of sizes that sum to ``most``: over the most elements in which they differ."""
    k = most * (100 - percent) // (100 + percent)
    spare = 1 + k // 20 if k else 0
    return k + 1 + spare, spare


def signature_plan(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(tag, parts, spare) of a set of n elements: its band, and the border above or below if it is near one."""
    i = int(np.searchsorted(_BANDS, n, "right")) - 1
    low, high = int(_BANDS[i]), int(_BANDS[i + 1]) - 1
    out = []
    if 2 * high * (100 - percent) // (100 + percent):
        out.append((2 * i, *_parts(2 * high, percent)))
    for border, at in ((low, 2 * i - 1), (high + 1, 2 * i + 1)):
        # Pairs of x < border <= y with x >= percent / 100 * y.
        top = (border - 1) * 100 // percent
        if border > 1 and 100 * n >= percent * border and n <= top and (most := border - 1 + top) * (100 - percent) // (100 + percent):
            out.append((at, *_parts(most, percent)))
    return out


def least_shared(n: int, percent: int = PERCENT) -> dict[int, int]:
    """By the low bits of a tag, how many signatures a set of n elements has in common with any set that it links with by this tag.

    At most d parts differ where d elements do. Of the equal parts, those that are
    empty may not be told, but then they are ``spare`` at most.
    """
    i = int(np.searchsorted(_BANDS, n, "right")) - 1
    low, high = int(_BANDS[i]), int(_BANDS[i + 1]) - 1
    out = {}
    for tag, m, spare in signature_plan(n, percent):
        # The largest partner: within the band, below its first size, or above its last.
        other = min(high, 100 * n // percent) if tag == 2 * i else low - 1 if tag < 2 * i else 100 * n // percent
        out[tag & KIND] = max(1, m - spare - (n + other) * (100 - percent) // (100 + percent))
    return out


_plans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a sorted set; their low bits are those of the tag."""
    n = len(s)
    if (n, percent) not in _plans:
        _plans[n, percent] = signature_plan(n, percent)
    out, spread, high = [], None, None
    for tag, m, spare in _plans[n, percent]:
        if spread is None:
            spread, high = W.mix(s), s >> np.uint64(32)
        cuts = np.searchsorted(high, (np.arange(m, dtype=np.uint64) << np.uint64(32)) // np.uint64(m) + np.uint64(0), "left")
        full = np.diff(np.append(cuts, n)) > 0
        name = W.mix(np.arange(m, dtype=np.uint64) + np.uint64(tag << 40))
        sums = np.add.reduceat(spread, cuts[full])
        own = [W.mix(sums ^ name[full])]
        if m - len(sums) > spare:
            own.append(W.mix(name[~full] + np.uint64(0x5BD1E995)))
        out += [(x & ~np.uint64(KIND)) | np.uint64(tag & KIND) for x in own]
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text."""
    for lo, hi, data, offs in W.slices(column):
        s, e, first = W.words(data, offs, W.NON_SPACE)
        h = W.word_hashes(data, s, e)
        w = W.window_hashes(h, shingle)
        for r in range(hi - lo):
            a, b = int(first[r]), int(first[r + 1])
            if a == b:
                yield np.zeros(0, np.uint64)
            elif b - a < shingle:
                yield W.window_hashes(h[a:b], b - a)
            else:
                yield np.unique(w[a : b - shingle + 1])


def _class_hash(s: np.ndarray, seed: int) -> tuple[int, int]:
    a = W.mix(s + np.uint64(seed))
    one = W.mix(np.add.reduce(a, keepdims=True) + np.uint64(len(s)))
    two = W.mix(np.add.reduce(W.mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True) + np.uint64(seed))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Exact intersection size of sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` hashed bits per set."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for r, s in enumerate(sets):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(out[r], at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def tile_links(left: list[tuple], right: list[tuple] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between components among (component, sorted set), a spanning forest of them. right None: within left."""
    rows = left if right is None else left + right
    if not rows:
        return []
    sizes = np.array([len(s) for _, s in rows])
    bits = 1 << max(9, int(4 * sizes.max()).bit_length())
    maps = bitmaps([s for _, s in rows], bits)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(left)):
        lo, hi = (i + 1, len(rows)) if right is None else (len(left), len(rows))
        if lo >= hi:
            continue
        # The differing bits are at most the differing elements, so 2 * overlap <= sizes - differing bits.
        apart = np.bitwise_count(maps[i] ^ maps[lo:hi]).sum(axis=1)
        total = sizes[i] + sizes[lo:hi]
        most = np.minimum((total - apart) // 2, np.minimum(sizes[i], sizes[lo:hi]))
        for j in (np.flatnonzero(100 * most >= percent * (total - most)) + lo).tolist():
            a, b = root(rows[i][0]), root(rows[j][0])
            if a != b and linked(rows[i][1], rows[j][1], percent):
                parent[max(a, b)] = min(a, b)
                out.append((rows[i][0], rows[j][0]))
    return out


def _shingled(docs: DataFrame, shingle: int, percent: int, seed: int) -> DataFrame:
    """(doc_id, h1, h2, n, c, c2, sigs) of each row of ``docs`` (doc_id, h1, h2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sigs = [], [], [], []
            for s in sets_of(b.column(3), shingle):
                n.append(len(s))
                x = _class_hash(s, seed)
                one.append(x[0])
                two.append(x[1])
                sigs.append(signatures(s, percent))
            offs = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            made = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], names=["doc_id", "h1", "h2", "n", "c", "c2", "sigs"])

    longs = [T.StructField(x, T.LongType()) for x in ("h1", "h2", "n", "c", "c2")]
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *longs, T.StructField("sigs", T.ArrayType(T.LongType()))]))


def _arrays(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(c, s): the set of each of ``classes`` (c, doc_id, h1, h2), as bytes, read again from the text of the row that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets_of(b.column(1), shingle)], pa.binary())], names=["c", "s"])

    key = classes.select("c", F.col("doc_id").alias("r"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    # At most SLOTS rows are broadcast, so that few other texts are shuffled where few classes are compared.
    slots = key.select(F.pmod("r1", F.lit(SLOTS)).alias("slot")).distinct()
    found = docs.join(F.broadcast(slots), F.pmod("h1", F.lit(SLOTS)) == F.col("slot"), "left_semi").join(key, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("r")))
    # Rows that repeat both doc_id and text stand for a class once.
    return found.select("c", "text").dropDuplicates(["c"]).mapInArrow(run, "c long, s binary")


def _as_set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _with_enough(counts: DataFrame, percent: int) -> DataFrame:
    """(c, kind) of those of (c, kind, k, n) that have as many common signatures as a link takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, dict[int, int]] = {}
        for b in batches:
            kind, k, n = (b.column(i).to_pylist() for i in (1, 2, 3))
            for size in set(n) - known.keys():
                known[size] = least_shared(size, percent)
            enough = pa.array([have >= known[size][t] for t, have, size in zip(kind, k, n, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["c", "kind"]).filter(enough)

    return counts.select("c", "kind", "k", "n").mapInArrow(run, "c long, kind long")


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [linked(_as_set(x), _as_set(y), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(at, pa.bool_()))

    x = arrays.select(F.col("c").alias("a"), F.col("s").alias("x"))
    y = arrays.select(F.col("c").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _tiled(members: DataFrame, arrays: DataFrame, percent: int, tile: int, tile_bytes: int) -> DataFrame:
    """Links between the components of each group of ``members`` (g, c, n, label), as (label, label)."""
    main = members.groupBy("g", "label").count().groupBy("g").agg(F.max(F.struct("count", "label")).alias("m"))
    main = materialise(main.select("g", F.col("m.label").alias("main")), "main-labels")
    low = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("long")
    rows = members.join(main, "g").select("g", "c", "n", "label", low.alias("band"), (F.col("label") == F.col("main")).cast("int").alias("big"))
    rows = materialise(rows, "members")
    subs = F.ceil(F.greatest(F.count(F.lit(1)) / tile, 8 * F.sum("n") / tile_bytes)).alias("subs")
    counts = materialise(rows.groupBy("g", "band", "big").agg(subs, (8 * F.sum("n")).alias("bytes")), "tile-counts")
    tiles = counts.select("g", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1), lambda i: F.struct(F.col("band").alias("band"), F.col("big").alias("big"), i.alias("sub")))).alias("t"))
    near = (F.abs(F.col("l.band") - F.col("r.band")) <= 1) & (F.col("l.big") + F.col("r.big") < 2) & (F.col("l") <= F.col("r"))
    pairs = tiles.select("g", F.col("t").alias("l")).join(tiles.select("g", F.col("t").alias("r")), "g").filter(near)
    same = F.col("l") == F.col("r")
    sides = F.array(F.struct(F.col("l").alias("t"), F.lit(True).alias("left")), F.when(~same, F.struct(F.col("r").alias("t"), F.lit(False).alias("left"))))
    sides = pairs.select("g", F.xxhash64("g", "l", "r").alias("p"), "l", "r", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("side"))
    sides = materialise(sides.select("g", "p", "l", "r", "side.t", "side.left"), "tile-pairs")
    sub = F.pmod(F.xxhash64("c"), F.col("subs"))
    placed = rows.join(counts, ["g", "band", "big"]).select("g", "c", "label", F.struct("band", "big", sub.alias("sub")).alias("t"))
    # How many bytes all tile pairs get, against those of the sets.
    each = counts.select("g", "band", "big", (F.col("bytes") / F.col("subs")).alias("each"))
    sent = sides.select("g", "t.band", "t.big").join(each, ["g", "band", "big"]).agg(F.sum("each")).first()[0] or 0
    own = counts.agg(F.sum("bytes")).first()[0] or 0
    passes = 1 + int(sent // max(PASS_BYTES, PASS_COPIES * own))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("left", "descending"), ("c", "ascending")])
        split = pc.sum(t.column("left")).as_py()
        rows = [(x.as_py(), _as_set(s)) for x, s in zip(t.column("label"), t.column("s"), strict=True)]
        same = t.column("l")[0].as_py() == t.column("r")[0].as_py()
        out = tile_links(rows[:split], None if same else rows[split:], percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    def links(k: int) -> DataFrame:
        some = placed.join(sides.filter(F.pmod("p", F.lit(passes)) == k), ["g", "t"])
        found = some.join(arrays, "c").select("p", "g", "l", "r", "left", "label", "c", "s")
        return materialise(found.groupBy("p", "g", "l", "r").applyInArrow(run, "a long, b long"), "tile-links")

    return reduce(DataFrame.unionByName, [links(k) for k in range(passes)])


def _common(sets: DataFrame) -> DataFrame:
    """(sig, c, kind): the signatures that several classes of ``sets`` have; a part of the hash range after the other, the shuffle files of each go before the next."""
    passes = min(PASSES, 1 + (sets.agg(F.sum(F.size("sigs"))).first()[0] or 0) // PASS_ROWS)
    kind = F.col("sig").bitwiseAND(F.lit(KIND).cast("long"))
    parts = []
    for k in range(passes):
        emitted = sets.select(F.explode("sigs").alias("sig"), "c")
        if passes > 1:
            # The low bits are those of the tag.
            emitted = emitted.filter(F.pmod(F.shiftright("sig", 2), F.lit(passes)) == k)
        shared = emitted.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("sig")
        shared = materialise(shared, "shared-signatures")
        parts.append(materialise(emitted.join(shared, "sig").select("sig", "c", kind.alias("kind")).distinct(), "common-signatures"))
        drop_cut(shared)
    return reduce(DataFrame.unionByName, parts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, text): a row is known by its id and 128 bits of its text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), text.alias("text"))


def _components(docs: DataFrame, shingle: int, percent: int, tile: int, tile_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` as by ``_keyed``: the rows (doc_id, h1, h2, n, c), classes (c, size, rep) and labels (c, label) of the classes that are linked."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    for seed in range(1, 9):  # a name of 64 bits per class; another seed in the case that two classes share one
        sets = materialise(_shingled(docs, shingle, percent, seed), "shingle-sets")
        classes = sets.filter("n > 0").groupBy("c").agg(F.min("n").alias("n"), F.max("n").alias("n_max"), F.min("c2").alias("c2"), F.max("c2").alias("c2_max"), F.min(first).alias("rep"), F.count(F.lit(1)).alias("size"))
        classes = materialise(classes, "classes")
        if classes.filter("n <> n_max OR c2 <> c2_max").isEmpty():
            break
    else:
        raise ValueError("no seed gives distinct names")
    rows = materialise(sets.drop("sigs"), "rows")
    common = _common(sets)
    drop_cut(sets)
    enough = common.groupBy("c", "kind").agg(F.count(F.lit(1)).alias("k")).join(classes.select("c", "n"), "c")
    enough = materialise(_with_enough(enough, percent), "classes-with-enough")
    some = common.join(enough, ["c", "kind"]).select("sig", "c")
    shared = some.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("sig", "lo")
    shared = materialise(shared, "shared-by-enough")
    held = materialise(some.join(shared, "sig").select("sig", "c", "lo"), "held-signatures")
    drop_cut(shared)
    drop_cut(common)
    # The smallest class with which a class shares most signatures; what else it may link with is left to the tiles.
    star = held.filter("c > lo").groupBy("c", "lo").agg(F.count(F.lit(1)).alias("k")).groupBy("c").agg(F.max(F.struct("k", "lo")).alias("m"))
    star = materialise(star.select(F.col("c").alias("a"), F.col("m.lo").alias("b")), "star-pairs")

    wanted = held.select("c").distinct()
    reps = materialise(classes.join(wanted, "c").select("c", "n", "rep.doc_id", "rep.h1", "rep.h2"), "compared-classes")
    arrays = materialise(_arrays(docs, reps, shingle), "compared-sets")
    links = materialise(_verified(star, arrays, percent), "star-links")
    labels = components(links).select(F.col("node").alias("c"), F.col("component").alias("label"))

    # Signatures whose classes aren't all of one component yet.
    named = materialise(held.join(labels, "c", "left").select("sig", "c", F.coalesce("label", "c").alias("label")), "named")
    drop_cut(held)
    still = named.groupBy("sig").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.min("c").alias("hub")).filter("l1 < l2").select("sig", "hub")
    left = materialise(named.join(still, "sig").select("c", "label", "hub").distinct(), "open")
    drop_cut(named)
    if left.isEmpty():
        drop_cut(arrays)
        return rows, classes, labels
    groups = components(left, "c", "hub")
    members = left.select("c", "label").distinct().join(groups, F.col("c") == F.col("node")).join(reps.select("c", "n"), "c")
    more = _tiled(materialise(members.select(F.col("component").alias("g"), "c", "n", "label"), "open-members"), arrays, percent, tile, tile_bytes)
    joined = components(more)
    # A label that is joined to others is a class too, so it has a row of its own unless it stands alone.
    labels = labels.unionByName(left.select("c", "label").distinct().join(labels.select("c"), "c", "left_anti"))
    labels = labels.join(joined, F.col("label") == F.col("node"), "left").select("c", F.coalesce("component", "label").alias("label"))
    drop_cut(arrays)
    return rows, classes, materialise(labels, "labels")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: component_id is the smallest doc_id reachable by links.

    Null and empty texts have no set and are linked with nothing. Rows of equal
    text link as any others, also where ids are repeated or null. A null doc_id
    is never the name of a component unless all of its rows have none. Ids may
    be of any type that has an order; columns of other names are not read. An
    empty table gives no rows.
    """
    sets, classes, labels = _components(_keyed(docs, id_col, text_col), shingle, percent, tile, tile_bytes)
    ids = classes.select("c", F.col("rep.doc_id").alias("low"))
    named = labels.join(ids, "c")
    named = materialise(named.groupBy("label").agg(F.min("low").alias("component_id")).join(labels, "label").select("c", "component_id", F.lit(True).alias("linked")), "component-names")
    found = ids.join(named, "c", "left").select("c", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    out = sets.filter("n > 0").select("doc_id", "n", "c").join(found, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row of each component, that of the smallest doc_id, and all rows without a set; own columns.

    A null doc_id comes after all others. Rows of one doc_id with other texts
    are rows of their own; of those that repeat both, one stays.
    """
    sets, classes, labels = _components(_keyed(docs, id_col, text_col), shingle, percent, tile, tile_bytes)
    rows = classes.select("c", "rep", "size").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    best = rows.groupBy("label").agg(F.min("rep").alias("rep"), F.sum("size").alias("size"))
    # Only components of several rows lose any.
    stay, gone, k1, k2, key = (fresh_name(docs, x) for x in ("_stay", "_gone", "_k1", "_k2", "_key"))
    crowded = best.filter("size > 1").select("label", F.col("rep").alias("best"))
    crowded = rows.join(crowded, "label").select("c", "best")
    lost = sets.filter("n > 0").join(crowded, "c").groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias(gone), F.first("best").alias("best"))
    is_best = (F.col("best.h1") == F.col("h1")) & (F.col("best.h2") == F.col("h2")) & F.col("best.doc_id").eqNullSafe(F.col("doc_id"))
    lost = lost.select(F.col("doc_id").alias(key), F.col("h1").alias(k1), F.col("h2").alias(k2), F.col(gone), is_best.alias(stay)).filter(f"NOT `{stay}` OR `{gone}` > 1")
    lost = materialise(lost, "rows-to-drop")
    text = F.col(text_col).cast("string")
    same = (F.xxhash64(text) == F.col(k1)) & (F.xxhash64(F.lit("second"), text) == F.col(k2)) & F.col(id_col).eqNullSafe(F.col(key))
    joined = docs.join(lost, same, "left")
    clear = joined.filter(F.col(stay).isNull()).select(*[docs[c] for c in docs.columns])
    # Repeated rows of which one stays.
    again = joined.filter(F.col(stay)).select(*[docs[c] for c in docs.columns]).dropDuplicates([id_col, text_col])
    return clear.unionByName(again)
