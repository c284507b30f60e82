"""Personal data: base patterns, and terms that reveal who they belong to; DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers,
found by pattern and proved by their digits. For a value c (the entity to protect)
and a word t of a document that holds it, the corpus says how strongly t reveals c:

    PMI(c; t) = log2(n(c, t) * N / (n(c) * n(t))),   IC(c) = -log2(n(c) / N)

with N documents, n(t) those that contain t, n(c) those with c, and n(c, t) those
with both. A word is disclosing if PMI(c; t) >= IC(c) / ALPHA, that is if at least
2^(-IC (1 - 1 / ALPHA)) of its documents are c's: with the default 72 % for a
value in one document of a thousand, 52 % of a million, 37 % of a billion. Every occurrence of it in the documents that
hold the value is a span of kind 'term'.

Values that occur in the same documents have the same counts with every word, so
they are counted as one class, named by 128 bits of their set of documents; a
document with very many values of its own has one class of them.

Scale: patterns run in the JVM behind cheap tests; positions are running sums of
the lengths between matches, by blocks. Words and base spans of a document are
merged in the order of their positions, by windows over the document. n(t) is
counted over all words of all documents with map-side combination. Words too
common to pass for any n(c, t) are dropped before words and classes of a document
are paired. All joins and groups are by value, word or document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialise

ALPHA = 1.05
#: Elements of an array over which running values are taken at a time.
BLOCK = 64

#: The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")

# The base patterns; atomic groups and the tests of the character before keep them linear and leave the matches the same:
# a match can begin within a run of its first class only where the match before it ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]+"
#: Pieces of a text that end with whole words.
PIECE = r"(?s).{1,512}[\p{L}\p{N}]*+"


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x computed once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """array<int>: the first k elements joined, for each k; blocks first, then what comes before each block."""
    none = F.array().cast("array<int>")

    def along(array: Column, start: Column) -> Column:
        return F.aggregate(array, start, lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x).otherwise(join(F.element_at(s, -1), x)))))

    def by_blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: along(F.slice(v, i * BLOCK + 1, F.lit(BLOCK)), none))

        def joined(local: Column) -> Column:
            last = along(F.transform(local, lambda x: F.element_at(x, -1)), none)
            return bound(last, lambda t: F.flatten(F.transform(local, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: join(F.get(t, i - 1), y))))))

        return F.when(F.size(v) <= BLOCK, along(v, none)).otherwise(bound(cut, joined))

    return bound(values, by_blocks)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.length(g) + F.length(h))
        ends = running(steps, lambda s, x: s + x)
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))

    return bound(hits, lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when((F.length(digits) - i) % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(digits, "(?!^)(?=.)"), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _proved(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        n = F.length(_digits(m))
        return (n >= 12) & (n <= 19) & F.when((n >= 12) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end, m>> in order of start, then kind."""
    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}
    none = F.array().cast("array<struct<start:int,k:int,end:int,m:string>>")

    def of(k: int, kind: str) -> Column:
        good = F.filter(located(text, PATTERNS[kind]), lambda x: _proved(kind, x["m"]))
        shaped = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["m"].alias("m")))
        return F.when(has[kind], shaped).otherwise(none)

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS[:4]))))


def _words(text: Column) -> Column:
    """array<struct<m, start, end>>: the words of a text, piece by piece."""

    def of(p: Column) -> Column:
        return F.transform(located(p["m"], WORD), lambda w: F.struct(w["m"].alias("m"), (w["start"] + p["start"]).alias("start"), (w["end"] + p["start"]).alias("end")))

    return F.flatten(F.transform(located(text, PIECE), of))


def _entity(x: Column) -> Column:
    value = F.when(x["k"] == 0, F.lower(x["m"])).when(x["k"] == 1, x["m"]).otherwise(_digits(x["m"]))
    return F.concat_ws(":", x["k"].cast("string"), value)


def outside(held: DataFrame) -> DataFrame:
    """(d, h, entity, term, start, end): the words of each document d, h that overlap no base span.

    Of a word that a base span cuts, what is left beside the span is a term for
    this span's entity only; of whole words the entity is null.
    """
    words = held.select("d", "h", F.explode("words").alias("w"))
    spans = held.select("d", "h", F.explode("base").alias("x")).distinct()
    no_word, no_span = F.lit(None).cast(words.schema["w"].dataType), F.lit(None).cast(spans.schema["x"].dataType)
    ends = F.explode(F.array(F.struct(F.col("x.start").alias("pos"), F.lit(True).alias("first")), F.struct(F.col("x.end").alias("pos"), F.lit(False).alias("first")))).alias("p")
    points = words.select("d", "h", F.col("w.start").alias("pos"), F.lit(1).alias("order"), "w", no_span.alias("x"), F.lit(False).alias("first"))
    points = points.unionByName(spans.select("d", "h", "x", ends).select("d", "h", "p.pos", F.lit(0).alias("order"), no_word.alias("w"), "x", "p.first"))
    upward = Window.partitionBy("d", "h").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, 0)
    cut = points.withColumn("w", F.last("w", ignorenulls=True).over(upward)).filter((F.col("order") == 0) & (F.col("w.start") < F.col("pos")) & (F.col("pos") < F.col("w.end")))
    before, at = F.col("pos") - F.col("w.start"), F.col("first")
    part = F.when(at, F.substring("w.m", F.lit(1), before)).otherwise(F.substring(F.col("w.m"), before + 1, F.length("w.m")))
    cut = cut.select("d", "h", _entity(F.col("x")).alias("entity"), F.lower(part).alias("term"), F.when(at, F.col("w.start")).otherwise(F.col("pos")).alias("start"), F.when(at, F.col("pos")).otherwise(F.col("w.end")).alias("end"))
    whole = words.select("d", "h", F.lit(None).cast("string").alias("entity"), F.lower("w.m").alias("term"), "w.start", "w.end")
    # A word overlaps a span that begins before its end and ends after its start: the furthest end of those that begin up to
    # its start, and the first start of those that begin later, say so.
    both = whole.unionByName(cut).withColumns({"s_start": F.lit(None).cast("int"), "s_end": F.lit(None).cast("int")})
    both = both.unionByName(spans.select("d", "h", F.col("x.start").alias("start"), F.col("x.start").alias("s_start"), F.col("x.end").alias("s_end")), allowMissingColumns=True)
    up = Window.partitionBy("d", "h").orderBy("start", F.col("s_start").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("d", "h").orderBy(F.desc("start"), F.col("s_start").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"reached": F.max("s_end").over(up), "next": F.min("s_start").over(down)})
    free = (F.coalesce("reached", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return both.filter(F.col("term").isNotNull() & free).select("d", "h", "entity", "term", "start", "end").distinct()


def disclosing(words: DataFrame, entities: DataFrame, touching: DataFrame, docs: DataFrame, text_col: str, alpha: float) -> tuple[DataFrame, DataFrame]:
    """What is disclosing, from distinct (d, h, term), (d, h, entity) and (d, h, entity, term) of documents d, h, and the whole corpus.

    (d, h, term) of the words of documents, and (entity, term) of those that are
    terms for one entity only.
    """
    n = F.lit(float(max(1, docs.count())))
    all_words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)))).alias("term"))
    of_term = all_words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    # The set of an entity's documents: as many, and with the same sums of two hashes.
    of_entity = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), F.bit_xor(F.xxhash64("d", "h")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), "d", "h")).alias("x2"))
    of_entity = materialise(of_entity, "pii-values")
    ic = -F.log2(F.col("n_c") / n)
    pmi = F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
    told = pmi >= ic / alpha - 1e-9
    # n_ct is at most n_c, and n_t.
    bound_ = F.log2(F.least("n_c", "n_t") * n / (F.col("n_c") * F.col("n_t")))
    may = bound_ >= ic / alpha - 1e-6
    # A word in so many documents that it passes for no n_c: the share of its documents that must be c's rises with n_c.
    most = of_entity.agg(F.max("n_c").alias("n_c"))
    rare = of_term.join(F.broadcast(most)).filter((F.col("n_t") <= F.col("n_c")) | may).drop("n_c")
    known = materialise(words.select("term").unionByName(touching.select("term")).distinct().join(rare, "term"), "pii-words")
    key = ["x1", "x2", "n_c"]
    named = materialise(entities.join(of_entity, "entity"), "pii-classes")
    classes = named.select("d", "h", *key).distinct()
    pairs = words.join(known, "term").join(classes, ["d", "h"]).filter(may)
    pairs = materialise(pairs.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n_ct"), F.max("n_t").alias("n_t")), "pii-pairs")
    beside = touching.join(known, "term").join(of_entity, "entity").groupBy("entity", "term", *key).agg(F.count(F.lit(1)).alias("n_x"), F.max("n_t").alias("n_t"))
    beside = beside.join(pairs.select(*key, "term", F.col("n_ct").alias("n_w")), [*key, "term"], "left").withColumn("n_ct", F.col("n_x") + F.coalesce("n_w", F.lit(0)))
    beside = materialise(beside.filter(told).select("entity", "term"), "pii-beside")
    in_docs = classes.join(pairs.filter(told).select(*key, "term"), key).select("d", "h", "term")
    in_docs = in_docs.unionByName(entities.join(beside, "entity").select("d", "h", "term"))
    return in_docs.distinct(), beside


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, th, base, terms) of each row; th is the xxhash64 of its text.

    base: array<struct<start, k, end, m>>, k a number of KINDS; terms:
    array<struct<start, k, end>> of disclosing words. A null text is empty and
    has neither. Rows of one doc_id are told apart by their text; repeated rows
    get the same spans, and count once in n(c) and n(c, t). Columns of other
    names are not read. Empty tables give none.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", base_spans(F.col("text")).alias("base"))
    has = F.size("base") > 0
    words = F.when(has, _words(F.col("text"))).otherwise(F.array().cast("array<struct<m:string,start:int,end:int>>"))
    rows = materialise(rows.withColumn("words", words).drop("text"), "pii-spans")
    held = rows.filter(has).select(F.coalesce(F.to_json(F.struct("doc_id")), F.lit("")).alias("d"), F.col("th").alias("h"), "base", "words")
    terms = materialise(outside(held), "pii-outside")
    in_words, beside = terms.filter("entity IS NULL").drop("entity"), terms.filter("entity IS NOT NULL")
    # Beside a span only: not also a word of the document.
    beside = beside.join(in_words.select("d", "h", "term").distinct(), ["d", "h", "term"], "left_anti")
    entities = materialise(held.select("d", "h", F.explode("base").alias("x")).select("d", "h", _entity(F.col("x")).alias("entity")).distinct(), "pii-entities")
    told, told_beside = disclosing(in_words.select("d", "h", "term").distinct(), entities, beside.select("d", "h", "entity", "term").distinct(), docs, "text", alpha)
    marked = in_words.join(told, ["d", "h", "term"]).select("d", "h", "start", "end")
    marked = marked.unionByName(beside.join(told_beside, ["entity", "term"]).select("d", "h", "start", "end"))
    spans = marked.select("d", "h", F.struct("start", F.lit(4).alias("k"), "end").alias("x")).distinct().groupBy("d", "h").agg(F.array_sort(F.collect_list("x")).alias("terms"))
    rows = rows.drop("words").withColumn("_d", F.coalesce(F.to_json(F.struct("doc_id")), F.lit("")))
    rows = rows.join(spans, (F.col("_d") == F.col("d")) & (F.col("th") == F.col("h")), "left")
    return rows.select("doc_id", "th", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,k:int,end:int>>")).alias("terms"))


def listed(spans: Column) -> Column:
    """'kind:start:end' of spans in their order, comma-joined."""
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def all_spans(base: Column, terms: Column) -> Column:
    plain = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    return F.array_sort(F.concat(plain, terms))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with each span generalised to its kind in brackets; of overlapping spans the first counts, up to the end of the last."""
    found = find(docs, id_col, text_col, **kw).filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "th"])
    d, h, spans = (fresh_name(docs, x) for x in ("_vw_d", "_vw_h", "_vw_s"))
    found = found.select(F.col("doc_id").alias(d), F.col("th").alias(h), all_spans(F.col("base"), F.col("terms")).alias(spans))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")
    reached = running(F.transform(spans, lambda x: x["end"]), F.greatest)

    def put(r: Column) -> Column:
        """Block by block of spans: what stands before each, from a stretch of text that is cut out once, and its kind."""

        def of_block(i: Column) -> Column:
            first = F.when(i == 0, F.lit(0)).otherwise(F.get(r, i * BLOCK - 1))
            last = F.get(r, F.least((i + 1) * BLOCK, F.size(r)) - 1)

            def one(own: Column, x: Column, j: Column) -> Column:
                at = F.when(i * BLOCK + j == 0, F.lit(0)).otherwise(F.get(r, i * BLOCK + j - 1))
                return F.when(x["start"] < at, F.lit("")).otherwise(F.concat(F.substring(own, at - first + 1, x["start"] - at), F.element_at(kind, x["k"] + 1)))

            return bound(F.substring(text, first + 1, last - first), lambda own: F.array_join(F.transform(F.slice(F.col(spans), i * BLOCK + 1, F.lit(BLOCK)), lambda x, j: one(own, x, j)), ""))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), of_block)
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(r, -1) + 1, F.length(text)))

    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(bound(reached, put))).select(*docs.columns)
