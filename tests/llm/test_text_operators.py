"""Decontamination, exact dedup, tokens, packing, pieces and language ID against brute force and round trips."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from veilwright.llm import byte_tokens, decontamination, exact_dedup, language_id, packing, piece_transducer, sentencepiece_codec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RANKS = P.path("byte_bpe_50k.tiktoken")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def hits_of(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), sorted(str(i) for i in ids if i is not None))
    return out


@pytest.mark.parametrize("block_chars", [10**6, 120])
def test_decontamination(spark, block_chars):
    rng = random.Random(3)
    words = ["Éa", "b", "c9", "ZZ", "d"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 13, 14, 30])))) for k in range(12)] + [(99, None), (98, "... !!"), (None, "b b b c9")]
    docs = [(k, "-".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, ", ".join(items[3][1].split()))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("mine"))
    b = spark.createDataFrame(items, "item_id long, text string")
    out, names = decontamination.contamination(d, b, block_chars=block_chars)
    assert names["hits"] != "hits"
    got = {r["doc_id"]: (r[names["n_words"]], r[names["n_hit"]], r[names["items"]]) for r in out.collect()}
    assert got == hits_of(docs, items)
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(d, b, block_chars=block_chars).collect()}
    assert kept == {k for k, (n, h, _) in got.items() if not (h > 0 and 20 * h >= n)}


def test_span_removal_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "Keep this. One TWO three! And this."), (2, None), (3, "é one, two three")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(d, b).collect()}
    assert got == {1: "Keep this. ! And this.", 2: None, 3: "é "}
    assert decontamination.remove_spans(d, b.limit(0)).count() == 3 and decontamination.remove_spans(d.limit(0), b).count() == 0


def test_decontamination_of_long_texts_ties_and_clashing_names(spark):
    rng = random.Random(8)
    item = [f"q{k}" for k in range(20)]
    words = [rng.choice("abcdef") for _ in range(300_000)]
    words[150_000:150_000] = item
    rows = [(1, " ".join(words), 1, "x"), (2, "Q0 " + " ".join(item), 2, "y"), (2, "Q0 " + " ".join(item), 2, "y"), (None, " ".join(item[:12]), 3, None), (5, "é" * 500_000, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items int, n_hit string")
    items = spark.createDataFrame([(k, " ".join(item)) for k in range(3)], "item_id long, text string")
    for block_chars in (10**6, 10):
        out, names = decontamination.contamination(docs, items, block_chars=block_chars)
        got = sorted(((r["doc_id"], r[names["n_words"]], r[names["n_hit"]], r[names["items"]], r[names["contaminated"]]) for r in out.collect()), key=str)
        ids = ["0", "1", "2"]
        assert got == sorted([(1, 300_020, 20, ids, False), (2, 21, 20, ids, True), (2, 21, 20, ids, True), (None, 12, 0, [], False), (5, 1, 0, [], False)], key=str)
        assert out.columns[:4] == docs.columns
        assert decontamination.drop_contaminated(docs, items, block_chars=block_chars).count() == 3


def grouped(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in by.items()}


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(spark, collide):
    rng = random.Random(5)
    base = ["".join(rng.choices("ab\n é", k=rng.choice([0, 1, 7, 8, 9, 40, 200]))) for _ in range(25)]
    rows = [(i, t if rng.random() < 0.6 else re.sub("a", "a \t", t)) for i, t in enumerate(rng.choices(base, k=150))]
    rows += [(500, None), (500, None), (None, "ab"), (501, "x"), (501, "y"), (502, "x" * 64 + "y" * 64), (503, "y" * 64 + "x" * 64)]
    key = (lambda b: [F.lit(1).cast("long").alias("k1"), F.octet_length(b).cast("long").alias("k2")]) if collide else exact_dedup._key
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_groups(df, block_bytes=8, key=key).collect()
    want = grouped(rows)
    assert len(got) == len(rows)
    by = {(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()): want[re.sub(r"[\x20\x09-\x0D]", "", t or "")] for i, t in rows}
    for r in got:
        assert (r.keep_id, r.group_size) == by[r.doc_id, r.text_sha256]
    assert sum(r.kept for r in got) == len(want)
    if not collide:
        left = exact_dedup.deduplicate(df.withColumn("_gone", F.lit(1)))
        assert left.count() == len(want) and "_gone" in left.columns
        assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_dedup_of_space_variants_under_one_id(spark):
    rows = [(1, "a b", 0), (1, " ab", 1), (1, "ab", 2), (2, "ab", 3), (None, "c", 4), (None, "c ", 5), (None, " c", 6), (3, None, 7), (3, "", 8), (4, " \t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, re.sub(r"\s", "", r.text), len(r.text)) for r in got.collect()), key=str) == [(1, "ab", 3), (4, "", 2), (None, "c", 2)]


@pytest.fixture(scope="module")
def tokens():
    return byte_tokens.ByteTokens(RANKS, P.PATTERN)


def test_token_ids_equal_the_library(tokens):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    bits = ["the", "ing", "  ", " ", "\n", "é", "7", "世界", "😀", "'s", "<|endoftext|>", "er", " t", "\x1c", "　", "!", "ll", "x" * 40]
    for _ in range(3000):
        x = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        want = lib.encode(x, add_special_tokens=False).ids
        assert list(tokens.encode(x)) == want
        assert list(tokens.encode(x, 16, 4)) == want, x
    long = " ".join(rng.choices(["alpha", "beta,", "gamma\n", "δ"], k=40_000))
    assert list(tokens.encode(long)) == lib.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [40_000])
def test_token_ids_of_long_unbroken_texts(tokens, n):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    cases = [
        "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n)),
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)),
        "a" * n, "ab" * n, "abc" * n, "世" * n, "\u0378" * 5000, " " * n, "\n" * n, "!" * n, "" + "'" * n, "😀" * n, "7" * n, byte_tokens.SPECIAL * (n // 13), "'s" * n,
        "".join(rng.choices("!'#-", k=n)),
        "".join(rng.choices(["'s", "a", "1", " ", "x" * 3000, "世" * 2000, "\n\n", byte_tokens.SPECIAL, " " * 1500], k=n // 800)),
    ]
    for x in cases:
        want = lib.encode(x, add_special_tokens=False).ids
        assert tokens.encode(x).tolist() == want, x[:20]
        assert tokens.encode(x[:3000], 64, 8).tolist() == lib.encode(x[:3000], add_special_tokens=False).ids, x[:20]
    for _ in range(1500):  # runs of one kind, cut inside
        x = "".join(rng.choice(["ab", "b", "'", "''", "1", "世", "!", "'s", "'re", " ", "\n"]) * rng.randint(1, 9) for _ in range(rng.randint(1, 12)))
        assert tokens.encode(x, 16, 4).tolist() == lib.encode(x, add_special_tokens=False).ids, x


def test_counts_and_packs_of_odd_rows(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "y"), (None, "d " * 700, "z"), ("k", None, ""), ("k", "", ""), ("k", "e" * 9, "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, ids string")
    packs = packing.pack(docs, RANKS, P.PATTERN, seq_len=16).collect()
    assert sum(r.n_tokens for r in packs) == sum(r.n_tokens for r in byte_tokens.count_tokens(docs, RANKS, P.PATTERN).collect())
    assert sorted(d or "" for r in packs for d, p in zip(r.doc_ids, r.parts, strict=True) if p == 0) == ["", "", "", "k"]
    counted = byte_tokens.count_tokens(docs.limit(0), RANKS, P.PATTERN)
    assert counted.count() == 0 and counted.columns == ["doc_id", "text", "ids", "n_bytes", "n_tokens"]


def test_token_counts_of_the_table(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("n_tokens", F.lit("mine"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, ""), (-2, "", "")], "doc_id long, text string, n_tokens string"))
    for r in byte_tokens.count_tokens(docs, RANKS, P.PATTERN, chunk=3000).collect():
        assert r.n_bytes == len((r.text or "").encode()) and r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)


def test_packing_is_lossless_and_best_fit(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    packs = packing.pack(docs, RANKS, P.PATTERN, seq_len=256, shard_bytes=100_000).collect()
    parts = defaultdict(dict)
    for r in packs:
        ids = np.frombuffer(r.input_ids, np.uint16)
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == packing.SPECIAL_ID).all()
        for k, (d, p) in enumerate(zip(r.doc_ids, r.parts, strict=True)):
            parts[d][p] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for r in docs.collect():
        assert sum((parts[r.doc_id][p] for p in sorted(parts[r.doc_id])), []) == tokens.encode(r.text).tolist()
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.randint(1, 40)
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 60))), reverse=True)
        rows: list[int] = []
        for n in sizes:  # plain best fit
            fit = [x for x in rows if x >= n]
            if fit:
                rows[rows.index(min(fit))] -= n
            else:
                rows.append(cap - n)
        got = packing.best_fit_decreasing(sizes, cap)
        assert sorted(cap - sum(sizes[k] for k in r) for r in got) == sorted(rows)
    assert spark.range(1).select(packing.position_ids(F.array(F.lit(0), F.lit(2), F.lit(5)))).first()[0] == [0, 1, 0, 1, 2]
    assert packing.pack(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_transducer.load(path)
    rng = random.Random(2)
    bits = ["the", "ing", "  ", " ", "\n", "é", "0", "▁", "世界", "😀", "<s>", "<0x0A>", "er", " t", "qu", "ab" * 30]
    for _ in range(4000):
        x = "".join(rng.choices(bits, k=rng.randint(0, 20)))
        ids = own.encode(x)
        assert list(ids) == lib.encode(x)
        if "▁" not in x:
            assert own.decode(ids) == x
    for k in range(70):
        assert list(own.encode(" " * k + "x" + " " * k)) == lib.encode(" " * k + "x" + " " * k)
    docs = spark.createDataFrame([(1, "A text.\n", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, exact int")
    got = {r.doc_id: (r.n_pieces, r.exact) for r in sentencepiece_codec.encode_and_decode(docs, path).collect()}
    assert got == {1: (len(lib.encode("A text.\n")), True), 2: (0, True), 3: (0, True)}
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path).drop("text"), path)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "A text.\n", 2: "", 3: ""}


def test_kneser_ney_sums_to_one_and_tells_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    for ctx in model.contexts[4][[0, 1000, len(model.contexts[4]) - 1]]:
        last = np.array([0, *map(ord, model.alphabet), language_id._OTHER], np.uint64)
        context = np.full(len(last), ctx)
        grams = [(language_id.key_of(x, last, k), x) for k in range(1, 5) for x in [context & np.uint64((1 << 21 * (k - 1)) - 1)]]
        assert np.allclose(np.exp2(model.log_probs(grams).astype(float)).sum(axis=0), 1, atol=1e-3)
    assert all((k[1:] > k[:-1]).all() for k in model.keys[1:])
    out, names = language_id.predict(docs, model)
    right = out.filter(language_id.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col(names["lang_pred"])).cast("double"))).first()[0]
    assert right > 0.99
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "ж" * 300, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in language_id.predict(odd, model)[0].collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0, True) and got[4][2]
    assert language_id.identify(docs.limit(0))[0].count() == 0


def brute_kneser_ney(texts, alphabet):
    """log2 P(c | up to three characters before) by plain counting; texts are lists of names, 0 for gaps."""
    order = 4
    grams = [defaultdict(int) for _ in range(order + 1)]
    for t in texts:
        padded = [0] * (order - 1) + t
        for i in range(order - 1, len(padded)):
            grams[order][tuple(padded[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    discount = [0.0]
    for k in range(1, order + 1):
        n1, n2 = sum(v == 1 for v in grams[k].values()), sum(v == 2 for v in grams[k].values())
        discount.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(ctx, c):
        if ctx is None:
            return 1 / (len(alphabet) + 2)
        k = len(ctx) + 1
        low = p(ctx[1:] if ctx else None, c)
        own = {g: v for g, v in grams[k].items() if g[:-1] == ctx}
        total = sum(own.values())
        if not total:
            return low
        return max(own.get((*ctx, c), 0) - discount[k], 0) / total + discount[k] * len(own) / total * low

    return p


def test_kneser_ney_equals_plain_counting(spark):
    rng = random.Random(6)
    letters = {"aa": "abcdéж世界", "bb": "abxyz𐐨ß"}
    rows = [(i, "".join(rng.choices(letters[x] + " .", k=rng.randint(0, 60))), x) for i, x in enumerate(rng.choices(["aa", "bb"], k=80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)).alias("p")).collect()}
    table = language_id._table(model.alphabet)
    taught = {x: [language_id.codes_of([t], table)[0][3:].astype(int).tolist() for i, t, y in rows if y == x and part[i] > 0] for x in letters}
    assert sorted(model.alphabet) == sorted(set("".join(t.lower() for _, t, _ in rows)) - set(" ."))
    tried = ["abcd жé", "xyz世界ab", "qqq q", "a", "𐐀𐐨ß"]
    bits, n, _ = model.cross_entropies(tried, table)
    for j, lang in enumerate(model.languages):
        p = brute_kneser_ney(taught[lang], model.alphabet)
        for r, t in enumerate(tried):
            c = [0, 0, 0, *language_id.codes_of([t], table)[0][3:].astype(int).tolist()]
            want = -sum(np.log2(p(tuple(c[i - 3 : i]), c[i])) for i in range(3, len(c))) / (len(c) - 3)
            assert n[r] == len(c) - 3 and abs(bits[r, j] - want) < 1e-4
    long = "abcd " * 200_000
    odd = spark.createDataFrame([(1, long, "s"), (1, long, "s"), (None, "xyz xyz xyz", None)], "doc_id long, text string, score string")
    out, names = language_id.predict(odd, model)
    got = [(r["lang_pred"], round(r[names["score"]], 6)) for r in out.collect()]
    assert got[0] == got[1] and got[0][0] == "aa" and got[2][0] == "bb" and names["score"] == "_score"
