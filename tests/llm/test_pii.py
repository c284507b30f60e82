import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from veilwright.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base(text):
    out = []
    for k, (name, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            m, d = m, re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[name]
            if ok():
                out.append((m.start(), k, m.end(), name, m[0]))
    return sorted(out)


def brute(rows):
    """Base and disclosing spans by plain loops."""
    found = {}
    near, words_of, held = [], {}, defaultdict(set)
    for i, t in rows:
        t = t or ""
        b = base(t)
        words_of[i] = set(re.findall(r"[^\W_]+", t.lower()))
        for s, k, e, _, m in b:
            value = m.lower() if k == 0 else m if k == 1 else re.sub("[^0-9]", "", m)
            for x, y in ((0, s), (e, len(t))):
                for w in re.finditer(r"[^\W_]+", t[x:y]):
                    p, q = w.start() + x, w.end() + x
                    if not any(bs < q and p < be for bs, _, be, _, _ in b):
                        near.append((i, (k, value), w[0].lower(), p, q))
            held[k, value].add(i)
        found[i] = [x[:3] for x in b]
    # A part of a word, left beside a span, is a term for this span only, and none if it is a word of the document as well.
    whole = defaultdict(set)
    for i, t in rows:
        for w in re.finditer(r"[^\W_]+", t or ""):
            if not any(bs < w.end() and w.start() < be for bs, _, be in found[i]):
                whole[i].add((w.start(), w.end()))
    names = {i: {(t or "")[p:q].lower() for p, q in whole[i]} for i, t in rows}
    near = [x for x in near if x[3:] in whole[x[0]] or x[2] not in names[x[0]]]
    n = len(rows)
    dct = defaultdict(set)
    for i, c, w, _, _ in near:
        dct[c, w].add(i)
    told = set()
    for (c, w), d in dct.items():
        nt = sum(w in x for x in words_of.values())
        nct, nc = len(d), len(held[c])
        if math.log2(nct * n / (nc * nt)) >= -math.log2(nc / n) / pii.ALPHA - 1e-9:
            told.add((c, w))
    for i, c, w, p, q in near:
        if (c, w) in told:
            found[i].append((p, 4, q))
    return {i: sorted(set(x)) for i, x in found.items()}


TEXTS = [
    "Mail anna.berg@mail.example.com now, a.b@c.d_e@f.gh, x@y, @a.b, q@-.-.- and 1.2.3.4.5 or 300.1.1.1",
    "Card 4703443633947811 and 4703 4436 3394 7811, 4703-4436-3394-7812; 12345678901234567890123 +1 (473) 555-2164",
    "+4a +49 30 1234567 +1   +1 2 (3) 4567890123456789",
    "é😀 ünïcode émile@example.org 10.0.0.255 10.0.0.256 001.002.003.004 4222222222222",
    "",
    None,
    "9" * 5000 + " " + "a" * 5000 + "@" + "b" * 100,
    "1-2-3-4 " * 700,
]


def corpus():
    rng = random.Random(3)
    rows = list(enumerate(TEXTS))
    names = ["Quirin", "Zelda", "Ottokar"]
    for i in range(len(TEXTS), 160):
        words = rng.choices([f"common{k}" for k in range(30)], k=30)
        if i % 5 == 0:
            k = rng.randrange(3)
            words.insert(rng.randrange(len(words)), f"{names[k]} wrote from {names[k].lower()}@host{k}.example.net")
        rows.append((i, " ".join(words)))
    return rows


def test_spans_equal_brute_force(spark):
    rows = corpus()
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        spans = sorted([(x["start"], x["k"], x["end"]) for x in r.base] + [(x["start"], x["k"], x["end"]) for x in r.terms])
        assert spans == want[r.doc_id], r.doc_id
    assert any(x[1] == 4 for s in want.values() for x in s)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    for r in queries.op8_pii(spark, sf).collect():
        spans = want[r.doc_id]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.spans == text
        own = [x for x in spans if x[1] < 4]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in own) for k in range(4)]


def test_sanitised_texts_keep_all_else(spark):
    # Words that other documents have as well tell nothing; Ottokar stands beside the address alone.
    common = [(100 + k, "write to or other text", "c") for k in range(4)]
    rows = [(1, "Write to a@b.cd or +49 30 1234567!", "x"), (1, "other text", "y"), (2, None, "z"), (None, "a@b.cd", "n"), (3, "Ottokar, write to o@b.cd or Ottokar", "o"), *common]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {(r.doc_id, r.base): r.text for r in pii.sanitise(docs).collect()}
    want = {(1, "x"): "Write to [EMAIL] or [PHONE]!", (1, "y"): "other text", (2, "z"): None, (None, "n"): "[EMAIL]", (3, "o"): "[TERM], write to [EMAIL] or [TERM]"}
    assert got == want | {(i, b): t for i, t, b in common}
    assert pii.find(docs.filter(F.lit(False))).count() == 0


def test_very_many_spans_in_one_text(spark):
    n = 100_000
    text = " ".join(f"user{k}@host.example.net on" for k in range(n))
    rows = [(1, text, "a"), (1, text, "a"), (2, "7" * 200_000, "b"), (3, "+1(" * 50_000, "c"), (4, "é@" * 50_000, "d"), (None, "on", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = pii.find(docs).select("doc_id", F.size("base").alias("n"), F.size("terms").alias("t"), F.try_element_at("base", F.lit(-1))["end"].alias("end")).collect()
    assert sorted(((r.doc_id, r.n, r.t, r.end) for r in got), key=str) == sorted([(1, n, 0, len(text) - 3), (1, n, 0, len(text) - 3), (2, 0, 0, None), (3, 0, 0, None), (4, 0, 0, None), (None, 0, 0, None)], key=str)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == " ".join(["[EMAIL] on"] * n) and clean[2] == "7" * 200_000


def test_disclosing_words_anywhere_in_the_documents_of_a_value(spark):
    rows = [(i, " ".join(f"common{(i + k) % 7}" for k in range(5))) for i in range(40)]
    text = "Quirin common1 " + "common2 " * 40 + "quirin@host.example.net " + "common3 " * 40 + "Quirin"
    got = {r.doc_id: [(x["start"], x["end"]) for x in r.terms] for r in pii.find(spark.createDataFrame([*rows, (40, text)], "doc_id long, text string")).collect()}
    assert got[40] == [(0, 6), (len(text) - 6, len(text))]
    assert not any(got[i] for i in range(40))
