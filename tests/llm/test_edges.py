"""Odd rows in every operator and stage, and the registered queries against the libraries and a plain parser."""

import hashlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilwright.llm import html_text, queries, sentencepiece_codec, warc

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Text of the article by the standard parser: no adverts, scripts or styles, a line a block."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "div", "article", "section", "blockquote", "table", "tr", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.lines = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in self.BLOCKS:
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "
        if tag in ("script", "style") or (tag == "div" and (dict(attrs).get("class") or "") == "ad"):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag in self.BLOCKS:
            self.lines.append("")
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.lines[-1] += data


def plain_text(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in parser.lines) if x)


def test_pages_equal_a_plain_parser(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert all(html_text.main_text(x) == plain_text(x) for x in pages.values())
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op4_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (t, len(t)) for i, x in pages.items() for t in [plain_text(x)]}


def test_token_queries_equal_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, SF).collect()} == {i: (len(texts[i].encode()), len(x), len(x) > 512) for i, x in ids.items()}
    parts: dict[int, dict[int, list[int]]] = {}
    for r in queries.op9_token_packing(spark, SF).collect():
        row = np.frombuffer(r.input_ids, np.uint16)
        for k, (d, p) in enumerate(zip(r.doc_ids, r.parts, strict=True)):
            parts.setdefault(d, {})[p] = row[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    assert {d: sum((x[p] for p in sorted(x)), []) for d, x in parts.items()} == {i: x for i, x in ids.items() if x}
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: (len(x), hashlib.sha256(np.array(x, np.int32).tobytes()).hexdigest(), True) for i, t in texts.items() for x in [piece.encode(t)]}
    assert {r.doc_id: (r.n_pieces, r.ids_sha256, r.exact) for r in queries.op10_sentencepiece(spark, SF).collect()} == want


def test_pieces_of_odd_rows(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    long = ["a" * 300_000, "世界" * 50_000, " " * 100_000, "abcdefgh" * 20_000]
    rows = [(1, "same text", "x"), (1, "same text", "x"), (None, None, None), (2, "", ""), *((10 + k, t, "l") for k, t in enumerate(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string")
    out = sentencepiece_codec.encode_and_decode(docs, path)
    got = sorted(((r.doc_id or 0, r.n_pieces, r.exact) for r in out.collect()))
    assert got == sorted((i or 0, len(lib.encode(t or "")), True) for i, t, _ in rows)
    empty = sentencepiece_codec.encode_and_decode(docs.limit(0), path)
    assert empty.count() == 0 and empty.columns == out.columns


def test_archives_of_odd_pages(spark):
    long = "<p>é</p>" * 400_000
    rows = [(1, "http://a.example.com/", long, "x", 5), (2, "http://a.example.com/", long, None, None), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, n int")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_index(pages, archive_bytes=1_000_000).collect()}
    n = len(long.encode())
    assert got == {1: (n, "revisit", 2), 2: (n, "response", None), None: (0, "response", None)}


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    """Nulls in any column, empty and very long texts, repeated rows, names that the operators use themselves; then no rows at all."""
    english = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars > 500").limit(3).collect()]
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, english[0]), (2, english[0]), (2, english[0]), (3, english[1]), (None, english[2]), (None, None), (4, ""), (5, None), (6, long)]
    named = "lang string, source string, n_chars long, c long, label string, hits string, score string, sha string, sig long, kind long, rep string"
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, 1, None, "h", None, None, 7, 8, "r") for i, t in rows], f"doc_id long, text string, {named}")
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs, SF)
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect())
    if k < 4:
        assert got.columns == docs.columns
    # Language: no letters, no language. Exact and near: one of equal texts, in near also all without words. The others keep all.
    expected = {1: [-1, 1, 3, 4, 6], 2: [-1, -1, 1, 3, 4, 5, 6], 3: [-1, -1, 1, 2, 2, 3, 4, 5, 6], 4: [-1, -1, 1, 2, 2, 3, 4, 5, 6]}
    assert kept == expected[k] if k else set(kept) <= {-1, 1, 2, 3, 6} and kept.count(2) == 2 and kept.count(-1) == 1
    assert stage(spark, docs.filter(F.lit(False)), SF).count() == 0
