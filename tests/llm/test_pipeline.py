"""run() against each stage's brute-force version, stage by stage."""

import numpy as np
import sentencepiece

import corpus_pipeline
from tests.llm.test_jaccard_join import brute
from tests.llm.test_text_operators import grouped, hits_of
from veilwright.llm import jaccard_join as J
from veilwright.llm import language_id
from veilwright.llm import wordhash as W
from veilwright.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out, names = language_id.identify(docs)
    rejected = {r["doc_id"] for r in out.filter(names["rejected"]).collect()}
    rows = [r for r in rows if r[0] not in rejected]
    assert len(rows) > 190
    stay = {k for k, _ in grouped(rows).values()}
    rows = [r for r in rows if r[0] in stay]
    component = brute(rows, 5, 80)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = hits_of(rows, items)
    rows = [(i, t) for i, t in rows if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])]
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_pieces, r.exact) for r in got} == {i: (len(lib.encode(t)), True) for i, t in rows}
    assert len(got) == len(rows)


def test_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [int(n.split()[0]) for n, _ in corpus_pipeline.STAGES] == [7, 2, 5, 1, 10]


def test_near_copies_between_the_thresholds_go(spark):
    # 86 / 106 of the 5-word shingles, but only 92 / 104 of the 3-word shingles.
    words = [f"w{k}" for k in range(100)]
    edited = list(words)
    edited[30], edited[70] = "x", "y"
    # 76 / 116: too far apart.
    other = [f"v{k}" for k in range(100)]
    apart = list(other)
    for k in (10, 30, 50, 70):
        apart[k] = f"z{k}"
    rows = [(1, words), (2, edited), (3, other), (4, apart)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == {1, 3, 4}
    # Unequal sets at the border of 80 % share a signature, whatever their size.
    for n in range(5, 3000, 7):
        gone = max(1, n // 9)
        one, two = (np.sort(W.mix(np.arange(k, n + k, dtype=np.uint64) + np.uint64(n))) for k in (0, gone))
        part = np.sort(W.mix(np.arange(-(-4 * n // 5), dtype=np.uint64) + np.uint64(n)))
        assert J.linked(one, part, 80)
        for x in (two, part):
            assert not J.linked(one, x, 80) or set(J.signatures(one, 80).tolist()) & set(J.signatures(x, 80).tolist()), n
