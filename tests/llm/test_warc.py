import random

from veilwright.llm import warc


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        got = list(warc.LoserTree([iter(r) for r in runs], lambda x: x))
        assert got == sorted(x for r in runs for x in r)


def test_round_trip(spark):
    long = "<p>é&amp;😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 40
    rows = [(1, "http://www.B.example.com/a?x=1#f", long), (2, "http://a.example.com/", long), (3, None, None), (4, "x\ny z", "short"), (5, "http://a.example.com/", "short"), (5, "http://a.example.com/", "short"), (None, "http://[bad", long), (9, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_and_index(pages, archive_bytes=3000).collect()
    by = {(r.page_id, r.payload_bytes): r for r in got}
    n = len(long.encode())
    assert len(got) == len(rows)
    assert by[2, n].record_type == "response" and by[1, n].record_type == by[None, n].record_type == "revisit"
    assert by[1, n].refers_to == by[None, n].refers_to == 2 and by[2, n].refers_to is None
    assert by[1, n].payload_digest == by[2, n].payload_digest
    assert by[3, 0].payload_digest == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert [r.record_type for r in got if r.page_id in (4, 5)] == ["response"] * 3
    assert by[1, n].url_key == "com,example,b)/a?x=1"
    keys = [(r.url_key, r.captured_at) for r in got]
    assert keys == sorted(keys)


def test_global_order_over_ranges(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example.com/{k % 3}", "x" * (k % 40)) for k in range(500)], "page_id long, url string, html string")
    path = warc.shared_path(spark, "archives")
    warc.write_archives(pages, path, archive_bytes=20_000, compression="gzip")
    got = warc.merged_index(warc.runs(spark, path), range_rows=60).collect()
    keys = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert len(keys) == 500 and keys == sorted(keys)
    assert len({r.archive for r in got}) > 5


def test_empty_table(spark):
    assert warc.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
