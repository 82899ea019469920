import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gapline.llm import warc
from gapline.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark, clash):
    body = "é" * 80
    rows = [(3, "http://WWW.Example.com:80/B?q=1#f", body), (1, "https://example.com/a", body), (2, None, None), (4, "x y\n", "short"), (5, "http://b.org", "short"), (None, "http://c.org/", body), (9, "http://b.org", "z" * 200_000), (9, "http://b.org", "z" * 200_000)]
    df = clash(spark.createDataFrame(rows, SCHEMA), ("payload", "digest", "archive", "url_key"))
    got = warc.captures(df, archive_bytes=300).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (by[page].payload_bytes, by[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert (by[1].record_type, by[3].record_type, by[3].refers_to, by[1].refers_to) == ("response", "revisit", 1, None)
    assert [by[p].record_type for p in (2, 4, 5, 9, None)] == ["response"] * 5
    assert by[3].url_key == "com,example)/b?q=1"
    assert [r.url_key for r in got] == sorted(r.url_key for r in got)  # one order over all partitions


def test_archive_bytes(spark):
    df = spark.createDataFrame([(1, "http://a.org/é", "<p>x</p>"), (2, "http://a.org/", "")], SCHEMA)
    archives = warc.write_archives(df).collect()
    kinds = [h["WARC-Type"] for a in archives for _, _, h, _ in warc.read_records(bytes(a.data))]
    assert kinds.count("warcinfo") == len(archives)
    assert kinds.count("response") == 2
    cut = bytes(archives[0].data)[:-5]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records(cut))


def test_empty(spark):
    assert warc.captures(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(runs):
    rng = random.Random(runs)
    lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(runs)]
    assert list(warc.LoserTree([iter(x) for x in lists], lambda x: x)) == sorted(x for y in lists for x in y)


def entries(n, seed, url=lambda r: f"com,h{r.randrange(9)})/{r.randrange(50)}"):
    r = random.Random(seed)
    rows = [(url(r), f"2020-01-{r.randrange(1, 28):02d}T00:00:00Z", r.choice([None, r.randrange(99)]), "u", f"a{seed}", i, 1, 1, "d", "response", None) for i in range(n)]
    return sorted(rows, key=warc.order)


@pytest.mark.parametrize("shuffled", [False, True])
def test_merge_of_slices(shuffled):
    """Slices of several archives, in pieces between each other, in order or not, give one order."""
    runs = [entries(n, k) for k, n in enumerate([0, 1, 70, 300, 129])]
    if shuffled:
        runs = [random.Random(1).sample(r, len(r)) for r in runs]
    pieces = [r[i : i + 37] for r in runs for i in range(0, len(r), 37)]
    pieces = [[*x, *y] for x, y in zip(pieces[::2], pieces[1::2], strict=False)] + pieces[len(pieces) // 2 * 2 :]
    got = [r for b in warc._merge(iter([warc._batch(x) for x in pieces] + [warc._batch([])])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == sorted((r for x in runs for r in x), key=warc.order)


def test_slices_arrive_in_order(spark, tiny):
    """No slice of the test tables has to be sorted before the merge, and ranges are as many as entries ask for."""
    runs = warc.cut(warc.capture_runs(warc.write_archives(spark.read.parquet(f"{tiny}/pages.parquet"), archive_bytes=20_000)))
    dealt = runs.repartitionByRange(3, "url_key", "captured", "page_id", "archive", "offset").withColumn("p", F.spark_partition_id()).collect()
    slices = {}
    for r in dealt:
        slices.setdefault((r.p, r.archive), []).append(tuple(r)[:-1])
    assert len(slices) > 3
    assert all(warc.in_order(warc._batch(x)) for x in slices.values())
    assert not warc.in_order(warc._batch(max(slices.values(), key=len)[::-1]))
    merged = warc.merge_runs(runs, entries=10)
    assert merged.rdd.getNumPartitions() > 3
    got = [tuple(r) for r in merged.collect()]
    assert got == sorted(got, key=warc.order)


def test_a_hot_url_is_cut(spark):
    rows = [(7, "http://hot.org/", "x")] * 300 + [(i, f"http://b.org/{i}", "y" * 200) for i in range(60)] + [(10**6, "http://b.org/" + "p" * 100_000, "z" * 2_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = warc.cut(warc.capture_runs(warc.write_archives(df, archive_bytes=4_000)))
    sizes = warc.merge_runs(runs, entries=30).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == len(rows)
    assert max(r["count"] for r in sizes) <= 90


def test_parity(spark, tiny):
    compare(connect(tiny), QUERIES["op2_warc_index_merge"](spark, tiny), ORACLE_SQL["op2_warc_index_merge"])
