import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import url_filter as u


@pytest.mark.parametrize("listed_share", [0.0, 0.01, 0.5, 1.0])
def test_cascade_is_exact(listed_share):
    r = np.random.default_rng(3)
    h1, h2 = r.integers(0, 2**63, 20_000).astype(np.uint64), r.integers(0, 2**63, 20_000).astype(np.uint64)
    listed = r.random(20_000) < listed_share
    levels = u.build(h1, h2, listed)
    assert (u.member(levels, h1, h2) == listed).all()
    if listed_share == 0.01:
        assert len(levels) > 1 and sum(len(b) for _, b in levels) < 20_000 / 8


def test_same_hash_on_both_sides_is_an_error():
    h = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError):
        u.build(h, h, np.array([True, False]))


@pytest.mark.parametrize("shard_keys", [u.SHARD_KEYS, 40])
def test_lookup_equals_set_membership(spark, shard_keys):
    rows = spark.range(3000).select("id", F.concat(F.lit("host"), F.col("id") % 1500).alias("key")).union(spark.createDataFrame([(-1, None), (-2, "")], "id bigint, key string"))
    listed = rows.where("id % 7 = 0")
    marks = {r.key for r in listed.collect()}
    got = u.lookup(rows, u.cascade(rows, listed, shard_keys=shard_keys)).collect()
    assert len(got) == 3002
    assert all(r.listed == (r.key is not None and r.key in marks) for r in got)


def test_canonical_keys(spark):
    cases = {"HTTPS://WWW.Site.org/A/?q=1": "site.org/a", "http://m.site.org/a#x": "site.org/a", "site.org": "site.org", "": "", " ftp://x/ ": "x"}
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", u.canonical(F.col("url")).alias("key")).collect()
    assert {r.url: r.key for r in rows} == cases


def test_odd_rows(spark):
    schema = "key string, page_id bigint, PAGE_ID string, url string, listed string"
    pages = spark.createDataFrame([("k", 1, "c", "http://a/", "z"), ("k", None, "c", "a", "z"), ("k", 2, "c", None, None), ("k", 3, "c", "", "z"), ("k", 1, "c", "http://a/", "z"), ("k", 4, "c", "b" * 100_000, "z")], schema)
    got = sorted((r.page_id or 0, r.listed) for r in u.flagged(pages, pages.where(F.col("url") == "http://a/")).collect())
    assert got == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False)]
    empty = spark.createDataFrame([], schema)
    assert u.flagged(empty, empty).collect() == []
    assert {r.listed for r in u.flagged(pages, empty).collect()} == {False}


def test_one_key_with_very_many_rows(spark):
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"))
    listed = rows.where("key = 'hot' or key like 'k1%'")
    found = u.lookup(rows, u.cascade(rows, listed, shard_keys=500))
    assert found.where("listed <> (key = 'hot' or key like 'k1%')").count() == 0 and found.count() == 200_000
