from lodestrata.llm import url_filter
from lodestrata.llm.queries import RULES


def judged(spark, urls, listed, **limits):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    return {r["page_id"]: r for r in url_filter.filter_urls(pages, spark.createDataFrame([(x,) for x in listed], "url string"), RULES, **limits).collect()}


def test_rules_and_list(spark):
    urls = [None, "", "no scheme", "http://A.Net/x", "http://example.NET/en/1", "http://notexample.net/en/1", "http://b.example.com/de/?q", "http://x.org/fr/#a", "http://x.net", "http://www.bad.com:80/p/index.html?x", "http://bad.com/q", "http://m.site.com/any", "http://xsite.com/any", "a://b://c/d\ne?f"]
    got = judged(spark, urls, ["bad.com/p", "site.com/", None, "site.com/"])
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [(None, "allow")] * 3 + [("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow")]
    assert (got[0]["host"], got[0]["path"]) == ("", "") and (got[3]["host"], got[3]["path"]) == ("a.net", "/x") and (got[13]["host"], got[13]["path"]) == ("b:", "//c/d\ne")


def test_empty_list_and_table(spark):
    assert judged(spark, ["http://a.com/"], [])[0]["verdict"] == "allow"
    assert judged(spark, [], ["a.com/"]) == {}


def test_full_filter_still_exact(spark, monkeypatch):
    listed = [f"host{i}.com/" for i in range(3000)]
    urls = [f"http://host{i}.com/x" for i in range(0, 6000, 7)]
    want = {i: "block" if int(u[11:-6]) < 3000 else "allow" for i, u in enumerate(urls)}
    for size, broadcast in ((64, 16 << 20), (16 << 20, 0)):  # an overfull filter; a shuffled exact join
        monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", size)
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_BYTES", broadcast)
        assert {i: r["verdict"] for i, r in judged(spark, urls, listed).items()} == want


def test_filter_of_many_blocks_is_built_in_linear_time(spark):
    """As many keys as fill tens of thousands of blocks; bits are found again at every block."""
    import time

    from pyspark.sql import functions as F

    keys, blocks = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("key")), 1_000_000 // url_filter.KEYS_A_BLOCK
    began = time.perf_counter()
    words = url_filter.bloom_filter(keys, blocks).first()["words"]
    assert len(words) == 4 * blocks and time.perf_counter() - began < 60
    few = spark.range(0, 1_000_000, 9973).select(F.concat(F.lit("k"), "id").alias("key"))
    assert few.where(~url_filter.may_hold(url_filter.bloom_filter(keys, blocks).scalar(), F.col("key"), blocks)).count() == 0


def test_the_end_is_the_end(spark):
    """A newline after a slash or a port is part of the path or host."""
    got = judged(spark, ["http://bad.com/p/\n", "http://bad.com/p/", "http://bad.com:80\n/p"], ["bad.com/p"])
    assert [got[i]["verdict"] for i in range(3)] == ["allow", "block", "allow"]


def test_filter_has_no_false_negatives_and_few_positives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = 5000 // url_filter.KEYS_A_BLOCK
    words = url_filter.bloom_filter(keys, blocks).scalar()
    probe = spark.range(20000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    hits = {r["id"] for r in probe.where(url_filter.may_hold(words, F.col("key"), blocks)).collect()}
    assert set(range(5000)) <= hits and len(hits) < 5000 + 15000 * 0.12


def test_only_possible_hits_meet_the_list_and_the_filter_is_built_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    pages = spark.range(20000).select(F.concat(F.lit("http://host"), "id", F.lit(".com/x")).alias("url"), F.lit(1).alias("url_entry"), F.lit(2).alias("page"), F.lit(3).alias("rule_verdict"))
    listed = spark.range(2000).select(F.concat(F.lit("host"), "id", F.lit(".com/")).alias("url"))
    decided, asked = url_filter.parted(pages, listed.select(F.col("url").alias("key")), RULES)
    assert 2000 <= asked.count() < 2000 + 18000 * 0.25 and decided.count() + asked.count() == 20000
    builds, real = [], url_filter.bloom_filter
    monkeypatch.setattr(url_filter, "bloom_filter", lambda *a: builds.append(1) or real(*a))
    out = url_filter.filter_urls(pages, listed, RULES)
    assert out.where("verdict = 'allow'").count() == 18000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert builds == [1] and "bit_or" not in plan  # it is read from the stored table
    assert out.where("verdict = 'block'").count() == 2000 and out.select("url_entry", "page", "rule_verdict").distinct().collect() == [(1, 2, 3)]
