import pytest
from pyspark.sql import functions as F

from mailsieve.functions import urls as U
from mailsieve.operators import joins
from mailsieve.operators import urls as ops


EXTRACTED = [
    ("www.z.co.", ["http://www.z.co"]),
    ("http://latest.com/a", []),
    ("https://nodot/", []),
    ("(see http://a.b/c).,", ["http://a.b/c"]),
    ("HTTP://A.B/x WWW.Q.R!", ["HTTP://A.B/x", "http://WWW.Q.R"]),
    ("http://a.b http://a.b", ["http://a.b", "http://a.b"]),
    ("http://LOCALHOST.x/", []),
    ("nothing", []),
    (None, []),
]


def test_extract_urls(spark):
    rows = spark.createDataFrame(EXTRACTED, "text string, want array<string>")
    got = rows.select(U.extract_urls("text").alias("urls"), U.filtered_url_count("text").alias("n")).collect()
    assert [r.urls for r in got] == [w for _, w in EXTRACTED]
    assert [r.n for r in got] == [0, 1, 1, 0, 0, 0, 1, 0, 0]


FEATURES = [
    ("HTTP://A.B", (0, 0, 0, 0, 0, 0)),
    ("http://a.b/c#frag", (12, 1, 0, 0, 0, 0)),
    ("x http://999.1.1.1/", (17, 3, 1, 0, 0, 0)),
    ("https://my-Bank@x.y/Login", (25, 1, 0, 2, 1, 1)),
    (None, (0, 0, 0, 0, 0, 0)),
]


def test_url_features(spark):
    rows = spark.createDataFrame([(t,) for t, _ in FEATURES], "text string")
    got = [tuple(r.f) for r in rows.select(U.url_features("text").alias("f")).collect()]
    assert got == [w for _, w in FEATURES]


def test_lookup_key(spark):
    urls = ["http://a.b/?q=~~~>>>???", "http://x.y/" + "long" * 60, "é"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    want = ["aHR0cDovL2EuYi8_cT1-fn4-Pj4_Pz8", "aHR0cDovL3gueS9s" + "b25nbG9uZ2xvbmds" * 19 + "b25nbG9uZ2xvbmc", "w6k"]
    assert [r[0] for r in rows.select(U.url_lookup_key("url")).collect()] == want


def test_listing_counts_from_one_and_cuts_display(spark):
    long = "http://a.b/" + "x" * 60
    df = spark.createDataFrame([(1, f"http://c.d {long}")], "doc_id bigint, text string")
    rows = [tuple(r) for r in ops.url_listing(df).orderBy("position").collect()]
    assert rows == [(1, 1, "http://c.d", "http://c.d"), (1, 2, long, long[:50] + "...")]


def test_verdicts(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    rep = spark.createDataFrame(
        [("a", 1, 5, 0, 0), ("b", 0, 2, 1, 0), ("c", 0, 0, 3, 4)],
        "url string, malicious int, suspicious int, harmless int, undetected int",
    )
    got = {r.url: (r.verdict, r.total_engines, r.report_pending) for r in ops.reputation_join(urls, rep).collect()}
    assert got == {
        "a": ("MALICIOUS", 6, 0),
        "b": ("SUSPICIOUS", 3, 0),
        "c": ("SAFE", 7, 0),
        "d": (None, 0, 1),
    }


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skewed_lookup_equals_plain_join(spark, how):
    """A third of the rows share one key and some keys are null."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))
    )
    left = spark.range(30_000).select("id", key.alias("url"))
    right = left.where("url is not null and (url = 'hot' or length(url) < 5)").select("url").distinct()
    right = right.withColumn("v", F.length("url"))
    assert joins.hot_keys(left, "url").collect()[0].url == "hot"
    got = joins.skew_lookup(left, right, "url", how)
    want = left.join(right, "url", how)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(
        map(str, want.select(sorted(want.columns)).collect())
    )


def test_lookup_beyond_the_broadcast_bound(spark):
    left = spark.range(1000).select(F.col("id").cast("string").alias("term"))
    right = left.where("term < '5'").withColumn("x", F.lit(1))
    big = joins.bounded_lookup(left, right, "term", joins.BROADCAST_ROWS + 1)
    small = joins.bounded_lookup(left, right, "term", 1000)
    assert big.count() == small.count() == right.count()


def test_blocklist(spark):
    urls = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    listed = spark.createDataFrame([("a",), ("a",)], "url string")
    assert ops.blocklist_hits(urls, listed).count() == 2
    assert ops.blocklist_misses(urls, listed).count() == 1
    assert sorted(r.blocked for r in ops.blocklist_lookup(urls, listed).collect()) == [0, 1, 1]
