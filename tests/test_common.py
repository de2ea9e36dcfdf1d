import pytest
from pyspark.sql import functions as F

from courtside.functions import common as c
from courtside.functions import text as x
from courtside.functions.times import clock, seconds_of, slot_times
from courtside.operators import filters as f


def test_pages_partition_the_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.col("id"))
    seen = []
    for page in range(1, 5):
        seen += [tuple(r) for r in c.page_by(df, "k", [F.col("id").desc()], page, 700).collect()]
    assert len(seen) == len(set(seen))
    per_key = {}
    for k, _ in [tuple(r) for r in df.collect()]:
        per_key[k] = per_key.get(k, 0) + 1
    assert len(seen) == sum(min(n, 2800) for n in per_key.values())


def test_deep_page_of_a_hot_key_is_exact(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id"))
    got = [r.id for r in c.page_by(df.filter("k = 0"), "k", [F.col("id")], 101, 20).orderBy("id").collect()]
    assert got == [r.id for r in df.filter("k = 0").orderBy("id").collect()][2000:2020]


def test_page_pruning_reaches_below_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = c.page_by(df, "k", [F.col("id")], 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_lists_are_sorted_distinct_and_empty_when_none(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, v STRING")
    kids = spark.createDataFrame([(1, "z"), (1, "y"), (1, "z")], "id INT, img STRING")
    got = {r.id: (r.v, r.imgs) for r in c.attach_list(rows, kids, "id", "id", "img", "imgs").collect()}
    assert got == {1: ("a", ["y", "z"]), 2: ("b", [])}


def test_salted_join_equals_join(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z")], "k BIGINT, v STRING")
    assert sorted(map(tuple, c.salted_join(big, small, "k", ["id"]).collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_unset_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("0",), ("0.0",), ("x",), ("7",)], "v STRING")
    assert [r.u for r in df.select(c.is_unset("v").alias("u")).collect()] == [True, True, True, True, False, False]


def test_requests_by_scalar_list_or_frame(spark):
    df = spark.range(10).withColumnRenamed("id", "user_id")
    assert c.for_keys(df, 3, "user_id").count() == 1
    assert c.for_keys(df, [3, 4], "user_id").count() == 2
    assert c.for_keys(df, df.filter("user_id > 7"), "user_id").count() == 2
    assert c.for_keys(df, None, "user_id").count() == 10


def test_slots_keep_the_minutes_of_the_common_end(spark):
    df = spark.createDataFrame([("08:30:00", "14:00:00", 0), ("09:00:00", "14:15:00", 3)], "s STRING, e STRING, n INT")
    a, b = slot_times(F.col("s"), F.col("e"), F.col("n"))
    assert [tuple(r) for r in df.select(clock(a), clock(b)).collect()] == [("08:30:00", "09:00:00"), ("12:00:00", "13:15:00")]
    assert df.select(seconds_of(F.col("s"))).first()[0] == 30600


def test_needle_wildcards_are_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("acb",)], "n STRING")
    assert [r.n for r in f.name_contains(df, ["n"], "0%").collect()] == ["50% off"]
    assert [r.n for r in f.name_contains(df, ["n"], "A_").collect()] == ["a_b"]


def test_status_and_phase_differ_at_the_end(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS start_time, TIMESTAMP_NTZ '2024-01-01 11:00:00' AS end_time")
    now = "2024-01-01 11:00:00"
    assert df.select(f.session_status(now)).first()[0] == "ongoing"
    assert f.session_phase(df, "ongoing", now).count() == 0 and f.session_phase(df, "completed", now).count() == 1
    none = spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS start_time, CAST(NULL AS TIMESTAMP_NTZ) AS end_time")
    assert none.select(f.session_status(now)).first()[0] == "completed"


def test_on_date_is_a_range(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT TIMESTAMP_NTZ '2024-01-05 23:59:59' AS t UNION ALL SELECT TIMESTAMP_NTZ '2024-01-06 00:00:00'").write.parquet(path)
    df = f.on_date(spark.read.parquet(path), "t", "2024-01-05")
    assert df.count() == 1
    assert "GreaterThanOrEqual(t" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("html,clean", [
    ("<b>x</b><script>alert(1)</script>y", "<b>x</b>y"),
    ("<div><p>one<div>two</div></div>", "<p>one</p>two"),
    ('<a href="javascript:x()" onclick="y" target="_blank">t</a>', '<a target="_blank">t</a>'),
    ('<a href="/p?a=1&b=2">t</a>', '<a href="/p?a=1&amp;b=2">t</a>'),
    ("<i>open <b>both", "<i>open <b>both</b></i>"),
    ("a<br>b &lt;c&gt; & d", "a<br />b &lt;c&gt; &amp; d"),
    ("<!-- no --><style>p{}</style><em>k</em>", "<em>k</em>"),
    ("x</p>y", "x<p></p>y"),
    ("plain", "plain"),
])
def test_html_cleaning(html, clean):
    assert x.clean_html_text(html) == clean


def test_html_cleaning_is_linear_and_equals_a_plain_stack():
    import random
    import time

    class Plain(x._Cleaner):
        """Looks through the whole stack each time."""

        def handle_endtag(self, tag):
            if tag in self.open:
                while self.open and self.open[-1] != tag:
                    self._close_top()
                self._close_top()
            elif tag == "p":
                self.out.append("<p></p>")
            elif tag == "br":
                self.out.append("<br />")

        def handle_data(self, data):
            if not any(t in x.TEXTLESS_TAGS for t in self.open):
                self.out.append(x.escape(data, quote=False))

    r = random.Random(5)
    for _ in range(300):
        html = "".join(r.choice(["<p>", "</p>", "<b>", "</b>", "<li>", "</li>", "<script>", "</script>", "<br>", "</br>", "<ul>", "</ul>", "t & u", "<a href='x'>", "</a>"]) for _ in range(40))
        twin = Plain()
        twin.feed(html)
        twin.close()
        while twin.open:
            twin._close_top()
        assert x.clean_html_text(html) == "".join(twin.out)
    start = time.time()
    assert x.clean_html_text("<li>a</b>" * 200_000) == "a" * 200_000
    assert time.time() - start < 10


def test_html_column_keeps_nulls_and_whole_texts(spark):
    long = "<b>" + "word " * 50000 + "</b>"
    df = spark.createDataFrame([(None,), (long,)], "h STRING").select(x.clean_html("h").alias("h"))
    assert [r.h for r in df.collect()] == [None, long]


def test_data_url(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGVsbG8=",), ("nope",)], "u STRING")
    mime, body = x.data_url(F.col("u"))
    assert [tuple(r) for r in df.select(mime, body.cast("string")).collect()] == [("image/png", "hello"), (None, None)]
