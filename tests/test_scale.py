"""Plans and paths that must hold at any size: small sides are broadcast, nothing is cut by depth, entries stand alone."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import orderflow as O, splits as S, stats as ST
from tidemark.session import settle
from tidemark.sources import payloads as P

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def small_broadcasts(spark):
    """Tables of a few rows may be broadcast, the given ones may not."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "20000")
    yield
    spark.conf.set(key, old)


def wide(spark, n=40000):
    # more bytes than the threshold, a third of the rows on one key
    d = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("symbol"),
        (F.col("id") * 1_000_000 * 60).alias("t"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"),
    )
    return settle(d)


@pytest.mark.parametrize("name", ["holdout", "last_days", "ols_hac", "residualise", "ofi_bars"])
def test_rows_are_not_shuffled_for_a_value_per_symbol(spark, small_broadcasts, name):
    d = wide(spark)
    make = {
        "holdout": lambda: S.holdout(d, 5),
        "last_days": lambda: S.last_days(d, 5),
        "ols_hac": lambda: ST.ols_hac(d, ["symbol"], "t", "x", "y", 3, 1_000_000 * 60 * 1024),
        "residualise": lambda: ST.residualise(d, ["symbol"], "y", "x", "r"),
        "ofi_bars": lambda: O.ofi_bars(d.select("symbol", "t", F.col("x").alias("qty"), (F.col("y") > 0.5).alias("is_buyer_maker"))),
    }[name]
    df = make()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin [symbol" not in final and "BroadcastHashJoin" in final


def test_sitemaps_are_walked_to_the_end(spark):
    index = lambda u: f"<sitemapindex><sitemap><loc>{u}</loc></sitemap></sitemapindex>"
    rows = [(f"u{i}", index(f"u{i + 1}")) for i in range(7)] + [("u7", "<urlset><url><loc>leaf</loc></url></urlset>"), ("loop", index("loop"))]
    payloads = spark.createDataFrame(rows, "url string, payload string")
    got = P.walk_sitemaps(payloads, spark.createDataFrame([("u0",), ("loop",)], "url string"))
    assert [r.url for r in got.collect()] == ["leaf"]


def test_phrases_are_taken_literally(spark):
    d = spark.createDataFrame([("node.js rocks",), ("nodexjs rocks",), ("c++ (fast)",)], "s string")
    got = [r.t for r in d.select(X.tags(F.col("s"), {"js": ["node.js"], "bad": ["(fast"]}).alias("t")).collect()]
    assert got[0] == ["js"] and got[1] == []


def test_entries_without_the_text_operators():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name in ('corpus_pipeline', 'tidemark.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q, o = e.queries(), e.oracle_sql()\n"
        "assert len(q) > 140 and set(o) <= set(q) and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
