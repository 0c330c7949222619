"""Series over ranges, and keyed tables of sorted runs."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.operators import series
from tierflow.sources.keyed import FANOUT, KeyedTable


def series_rows(seed, n, values):
    rnd = random.Random(seed)
    return [(i, rnd.choice([None, 3, *values]), rnd.choice([None, rnd.randint(-9, 9)]), rnd.choice([None, rnd.random()])) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 4, 30])
@pytest.mark.parametrize("rows", [series_rows(1, 200, range(40)), series_rows(2, 150, [3]), [(1, 2, None, None)], []], ids=["random", "ties", "one", "none"])
def test_series_equals_plain_windows(spark, rows, ranges):
    """Nulls, and values shared by many rows, over ranges smaller than the frames."""
    df = spark.createDataFrame(rows, "id int, x int, v long, d double").repartition(3)
    got = series.over_series(
        df, "x", ["id"], {"a": ("v", 1), "b": ("d", 3), "c": ("v", -1), "e": ("id", -4)}, {"r": "v", "s": "id"}, {"m": ("v", 3), "k": ("d", 7)}, ranges=ranges
    )
    w = Window.orderBy(F.col("x").asc_nulls_first(), "id")
    same = Window.orderBy(F.col("x").asc_nulls_first())
    want = df.select(
        "*",
        F.lag("v", 1).over(w).alias("a"),
        F.lag("d", 3).over(w).alias("b"),
        F.lead("v", 1).over(w).alias("c"),
        F.lead("id", 4).over(w).alias("e"),
        F.sum("v").over(same).alias("r"),
        F.sum("id").over(same).alias("s"),
        F.avg("v").over(w.rowsBetween(-2, 0)).alias("m"),
        F.avg("d").over(w.rowsBetween(-6, 0)).alias("k"),
    )
    a, b = ({r.id: r for r in x.collect()} for x in (got.select(*want.columns), want))
    assert a.keys() == b.keys()
    for i in a:
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y) for x, y in zip(a[i], b[i], strict=True)), (a[i], b[i])


def test_series_is_not_one_task(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    plan = series.over_series(df, "id", lags={"a": ("v", 1)}, running={"r": "v"}, ranges=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [lag(v" in plan and "[id#" not in [x for x in plan.splitlines() if "Window [lag(v" in x][0].split("windowspecdefinition(")[1][:8]
    assert all("windowspecdefinition(__part#" in x for x in plan.splitlines() if "lag(v#" in x or "sum(CASE WHEN NOT __halo" in x)


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("at", T.LongType())])


def test_keyed_table(spark, tmp_path):
    """Newest rows over many epochs, one of them repeated; another session goes on; few bytes are rewritten; reads do not shuffle."""
    path = f"file://{tmp_path}/t"
    table = KeyedTable(spark, path, "k", SCHEMA, 4, ["at"])
    assert table.runs() == [] and table.read().count() == 0
    rnd, want, rewritten, own = random.Random(3), {}, 0, 0
    for epoch in range(18):
        rows = [(f"k{rnd.randrange(80)}", epoch * 1000 + i, rnd.randrange(10**6)) for i in range(60)] + [(None, 1, 1)]
        df = spark.createDataFrame(rows, SCHEMA)
        rewritten += table.upsert(df, epoch)
        own += max((r["bytes"] for r in table.runs() if r["tier"] == 0), default=0)
        if epoch in (2, 7, 11):
            assert table.upsert(df, epoch) == 0
        if epoch == 9:
            spark.sql(f"DROP TABLE {table.name}")
            table = KeyedTable(spark, path, "k", SCHEMA, 4, ["at"])
        for k, v, at in rows:
            if k is not None and (k not in want or (at, epoch, v) >= (want[k][1], want[k][2], want[k][0])):
                want[k] = (v, at, epoch)
    assert {r.k: (r.v, r.at) for r in table.read().collect()} == {k: w[:2] for k, w in want.items()}
    assert all(sum(r["tier"] == t for r in table.runs()) < FANOUT for t in range(4))
    assert rewritten < own * 1.5 * math.log(18, FANOUT)
    assert "Exchange" not in table.read()._jdf.queryExecution().executedPlan().toString()
    one = table.lookup("k5")
    assert [tuple(r) for r in one.collect()] == [("k5", *want["k5"][:2])]
    assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString()
    stored = {p.name for p in (tmp_path / "t" / "runs").iterdir() if p.name.startswith("run=")}
    assert len(stored) <= 2 * len(table.runs()) + FANOUT


def test_keyed_totals(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    table = KeyedTable(spark, f"file://{tmp_path}/n", "k", schema, 3, merge={"n": "sum"})
    for epoch in range(9):
        table.upsert(spark.createDataFrame([("a", 1), (f"b{epoch % 2}", 2)], schema), epoch)
    assert {r.k: r.n for r in table.read().collect()} == {"a": 9, "b0": 10, "b1": 8}
