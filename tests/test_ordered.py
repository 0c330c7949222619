"""Lookups and pages of stored, ordered tables, and the files that they open."""

import random

import pytest
from pyspark.sql import functions as F

from tierflow.sources.ordered import OrderedTable


def table_rows(n):
    rnd = random.Random(5)
    return [(i, rnd.choice([None, rnd.randint(0, 60)]), f"name {i % 7}") for i in range(n)]


def scanned(df):
    """Files and rows that a query's scan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    metrics = plan.collectLeaves().toList().head().metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(table_rows(4000), "id long, x int, name string").repartition(5)
    path = f"file://{tmp_path_factory.mktemp('ordered')}/a b=c"
    return OrderedTable(spark, path).store(df, [("id", "asc")], files=100)


def test_a_lookup_in_100_files_reads_two_at_most(stored):
    assert 90 <= stored._index().count() <= 100
    for key in (0, 1777, "3999"):
        found = stored.lookup("id", key)
        files, rows = scanned(found)
        assert [r.id for r in found.collect()] == [int(key)]
        assert files <= 2 and rows <= 80
    assert stored.lookup("id", 4000).count() == 0
    between = stored.between("id", 100, 180)
    assert sorted(r.id for r in between.collect()) == list(range(100, 181)) and scanned(between)[0] <= 5


def test_row_groups_are_skipped(spark, tmp_path):
    """Inside a file: statistics, and Bloom filters where values are not in order."""
    df = spark.range(60_000).select(F.col("id"), F.expr("pmod(id * 7919, 60000) * 2").alias("key"), F.repeat(F.lit("x"), 50).alias("pad"))
    table = OrderedTable(spark, f"file://{tmp_path}/t").store(df, [("id", "asc")], ["id", "key"], 2, block_bytes=64 * 1024)
    files, rows = scanned(table.lookup("id", 31_000))
    assert files == 1 and rows < 15_000
    there, missing = table.lookup("key", 2 * 777), table.lookup("key", 2 * 777 + 1)
    assert [r.key for r in there.collect()] == [1554] and missing.count() == 0
    assert scanned(missing)[1] == 0  # between the least and the greatest key, but in no Bloom filter


@pytest.mark.parametrize("order", [[("x", "desc"), ("name", "asc")], [("x", "asc")]])
def test_pages_give_every_row_once_in_order(spark, tmp_path, order):
    """Ties and nulls over many small files; pages longer and shorter than a file."""
    rows = table_rows(130)
    table = OrderedTable(spark, f"file://{tmp_path}/t").store(spark.createDataFrame(rows, "id long, x int, name string"), order, files=12)
    for per_page in (7, 64):
        seen, cursor = [], None
        while True:
            page, cursor = table.page_after(cursor, per_page)
            seen += [tuple(r) for r in page.collect()]
            if cursor is None:
                break
        assert sorted(seen, key=repr) == sorted(rows, key=repr)
        xs = [r[1] for r in seen]
        assert xs == (sorted(xs, key=lambda x: (x is None, -(x or 0))) if order[0][1] == "desc" else sorted(xs, key=lambda x: (x is not None, x or 0)))
        n = 2
        page, total, pages = table.page(n, per_page)
        assert ([tuple(r) for r in page.collect()], total, pages) == (seen[(n - 1) * per_page : n * per_page], 130, -(-130 // per_page))


def test_a_deep_page_opens_one_or_two_files(stored):
    page, total, pages = stored.page(199, 20)
    assert (total, pages) == (4000, 200) and [r.id for r in page.collect()] == list(range(3960, 3980))
    assert len(page.inputFiles()) <= 2


def test_ordered_edges(spark, tmp_path):
    table = OrderedTable(spark, f"file://{tmp_path}/t").store(spark.createDataFrame([], "id long"), [("id", "asc")])
    assert table.page_after(None)[0].count() == 0 and table.page_after(None)[1] is None and table.page(3)[1:] == (0, 0)
    assert table.lookup("id", 1).count() == 0
    table.store(spark.createDataFrame([(1,), (1,), (None,)], "id long"), [("id", "asc")])
    assert table.lookup("id", 1).count() == 2 and [r.id for r in table.page(1)[0].collect()] == [None, 1, 1]
    _, cursor = table.page_after(None, 2)
    table.store(spark.createDataFrame([(1,), (1,), (None,)], "id long"), [("id", "asc")])
    with pytest.raises(ValueError, match="anew"):
        table.page_after(cursor, 2)
