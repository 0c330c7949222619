"""Ranks kept up by loads, against ranks of all rows."""

import random

import pytest

from tierflow.operators.windows import Ranking, distributed_ranks
from tierflow.sources.ranked import RankedTable
from tierflow.sources.workspace import children, move_folder

SCHEMA = "id long, g string, x int, s string"
KINDS = {"r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist", "n": "row_number", "t": "ntile:4"}
WHOLE = Ranking([("x", "desc"), ("s", "asc")], KINDS, ["id"])
GROUPED = Ranking([("x", "desc")], KINDS, ["id"], ["g"])


def load_rows(seed, ids):
    """Half of the rows are in one group and a third have one value."""
    rnd = random.Random(seed)
    return [(i, rnd.choice(["hot", "hot", "a", None]), rnd.choice([7, None, *[rnd.randint(0, 20)] * 4]) if i % 3 else 7, rnd.choice(["u", None])) for i in ids]


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ranking", [WHOLE, GROUPED])
def test_every_load_equals_ranks_of_all_rows(spark, tmp_path, ranking):
    """New, changed and removed rows, a key in both, repeated and empty loads, one that failed half way."""
    loads = [(range(150), []), (range(140, 200), [3, 4, 140, 999]), ([], []), (range(3, 9), [190]), ([], range(0, 200))]
    now, table = {}, None
    for k, (ids, away) in enumerate(loads):
        rows = load_rows(k, ids)
        df = spark.createDataFrame([*rows, (None, "a", 1, None)], SCHEMA).repartition(3)
        gone = spark.createDataFrame([(i,) for i in away], "id long")
        table = RankedTable(spark, f"file://{tmp_path}/t", df.schema, "id", ranking, 20, 4)
        if k == 1:
            with pytest.MonkeyPatch.context() as m:
                m.setattr(table, "_publish", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    table.load(df, k, gone=gone)
        table.load(df, k, gone=gone)
        if k in (0, 3):
            table.load(df, k, gone=gone)
        now = {i: r for i, r in now.items() if i not in away} | {r[0]: r for r in rows}
        want = distributed_ranks(spark.createDataFrame(list(now.values()), SCHEMA), [ranking], 3)
        assert as_set(table.read().select(want.columns)) == as_set(want)
        if k < 4:
            assert table.index().count() > 3
    assert table.read().count() == 0 and table.lookup(5).count() == 0


def test_untouched_ranges_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(i, "a", i, None) for i in range(2000)], SCHEMA)
    table = RankedTable(spark, f"file://{tmp_path}/t", df.schema, "id", Ranking([("x", "desc")], KINDS), 100, 4)
    table.load(df, 0)
    ranges = table.index().orderBy("__part").collect()
    assert 15 <= len(ranges) <= 25
    # A load that moves the row of id 5 to the front touches the first and the last range; the others are away meanwhile.
    aside = [f"__range={r['__range']}" for r in ranges[2:-2]]
    for name in aside:
        move_folder(spark, f"{table.path}/rows/__epoch=0/{name}", f"{tmp_path}/{name}")
    table.load(spark.createDataFrame([(5, "a", 9999, None)], SCHEMA), 1)
    assert [(r.id, r.r) for r in table.rows_from(0, 3).collect()] == [(5, 1), (1999, 2), (1998, 3)]
    for name in aside:
        move_folder(spark, f"{tmp_path}/{name}", f"{table.path}/rows/__epoch=0/{name}")
    assert len(children(spark, f"{table.path}/rows/__epoch=1")) <= 6
    assert {r.id: r.r for r in table.read().collect()} == {5: 1} | {i: 2001 - i for i in range(6, 2000)} | {i: 2000 - i for i in range(5)}
    assert [tuple(r) for r in table.lookup(1000).select("id", "r", "n").collect()] == [(1000, 1001, 1001)]
    assert len(table.lookup(1000).inputFiles()) <= 2


def test_small_ranges_are_absorbed_and_old_ones_deleted(spark, tmp_path):
    df = spark.createDataFrame([(i, "a", i, None) for i in range(400)], SCHEMA)
    table = RankedTable(spark, f"file://{tmp_path}/t", df.schema, "id", Ranking([("x", "asc")], {"n": "row_number"}), 50, 4)
    table.load(df, 0)
    for k in range(1, 5):
        table.load(spark.createDataFrame([(1000 * k + i, "a", 97 * i % 400, None) for i in range(3)], SCHEMA), k)
    assert table.index().count() <= 24
    live = {(r["__epoch"], r["__range"]) for r in table.index().collect()}
    there = {(e, int(r.removeprefix("__range="))) for e in range(5) for r in children(spark, f"{table.path}/rows/__epoch={e}") if r.startswith("__range=")}
    assert live <= there and len(there) <= len(live) + 24
    assert [r.n for r in table.rows_from(100, 5).collect()] == list(range(101, 106))
