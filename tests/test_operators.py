"""Edge rows of the general operators."""

import pytest
from pyspark.sql import functions as F

from tierflow.functions import derive as D
from tierflow.functions import parse as P
from tierflow.operators import filters, joins, merge, pivots, serve, windows
from tierflow.sources import sinks, tables
from tierflow.streaming import streams


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expression.alias("y")).orderBy("i").select("y").collect()]


def test_bucketize(spark):
    nan = float("nan")
    got = column(spark, [None, nan, 9.0, 8.99, 3.0, 2.99, -1.0], "double", D.bucketize("x", D.RATING))
    assert got == ["Unknown", "Very Poor", "Masterpiece", "Excellent", "Poor", "Very Poor", "Very Poor"]
    assert column(spark, [None, 0.0, -5.0, 1e6, 2e8], "double", D.bucketize("x", D.BUDGET, zero_is_null=True)) == ["Unknown", "Unknown", "Micro Budget", "Low Budget", "Mega Blockbuster"]
    assert column(spark, [0.0, 59.0, 60.0, 179.0, 180.0, nan], "double", D.bucket_runtime("x")) == ["Unknown", "Short Film", "Short Feature", "Epic", "Extended", "Extended"]
    assert column(spark, [5, 6, 12, 17, 21, None], "int", D.bucketize("x", D.PERIOD)) == ["Night", "Morning", "Afternoon", "Evening", "Night", "Unknown"]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, None), (3, 0.0, 5.0), (4, 15.0, 10.0)], "i int, r double, c double")
    out = df.orderBy("i").select(D.roi("r", "c"), D.margin("r", "c"), D.profit("r", "c", True)).collect()
    assert [tuple(x) for x in out] == [(None, None, None), (None, None, None), (-100.0, None, None), (50.0, 33.33, 5.0)]


def test_lists(spark):
    values = [None, "", "A", "A,B", "A, ,B", "\tA ,B\n"]
    assert column(spark, values, "string", P.primary("x")) == ["Unknown", "Unknown", "A", "A", "A", "A"]
    assert column(spark, values, "string", P.n_items("x")) == [0, 0, 1, 2, 2, 2]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert sorted(r.e for r in P.explode_list(df, "x", "e").collect()) == ["A", "A", "A", "A", "B", "B", "B"]


def test_numbers_and_dates(spark):
    assert column(spark, ["7.5", " 7.5 ", "abc", "", "1.5d", None], "string", P.to_number("x")) == [7.5, 7.5, None, None, None, None]
    assert column(spark, ["100.0", "100.9", "x", None], "string", P.to_number("x", "long")) == [100, 100, None, None]
    got = column(spark, ["1999-12-31", "", "bad", None, "2000-02-29"], "string", F.year(P.try_date("x")))
    assert got == [1999, None, None, None, 2000]
    assert column(spark, [1994, 2000, None], "int", P.decade("x")) == ["1990s", "2000s", "Unknown"]


def test_names_from_json(spark):
    values = ['[{"id":1,"name":"A"},{"id":2,"name":"B"}]', '{"name":"A"}', "broken [", '[{"id":3}]', None, "[]"]
    assert column(spark, values, "string", P.names_from_json("x")) == ["A, B", "", "broken [", "", "", ""]


def test_merge_rows(spark):
    b = spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (None, 5, "n")], "id int, a int, b string")
    s = spark.createDataFrame([("2", None, 7), ("3", 30, 8)], "id string, a int, c int")
    got = {r.id: (r.a, r.b, r.c, r.source) for r in merge.merge_rows(b, s, "id").collect()}
    assert got == {"1": (10, "x", None, "batch"), "2": (20, "y", 7, "merged"), "3": (30, None, 8, "speed")}
    assert {r.id: r.a for r in merge.merge_rows(b, s, "id", True).collect()}["2"] is None


def test_merge_aggregates(spark):
    b = spark.createDataFrame([("a", 2, 3.0, 10), ("b", 0, 5.0, 1), ("c", 1, 1.0, None)], "k string, n int, m double, t int")
    s = spark.createDataFrame([("a", 1, 6.0, 5), ("b", 2, 9.0, None), ("d", 4, 2.0, 2)], "k string, n int, m double, t int")
    got = {r.k: (r.n, r.m, r.t, r.source) for r in merge.merge_aggregates(b, s, "k", "n", ["t"], ["m"]).collect()}
    assert got == {"a": (3, 4.0, 15, "merged"), "b": (2, 5.0, 1, "merged"), "c": (1, 1.0, None, "batch"), "d": (4, 2.0, 2, "speed")}


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_distributed_rank_equals_window(spark, way):
    from pyspark.sql import Window

    rows = [(i, None if i % 17 == 0 else float(i * 7 % 11), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y int")
    kinds = {"r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist"}
    got = windows.distributed_rank(df, [("x", way), ("y", "asc")], kinds, buckets=5)
    got = windows.distributed_rank(got, [("x", way)], {"n": "row_number", "t": "ntile:7"}, ["id"], 5)
    w = Window.orderBy(*windows.ordered([("x", way), ("y", "asc")]))
    u = Window.orderBy(*windows.ordered([("x", way), ("id", "asc")]))
    want = df.select("id", *[getattr(F, k)().over(w).alias(c) for c, k in kinds.items()], F.row_number().over(u).alias("n"), F.ntile(7).over(u).alias("t"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_distributed_rank_in_groups_over_ranges(spark, buckets):
    """Runs of equal keys and groups that go on over several ranges, a value on 90 % of rows, null groups."""
    from pyspark.sql import Window

    rows = [(i, None if i % 50 == 0 else "hot" if i % 10 else f"g{i % 30}", 1.0 if i % 10 < 9 else float(i % 4), i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y int")
    kinds = {"r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist", "n": "row_number", "t": "ntile:4"}
    got = windows.distributed_ranks(
        df, [windows.Ranking([("x", "desc"), ("y", "asc")], kinds, ["id"], ["g"]), windows.Ranking([("x", "asc")], {"all_r": "rank", "all_d": "dense_rank", "all_c": "cume_dist"})], buckets
    )
    w = Window.partitionBy("g").orderBy(F.col("x").desc_nulls_last(), F.col("y").asc_nulls_first())
    u = Window.partitionBy("g").orderBy(F.col("x").desc_nulls_last(), F.col("y").asc_nulls_first(), "id")
    a = Window.orderBy(F.col("x").asc_nulls_first())
    plain = {"r": F.rank().over(w), "d": F.dense_rank().over(w), "p": F.percent_rank().over(w), "c": F.cume_dist().over(w), "n": F.row_number().over(u), "t": F.ntile(4).over(u)}
    want = df.withColumns({**plain, "all_r": F.rank().over(a), "all_d": F.dense_rank().over(a), "all_c": F.cume_dist().over(a)})
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_distributed_rank_edges(spark):
    empty = spark.createDataFrame([], "id int, x double")
    assert windows.distributed_rank(empty, [("x", "desc")], {"r": "rank"}).count() == 0
    tied = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, x double")
    assert {r.r for r in windows.distributed_rank(tied, [("x", "desc")], {"r": "rank"}).collect()} == {1}
    one = spark.createDataFrame([(1, None)], "id int, x double")
    assert [(r.r, r.p) for r in windows.distributed_rank(one, [("x", "asc")], {"r": "rank", "p": "percent_rank"}).collect()] == [(1, 0.0)]


def test_similar_pairs(spark):
    rows = [(1, "a", 1.0), (2, "a", 1.5), (3, "a", 1.49), (4, "b", 1.0), (5, "a", None), (6, "a", 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {(r.id_1, r.id_2) for r in joins.similar_pairs(df, "id", ["g"], "v", 0.5).collect()}
    assert got == {(1, 3), (1, 6), (2, 3), (3, 6)}


def test_pivot_round_trip(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), (None, "x")], "r string, c string")
    wide = pivots.pivot_table(df, ["r"], "c", F.count(F.lit(1)), ["x", "y"])
    assert {r.r: (r.x, r.y) for r in wide.collect()} == {"a": (2, 1), "b": (0, 0)}
    assert {(r.r, r.variable, r.value) for r in pivots.unpivot_table(wide, ["r"], ["x", "y"], drop_zero=True).collect()} == {("a", "x", 2), ("a", "y", 1)}


def test_filters(spark):
    df = spark.createDataFrame([(1, "A.b", None), (2, "axb", "Q"), (None, "", "q")], "id int, t string, u string")
    assert [r.id for r in filters.search(df, "a.B", ["t", "u"]).collect()] == [1]
    assert sorted(r.id for r in filters.search(df, "a.B", ["t"], literal=False).collect()) == [1, 2]
    assert filters.valid(df, ["id"], ["t"]).count() == 2
    assert filters.where_optional(df, {"id": None, "t": "axb"}).count() == 1
    assert filters.lookup_key(df, "id", "2").count() == 1


def test_serving(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(10)], "k int, v int")
    rows, total, pages = serve.page(df, [F.desc("v"), "k"], 2, 4)
    assert ([r.k for r in rows.collect()], total, pages) == ([1, 5, 9, 0], 10, 3)
    assert [r.k for r in serve.page(df, ["k"], 9, 4)[0].collect()] == []
    status = serve.view_status({"v": df.withColumn("epoch_id", F.col("k").cast("long"))}).collect()
    assert [(r.view, r.n_rows, r.last_epoch) for r in status] == [("v", 10, 9)]


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "master")
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("", "c"), (None, "d"), ("2", "e")], "id string, v string")
    assert sinks.append_new(df, path, "id", ["v"]) == 2
    assert sinks.append_new(df.union(spark.createDataFrame([("3", "f")], "id string, v string")), path, "id", ["v"]) == 1
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("1", "a"), ("2", "e"), ("3", "f")]


def test_upsert_replay_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "k string, v int, at int")
    second = spark.createDataFrame([("b", 9, 3)], "k string, v int, at int")
    for epoch, df in ((0, first), (1, second), (1, second)):
        sinks.upsert(df, path, "k", epoch, ["at"])
    want = [("a", 2), ("b", 9)]
    assert sorted((r.k, r.v) for r in sinks.read_upserted(spark, path, "k").collect()) == want
    for _ in range(2):
        sinks.compact(spark, path, "k")
        assert sorted((r.k, r.v) for r in sinks.read_upserted(spark, path, "k").collect()) == want
    sinks.upsert(spark.createDataFrame([("a", 7, 4)], "k string, v int, at int"), path, "k", 2, ["at"])
    sinks.compact(spark, path, "k")  # deletes what the first compaction had covered
    sinks.upsert(spark.createDataFrame([("c", 5, 5)], "k string, v int, at int"), path, "k", 3, ["at"])
    assert sorted((r.k, r.v) for r in sinks.read_upserted(spark, path, "k").collect()) == [("a", 7), ("b", 9), ("c", 5)]


def test_running_totals_over_epochs(spark, tmp_path):
    """Epochs add up, a replayed one counts once, compacted or not."""
    view = streams.View("v", "k", lambda b: b.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("low")), {"n": "sum", "low": "min"})
    run = streams.micro_batch_views([view], str(tmp_path), compact_every=2)
    rows = [("a", 5), ("a", 3), ("b", 9), ("a", 4), ("b", 1), ("c", 2)]
    for epoch in (0, 1, 1, 2, 3, 3, 4):
        part = rows[epoch : epoch + 1] if epoch < 4 else rows[4:]
        run(spark.createDataFrame(part, "k string, x int"), epoch)
    got = {r.k: (r.n, r.low) for r in sinks.read_upserted(spark, f"{tmp_path}/v", "k", merge=view.merge).collect()}
    assert got == {"a": (3, 3), "b": (2, 1), "c": (1, 2)}


def test_sources(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.snapshot_csv(spark.createDataFrame([('say "x", y', 1), ("two\nlines", 2)], "t string, id int"), path)
    got = tables.read_table(spark, path, "id int, t string, extra double", "csv").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'say "x", y', None), (2, "two\nlines", None)]
    assert tables.mapping(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text('[{"id": 1, "name": "one"}]')
    assert joins.map_value(spark.createDataFrame([(1,), (2,)], "g int"), "g", tables.mapping(spark, str(tmp_path / "m.json")), "n").orderBy("g").collect()[0].n == "one"


def test_failing_view_fails_the_epoch(spark, tmp_path):
    good = streams.View("good", "k", lambda b: b)
    bad = streams.View("bad", "k", lambda b: b.select("missing"))
    batch = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(RuntimeError, match="bad"):
        streams.micro_batch_views([bad, good], str(tmp_path))(batch, 3)
    assert sinks.read_upserted(spark, str(tmp_path / "good"), "k").count() == 1


def test_stream_restart(spark, tmp_path):
    """Files that arrive one by one, the query restarted for each: the same as one read of all."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(3):
        spark.createDataFrame([(f"u{i}", k * 10 + i) for i in range(3)], "u string, v int").coalesce(1).write.mode("append").parquet(str(source))
        stream = tables.read_log(spark, "parquet", {"path": str(source)}, True, "u string, v int")
        for q in streams.start_all({"s": streams.upsert_stream(stream, target, "u", ["v"])}, str(tmp_path / "cp")):
            q.awaitTermination()
    assert sorted((r.u, r.v) for r in sinks.read_upserted(spark, target, "u").collect()) == [("u0", 20), ("u1", 21), ("u2", 22)]


def test_upsert_of_shuffled_files(spark, tmp_path):
    """The newest row wins over several epochs, also where files come in the wrong order."""
    import os

    from tierflow.plans import registry

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    files = [7, 11, 3, 0, 9, 5, 1, 10, 2, 8, 4, 6]
    for place, part in enumerate(files):
        rows = [(part * 10 + i, (part + i) % 5) for i in range(10)]
        spark.createDataFrame(rows, "event_id long, user_id long").toPandas().to_parquet(folder / f"{place:02}.parquet")
        os.utime(folder / f"{place:02}.parquet", (1_700_000_000 + 60 * place,) * 2)
    got = {r.user_id: r.event_id for r in registry.queries()["snk_03_upsert"](spark, str(tmp_path)).collect()}
    want = {}
    for part in range(12):
        for i in range(10):
            want[(part + i) % 5] = max(want.get((part + i) % 5, 0), part * 10 + i)
    assert got == want


def test_similar_classes_hold_all_pairs(spark):
    """Expanded by their members, the pairs of classes are the pairs of rows; copies are one class."""
    rows = [(i, "ab"[i % 7 % 2] if i % 11 else None, (i * 37 % 23) / 10 if i % 13 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    pairs, members = joins.similar_classes(df, "id", ["g"], "v", 0.5)
    of = {}
    for r in members.collect():
        of.setdefault(r.class_id, []).append(r.id)
    found = pairs.collect()
    assert all(r.v_1 <= r.v_2 and r.n_pairs > 0 for r in found) and len(found) < 2 * 23 * 5
    got = [tuple(sorted((a, b))) for r in found for a in of[r.class_1] for b in of[r.class_2] if r.class_1 != r.class_2 or a < b]
    want = [(r.id_1, r.id_2) for r in joins.similar_pairs(df, "id", ["g"], "v", 0.5).collect()]
    assert sorted(got) == sorted(want) and sum(r.n_pairs for r in found) == len(want)


def test_similar_parts_are_listed_pair_by_pair(spark, tmp_path):
    """Copies of a part are rows like others: every pair of rows is in the result, with both keys and prices."""
    import duckdb

    from tierflow.plans import registry

    rows = [(i if i % 17 else None, "xy"[i % 3 % 2] if i % 13 else None, "t" if i % 11 else None, 900 + i % 7 * 0.2 if i % 19 else None) for i in range(240)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_retailprice double").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, registry.queries()["join_04_similar_pairs"](spark, str(tmp_path)).select("p_partkey_1", "p_partkey_2", "p_retailprice_1", "p_retailprice_2").collect()))
    whole = [r for r in rows if None not in r]
    assert got == sorted((a[0], b[0], a[3], b[3]) for a in whole for b in whole if a[:1] < b[:1] and a[1:3] == b[1:3] and abs(a[3] - b[3]) < 0.5)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    columns = "p_partkey_1, p_partkey_2, p_retailprice_1, p_retailprice_2"
    assert sorted(con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()['join_04_similar_pairs']})").fetchall()) == got


def test_similar_pairs_of_a_large_block_are_dealt_out(spark, monkeypatch):
    """A block far beyond a tile, of keys that a hash has chosen, next to small ones: the same pairs, in many tasks."""
    monkeypatch.setattr(joins, "TILE_ROWS", 16)
    monkeypatch.setattr(joins, "TASK_PAIRS", 1_000)
    keys = [r.id for r in spark.range(1_200).where("pmod(xxhash64(id), 3) = 0").collect()]
    odd = [float("nan"), float("inf"), float("-inf"), -1e300, 1e300, None, -0.2, -0.0, 0.0, 0.2]
    rows = [(k, "hot", 7.0 + k % 4 / 10, k % 3) for k in keys] + [(2_000 + i, None if i % 9 == 0 else "ab"[i % 2], i * 37 % 50 / 10, i) for i in range(60)]
    rows += [(3_000 + i, "odd", odd[i % 10], i) for i in range(30)] + [(keys[0], "hot", 7.3, 5)]
    pairs = joins.similar_pairs(spark.createDataFrame(rows, "id long, g string, v double, n int").repartition(3), "id", ["g"], "v", 0.5, ["n"])
    assert pairs.columns == ["g", "id_1", "v_1", "n_1", "id_2", "v_2", "n_2"]
    whole = [r for r in rows if None not in r]
    want = [(a[1], a[0], *a[2:], b[0], *b[2:]) for a in whole for b in whole if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) < 0.5]
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(tasks) == len(want) > 50_000 and max(tasks) < len(want) / 10


def test_global_ranks_of_repeated_keys(spark, tmp_path):
    """Lines of one key and price that differ in quantity: their places are the SQL's, not chance."""
    import duckdb

    from tierflow.plans import registry

    lines = spark.range(4_000).select(
        (F.col("id") % 20).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 7 % 50).cast("double").alias("l_quantity"), (F.col("id") * 3 % 11 / 100).alias("l_discount"), F.lit(5.0).alias("l_extendedprice")
    )
    lines.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = registry.queries()["win_13_global_ranks"](spark, str(tmp_path)).toPandas()
    want = con.execute(registry.oracle_sql()["win_13_global_ranks"]).df()[list(got.columns)]
    assert sorted(map(tuple, got.round(9).values.tolist())) == sorted(map(tuple, want.round(9).values.tolist()))


@pytest.mark.parametrize("name", ["join_05_merge_rows", "join_07_point_merge", "join_10_fallback", "srt_06_07_merged_page", "srt_07_merged_top", "srt_04_null_as_zero"])
def test_layers_with_nulls_and_rows_without_time(spark, tmp_path, name):
    """Users without an error on a side, and events without a time: as in SQL, and none is left out."""
    import duckdb

    from tierflow.plans import registry

    days = F.timestamp_seconds(F.lit(1_705_622_400) + F.col("id") % 5 * 86_400).cast("timestamp_ntz")
    events = spark.range(300).select(
        F.col("id").alias("event_id"), (F.col("id") % 47).alias("user_id"), F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("event_type"), (F.col("id") * 31 % 97 - 9.0).cast("double").alias("value"),
        F.when(F.col("id") % 47 != 11, days).alias("ts"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    out = registry.queries()[name](spark, str(tmp_path))
    got, want = out.collect(), con.execute(f"SELECT {', '.join(out.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    if name.startswith("join_0"):
        assert len(got) == 47 and "11" in {r.user_id for r in got}
    if name == "join_07_point_merge":
        assert any(r.best_error is None for r in got)
