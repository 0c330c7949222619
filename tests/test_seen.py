"""Exact deduplication of a stream: copies fall however late they come."""

import random

import pytest
from pyspark.sql import functions as F

from tierflow.streaming import streams
from tierflow.streaming.seen import ExactDedup

SCHEMA = "id string, ts timestamp, x int"


def loads(n=6):
    """Rows whose ids come again in later loads, a month of event time apart; nulls among them."""
    rnd = random.Random(4)
    out = []
    for k in range(n):
        ids = [rnd.choice([None, *[f"i{j}" for j in range(40 * (k + 1))]]) for _ in range(80)]
        out.append([(i, f"2024-0{k + 1}-{rnd.randint(1, 28):02d} 00:00:00", rnd.randint(0, 9)) for i in ids])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, ts string, x int").withColumn("ts", F.col("ts").cast("timestamp"))


def expected(parts):
    seen, out = set(), []
    for k, part in enumerate(parts):
        keyed = [r for r in part if r[0] is not None]
        out += [(*r, k) for r in part if r[0] is None]
        for i in sorted({r[0] for r in keyed} - seen):
            out.append((*min((r for r in keyed if r[0] == i), key=lambda r: (r[1], r[2])), k))
        seen |= {r[0] for r in keyed}
    return sorted(out, key=repr), len(seen)


def plain(df):
    return sorted(((r.id, str(r.ts), r.x, r.epoch) for r in df.collect()), key=repr)


def test_batches_repeats_and_restart(spark, tmp_path):
    parts = loads()
    path = f"file://{tmp_path}/seen"
    dedup = ExactDedup(spark, path, "id", frame(spark, parts[0]).schema, 4, ["ts"])
    assert dedup.read().count() == 0 and dedup.state() == {"keys": 0, "runs": 0, "bytes": 0}
    for k, part in enumerate(parts):
        df = frame(spark, part)
        if k == 3:
            # An epoch that stored its rows and failed before its keys.
            dedup.new_rows(df).write.parquet(f"{path}/rows/epoch=3")
        dedup.take(df.repartition(3), k)
        if k in (2, 4):
            dedup.take(df, k)
            dedup = ExactDedup(spark, path, "id", df.schema, 4, ["ts"])
    rows, keys = expected(parts)
    assert plain(dedup.read()) == rows
    state = dedup.state()
    assert state["keys"] == keys and state["runs"] <= 6 and state["bytes"] > 0


def test_the_stored_keys_are_not_shuffled(spark, tmp_path):
    df = frame(spark, loads()[0])
    dedup = ExactDedup(spark, f"file://{tmp_path}/seen", "id", df.schema, 4)
    dedup.take(df, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.new_rows(frame(spark, loads()[1]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    depth = lines[scan].index("FileScan")
    # No exchange between the join and the scan of the keys.
    for line in reversed(lines[:scan]):
        at = next(i for i, c in enumerate(line) if c.isalpha())
        if at < depth:
            depth = at
            if "LeftAnti" in line:
                break
            assert "Exchange" not in line


@pytest.mark.parametrize("exact", [True, False])
def test_copies_a_month_late_in_a_stream(spark, tmp_path, exact):
    """With event times of their own, copies pass the bounded deduplication and not this one; late first rows are kept."""
    parts = [[("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:00", 1)], [("c", "2024-02-01 00:00:00", 1)], [("a", "2024-03-01 00:00:00", 2), ("late", "2024-01-01 00:00:00", 1)], [("a", "2024-04-01 00:00:00", 3)]]
    source = f"{tmp_path}/in"
    stream = None
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        if exact:
            dedup = ExactDedup(spark, f"file://{tmp_path}/seen", "id", stream.schema, 4)
            writer = dedup.stream(stream)
        else:
            writer = streams.dedup(streams.watermarked(stream, "ts"), ["id"]).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        for q in streams.start_all({"dedup": writer}, f"{tmp_path}/check{exact}"):
            q.awaitTermination()
    got = dedup.read() if exact else spark.read.parquet(f"{tmp_path}/out")
    ids = sorted(r.id for r in got.collect())
    if exact:
        assert ids == ["a", "b", "c", "late"]
    else:
        assert ids.count("a") > 1 and "late" not in ids
