"""The similar-pairs view kept up by loads, against a full join."""

import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators.joins import similar_pairs
from tierflow.sources.pairsview import SimilarPairsView

from test_ordered import scanned

SCHEMA = "id long, g string, h int, v double, note string"
ARGS = ("id", ["g", "h"], "v", 0.5)


def load_rows(seed, ids):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 2), rnd.choice([None, *[rnd.uniform(0, 12)] * 9]), f"{seed}-{i}") for i in ids]


def test_five_loads_equal_a_full_join(spark, tmp_path):
    """New rows, changed rows, rows that lose their value, repeated loads and a load that failed half way."""
    loads = [load_rows(k, ids) for k, ids in enumerate([range(200), range(150, 260), range(0, 260, 9), [], range(255, 300)])]
    view = None
    for k, rows in enumerate(loads):
        df = spark.createDataFrame([*rows, (None, "a", 1, 1.0, None)], SCHEMA).repartition(3)
        view = SimilarPairsView(spark, f"file://{tmp_path}/v", df.schema, *ARGS, ["note"], folders=8, buckets=4)
        if k == 2:
            with pytest.MonkeyPatch.context() as m:
                m.setattr(view, "_across", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    view.load(df, k)
        view.load(df, k)
        if k in (1, 3):
            view.load(df, k)
        now = {r[0]: r for x in loads[: k + 1] for r in x}
        want = similar_pairs(spark.createDataFrame(list(now.values()), SCHEMA), *ARGS, ["note"])
        got = view.read().select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert view.read().count() > 50


def test_a_small_load_opens_few_folders(spark, tmp_path):
    df = spark.range(20_000).select("id", F.lit("a").alias("g"), F.lit(1).alias("h"), (F.col("id") / 10).alias("v"), F.lit("").alias("note"))
    view = SimilarPairsView(spark, f"file://{tmp_path}/v", df.schema, *ARGS, folders=64, buckets=4)
    view.load(df, 0)
    files, rows = scanned(view.partners(df.where("id = 777"), [0]))
    assert files <= 3 and rows < 20_000 / 10
    before = view.read().count()
    view.load(df.where("id = 777").withColumn("v", F.lit(-100.0)), 1)
    assert view.read().count() == before - 8  # four partners on either side are closer than 0.5
    with pytest.raises(FileNotFoundError):
        SimilarPairsView(spark, f"file://{tmp_path}/w", df.schema, *ARGS, buckets=4).read()
