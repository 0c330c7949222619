"""Views over the given tables that the registered queries share, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import derive, parse
from ..sources import tables
from ..sources.workspace import children, delete_folder, fresh, make_folder, move_folder
from ..streaming import streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sold part: id, title, brand, kind, price, rating (mean quantity / 5), votes (lines), revenue, cost, popularity, size."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    # Lines are aggregated before the join, so the part table meets one row per part.
    sold = lines.groupBy("l_partkey").agg(
        (F.avg("l_quantity") / 5).alias("rating"), F.count("*").alias("votes"), F.sum(money).cast("double").alias("revenue"), F.sum("l_quantity").alias("quantity")
    )
    part = table(spark, sf_dir, "part")
    return sold.join(part, sold["l_partkey"] == part["p_partkey"]).select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.regexp_replace("p_name", " ", ", ").alias("tags"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
        "rating",
        "votes",
        "revenue",
        (F.col("quantity") * F.col("p_retailprice").cast("decimal(18,2)").cast("double")).alias("cost"),
        F.col("quantity").alias("popularity"),
    )


ITEMS_SQL = """items AS (
    SELECT p_partkey AS id, p_name AS title, replace(p_name, ' ', ', ') AS tags, p_brand AS brand, p_type AS kind, p_retailprice AS price, p_size AS size,
           rating, votes, revenue, quantity * CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS cost, quantity AS popularity
    FROM (SELECT l_partkey, avg(l_quantity) / 5 AS rating, count(*) AS votes,
                 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, sum(l_quantity) AS quantity
          FROM lineitem GROUP BY l_partkey) s JOIN part ON l_partkey = p_partkey)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.explode_list(items(spark, sf_dir), "tags", "tag")


TAGGED_SQL = ITEMS_SQL + ", tagged AS (SELECT items.*, unnest(string_split(tags, ', ')) AS tag FROM items)"


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    dated = parse.date_parts(orders, "o_orderdate", "order_")
    return dated.withColumn("value_label", derive.bucketize(F.col("o_totalprice") / 1000, derive.POPULARITY))


DATED_SQL = """dated AS (
    SELECT orders.*, CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(quarter(o_orderdate) AS INTEGER) AS order_quarter, CAST(month(o_orderdate) AS INTEGER) AS order_month,
           CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS order_day_of_week, CAST(weekofyear(o_orderdate) AS INTEGER) AS order_week_of_year,
           CASE WHEN o_totalprice >= 100000 THEN 'Viral' WHEN o_totalprice >= 50000 THEN 'Trending' WHEN o_totalprice >= 20000 THEN 'Popular'
                WHEN o_totalprice >= 10000 THEN 'Moderate' WHEN o_totalprice >= 5000 THEN 'Low' ELSE 'Niche' END AS value_label
    FROM orders)"""

#: Events before this day count as the batch layer's, later ones as the speed layer's.
SPLIT = "2024-01-20"


def event_stats(spark: SparkSession, sf_dir: str, speed: bool) -> DataFrame:
    events = table(spark, sf_dir, "events")
    side = events.where(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")) if speed else events.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    return side.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max("value").alias("top"))


EVENT_STATS_SQL = """b AS (SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS top FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
 s AS (SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS top FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)"""


def users(spark: SparkSession, sf_dir: str, speed: bool) -> DataFrame:
    """One row per user: the last event of that side, the best value, and the best value of an error, null for users without one. Events without time are batch's."""
    events = table(spark, sf_dir, "events")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    side = events.where(F.col("ts") >= cut) if speed else events.where(F.col("ts").isNull() | (F.col("ts") < cut))
    error = F.when(F.col("event_type") == "error", F.col("value"))
    return side.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max("value").alias("best"), F.max(error).alias("best_error"))


_USER_SQL = "SELECT user_id, max(event_id) AS last_event, max(value) AS best, max(value) FILTER (WHERE event_type = 'error') AS best_error FROM events"
USERS_SQL = f"""b AS ({_USER_SQL} WHERE ts < TIMESTAMP '2024-01-20' OR ts IS NULL GROUP BY 1),
 s AS ({_USER_SQL} WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)"""


@dataclass(frozen=True)
class Arrivals:
    """The events as a stream to which they come in parts.

    The parts lie ready in folders of any number of files; one arrives by moving its folder
    into the stream's, so a micro-batch has whole parts, whatever their files are.
    """

    stream: DataFrame
    staged: str
    parts: Sequence[str]
    folder: str

    def run(self, writers: dict[str, DataStreamWriter], no_data_batches: bool = True) -> list[dict]:
        """Start queries, let one part after the other arrive, and stop them when they have read all; their progress reports."""
        spark = self.stream.sparkSession
        queries = streams.start_all({f"{name}_{self.folder[-8:]}": w for name, w in writers.items()}, fresh(spark, "checkpoint"), "0 seconds", no_data_batches)
        out = streams.feed(queries, [partial(move_folder, spark, f"{self.staged}/{p}", f"{self.folder}/{p}") for p in self.parts])
        for path in (self.staged, self.folder):
            delete_folder(spark, path)
        return out


def arrivals(spark: SparkSession, sf_dir: str, slices: int = 5, by: str = "time", late: bool = False) -> Arrivals:
    """The events in ``slices`` parts.

    ``by``: time, where events without one come last as a part of their own; or hash, for parts in no order.
    ``late``: the first part comes again at the end, with negative ids.
    """
    events = table(spark, sf_dir, "events")
    if by == "time":
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        first, last = events.agg(F.min(micros), F.max(micros)).first()
        width = ((last or 0) - (first or 0)) // slices + 1
        part = F.coalesce(F.floor((micros - F.lit(first or 0)) / F.lit(width)).cast("int"), F.lit(slices))
    else:
        part = F.pmod(F.xxhash64("event_id"), F.lit(slices)).cast("int")
    dealt = events.withColumn("arrival", part)
    if late:
        again = dealt.where("arrival = 0").withColumns({"event_id": -1 - F.col("event_id"), "arrival": F.lit(slices + 1)})
        dealt = dealt.unionByName(again)
    staged, folder = fresh(spark, "staged"), fresh(spark, "stream")
    dealt.write.partitionBy("arrival").parquet(staged)
    make_folder(spark, folder)
    parts = sorted((p for p in children(spark, staged) if p.startswith("arrival=")), key=lambda p: int(p.partition("=")[2]))
    # The file source's own order and number of files play no part: what has arrived is read whole.
    stream = tables.read_log(spark, "parquet", {"path": folder, "recursiveFileLookup": "true"}, streaming=True, schema=events.schema)
    return Arrivals(stream, staged, parts, folder)
