"""Reading tables and logs, and the lookup tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Options of the CSV dialect: header line, values over several lines, quotes doubled.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}

# The lookup tables' rows.
GENRES = [
    ("Action", "High Energy", 1, "action-adventure"),
    ("Adventure", "Exciting", 2, "action-adventure"),
    ("Animation", "Family Friendly", 3, "family"),
    ("Comedy", "Light Entertainment", 4, "comedy"),
    ("Crime", "Dark", 5, "thriller"),
    ("Documentary", "Educational", 6, "documentary"),
    ("Drama", "Emotional", 7, "drama"),
    ("Family", "All Ages", 8, "family"),
    ("Fantasy", "Imaginative", 9, "fantasy-scifi"),
    ("History", "Historical", 10, "drama"),
    ("Horror", "Thrilling", 11, "horror"),
    ("Music", "Musical", 12, "music"),
    ("Mystery", "Intriguing", 13, "thriller"),
    ("Romance", "Love Stories", 14, "romance"),
    ("Science Fiction", "Futuristic", 15, "fantasy-scifi"),
    ("TV Movie", "Television", 16, "other"),
    ("Thriller", "Suspenseful", 17, "thriller"),
    ("War", "Conflict", 18, "drama"),
    ("Western", "American Frontier", 19, "western"),
]
LANGUAGES = [
    ("en", "English", "Western", True),
    ("es", "Spanish", "Western", True),
    ("fr", "French", "Western", True),
    ("de", "German", "Western", True),
    ("it", "Italian", "Western", True),
    ("pt", "Portuguese", "Western", True),
    ("ja", "Japanese", "Asian", True),
    ("ko", "Korean", "Asian", True),
    ("zh", "Chinese", "Asian", True),
    ("hi", "Hindi", "Asian", True),
    ("ru", "Russian", "Eastern European", True),
    ("ar", "Arabic", "Middle Eastern", True),
]
DECADES = [
    ("1970s", "New Hollywood", "Renaissance"),
    ("1980s", "Blockbuster Era", "Commercial"),
    ("1990s", "Indie Rise", "Diverse"),
    ("2000s", "Digital Revolution", "Technological"),
    ("2010s", "Streaming Age", "Modern"),
    ("2020s", "Post-Pandemic", "Hybrid"),
]

LOOKUPS = {
    "genre": (GENRES, "genre_name string, genre_description string, genre_priority bigint, genre_category string"),
    "language": (LANGUAGES, "lang_code string, lang_name string, lang_region string, is_major boolean"),
    "decade": (DECADES, "decade string, era_name string, era_characteristic string"),
}


def align(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Columns of ``schema`` by name, typed; missing ones are typed nulls and others are left out."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table by path: local, or any store the session has a file system for.

    CSV columns are matched to ``schema`` by the header's names, so files with
    fewer or reordered columns do not shift.
    """
    reader = spark.read.format(fmt).options(**({**CSV_OPTIONS, **options} if fmt == "csv" else options))
    if fmt == "json" and schema is not None:
        return reader.schema(schema).load(path)
    df = reader.load(path)
    return df if schema is None else align(df, schema)


def read_log(spark: SparkSession, fmt: str, options: Mapping[str, str] | None = None, streaming: bool = False, schema: T.StructType | str | None = None, rate: int | None = None) -> DataFrame:
    """An event log, bounded or as a stream, with what the broker knows of each message.

    ``rate``: most offsets (or files) of a micro-batch. A log of the kafka kind
    gives ``key, value, timestamp, partition, offset``; others keep their columns.
    """
    options = dict(options or {})
    if fmt == "kafka":
        options = {"startingOffsets": "earliest", **({"failOnDataLoss": "false"} if streaming else {"endingOffsets": "latest"}), **options}
    if rate is not None:
        options["maxOffsetsPerTrigger" if fmt == "kafka" else "maxFilesPerTrigger"] = str(rate)
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if schema is not None and fmt != "kafka":
        reader = reader.schema(schema)
    df = reader.load()
    return message_columns(df) if fmt == "kafka" else df


def message_columns(df: DataFrame) -> DataFrame:
    """Key and value as text beside broker time, partition and offset."""
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp", "partition", "offset")


def from_rows(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def lookup(spark: SparkSession, name: str) -> DataFrame:
    """One of the fixed dimension tables: genre, language, decade."""
    rows, schema = LOOKUPS[name]
    return spark.createDataFrame(rows, schema)


def mapping(spark: SparkSession, path: str, key: str = "id", value: str = "name", key_type: str = "int") -> DataFrame:
    """A JSON list of {key, value} as a table; a missing file is an empty one."""
    schema = f"`{key}` {key_type}, `{value}` string"
    try:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_view(spark: SparkSession, path: str, where=None, order=(), limit: int | None = None) -> DataFrame:
    """A stored view, filtered, ordered and cut; the filter reaches the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(limit)
