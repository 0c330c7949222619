"""Parsing and reshaping of columns: JSON payloads, lists, numbers, dates, times.

ANSI mode is on, so every conversion is a ``try_`` form that gives null for bad
input instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separator of lists kept as text.
SEPARATOR = r"\s*,\s*"
#: White space that Python's strip() removes and that can stand at the ends of an element.
EDGES = r"^\s+|\s+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_payload(df: DataFrame, column: str, schema: T.StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """Expand a JSON payload (text or bytes) to its fields, beside ``keep``; a malformed one gives nulls."""
    return df.select(F.from_json(F.col(column).cast("string"), schema).alias("data"), *keep).select("data.*", *keep)


def to_payload(df: DataFrame, key: str) -> DataFrame:
    """``key, value``: the key as text and the whole row as JSON, as a log's writer takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def names(c: str | Column, field: str = "name") -> Column:
    """One field of each struct of an array."""
    return F.transform(col(c), lambda x: x[field])


def join_names(c: str | Column, field: str = "name", fallback: str | None = None, separator: str = ", ") -> Column:
    """One field of each struct joined to text; null elements are passed over, a null array gives ''."""
    pick = (lambda x: F.coalesce(x[field], x[fallback])) if fallback else (lambda x: x[field])
    return F.coalesce(F.array_join(F.transform(F.filter(col(c), lambda x: x.isNotNull()), pick), separator), F.lit(""))


def names_from_json(c: str | Column, field: str = "name", separator: str = ", ") -> Column:
    """Names of a JSON list of objects as text: null and JSON that is no list give '', what is not JSON stays."""
    text = col(c)
    value = F.try_parse_json(text)
    listed = F.from_json(text, f"array<struct<`{field}`:string>>")
    joined = F.array_join(F.filter(F.transform(listed, lambda x: x[field]), lambda x: x.isNotNull() & (x != "")), separator)
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "")
        .when(value.isNull(), text)
        .when(F.schema_of_variant(value).startswith("ARRAY"), F.coalesce(joined, F.lit("")))
        .otherwise("")
    )


def to_number(c: str | Column, kind: str = "double") -> Column:
    """Text to a number, null where it is none. Whole numbers may be written with a fraction, which is cut off."""
    text = F.trim(col(c).cast("string"))
    plain = F.when(~text.rlike("[dDfF]$"), text)  # Spark alone would read a type suffix
    if kind in ("double", "float"):
        return plain.try_cast(kind)
    return plain.try_cast("decimal(38,9)").try_cast(kind)


def try_date(c: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(col(c).cast("string"), F.lit(fmt)).cast("date")


#: Part -> function of a date; the first day of the week is Sunday, 1; weeks are ISO weeks.
DATE_PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "day_of_week": F.dayofweek, "week_of_year": F.weekofyear}


def date_parts(df: DataFrame, column: str, prefix: str = "", fmt: str = "yyyy-MM-dd", parts: Sequence[str] = tuple(DATE_PARTS)) -> DataFrame:
    """Add ``prefix + part`` for each part; ``column`` is a date, a timestamp or text in ``fmt``."""
    kind = df.schema[column].dataType
    date = try_date(column, fmt) if isinstance(kind, T.StringType) else F.col(column).cast("date")
    return df.withColumns({prefix + p: DATE_PARTS[p](date) for p in parts})


def event_time(df: DataFrame, candidates: Sequence[str], out: str = "event_time") -> DataFrame:
    """The first of several columns that holds a time."""
    tries = [F.try_to_timestamp(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("timestamp") for c in candidates]
    return df.withColumn(out, F.coalesce(*tries))


def audit(df: DataFrame, layer: str, at: str = "processed_at", **tags: object) -> DataFrame:
    """Add the time of processing, the layer and any constant tags."""
    return df.withColumns({at: F.current_timestamp(), "layer": F.lit(layer), **{k: F.lit(v) for k, v in tags.items()}})


def clock_parts(df: DataFrame, clock: Column | None = None) -> DataFrame:
    """Add ``process_hour`` and ``process_day_of_week`` (1 = Sunday) of the time of processing."""
    now = F.current_timestamp() if clock is None else clock
    return df.withColumns({"process_hour": F.hour(now), "process_day_of_week": F.dayofweek(now)})


def flatten_record(df: DataFrame, scalars: dict[str, object], lists: dict[str, tuple[str, str | None]], renames: dict[str, str] | None = None) -> DataFrame:
    """A nested record as a flat row.

    ``scalars``: column -> default where it is missing or null. ``lists``: array
    column -> (field, fallback field), joined with ', '. ``renames``: out -> in.
    """
    source = {out: (renames or {}).get(out, out) for out in scalars}
    flat = [(F.coalesce(F.col(source[out]), F.lit(d)) if source[out] in df.columns else F.lit(d)).alias(out) for out, d in scalars.items()]
    joined = [(join_names(c, field, fallback) if c in df.columns else F.lit("")).alias(c) for c, (field, fallback) in lists.items()]
    return df.select(*flat, *joined)


def elements(c: str | Column, separator: str = SEPARATOR) -> Column:
    """The non-blank elements of a list kept as text, without the white space around them."""
    return F.filter(F.transform(F.split(col(c), separator), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")


def explode_list(df: DataFrame, column: str, out: str, separator: str = SEPARATOR, trim: bool = True, drop_empty: bool = True) -> DataFrame:
    """One row per element of a list kept as text; a null list gives no row."""
    parts = F.split(F.col(column), separator)
    if trim:
        parts = F.transform(parts, lambda x: F.regexp_replace(x, EDGES, ""))
    if drop_empty:
        parts = F.filter(parts, lambda x: x != "")
    return df.withColumn(out, F.explode(parts))


def primary(c: str | Column, separator: str = SEPARATOR, none: str = "Unknown") -> Column:
    """The first non-blank element."""
    return F.coalesce(F.get(elements(c, separator), F.lit(0)), F.lit(none))


def n_items(c: str | Column, separator: str = SEPARATOR) -> Column:
    """Number of non-blank elements, 0 for null."""
    return F.coalesce(F.size(elements(c, separator)), F.lit(0))


def decade(year: str | Column, none: str = "Unknown") -> Column:
    """1994 -> '1990s'."""
    y = col(year)
    return F.when(y.isNull(), none).otherwise(F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s")))
