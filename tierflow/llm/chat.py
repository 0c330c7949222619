"""Chat formatting: fold an event log into final messages, then render them.

The log has one row per event: ``conv_id``, ``seq``, ``message_id``, ``kind``,
``role``, ``text``. Kinds:

* ``message`` starts a message (or restates it: the last statement counts);
* ``delta`` appends streamed text to it;
* ``edit`` replaces its text;
* ``regenerate`` throws its text away (the row's text, if any, starts the new
  one) and drops every message that began between the message's start and this
  event, since those answered the old version.

1. Events are dealt by conversation and message, sorted by ``seq`` and folded one
   by one; a task holds one message at a time.
2. Messages are dealt by conversation, sorted by ``seq`` and folded in that order:
   the latest regeneration of what has begun so far decides which messages are
   dropped, so nothing but that number is held.
3. What is left is rendered in the same order, in runs of at most ``RUN`` messages
   or ``RUN_CHARS`` characters, a row each; ``start`` counts the code points before.

A conversation is never one row. Its messages pass through one task in steps 2
and 3, since a digest over them has an order, but only as a stream.

Defined results: events without ``message_id`` are messages of their own, whatever
their kind; null text or role counts as empty; a null kind, or one not named
above, is a message; a null conversation id is a conversation like any other;
null ``seq`` comes first and is never dropped; events of a message with equal
``seq`` are taken in the order message, regenerate, edit, delta, then by role and
text; messages with equal ``seq`` are ordered by role and text, and do not drop one
another; a regeneration counts even if its own message is dropped; a message's
role is that of its first ``message`` event, or of its first event; repeated rows
without message id all stay; texts of any length stay whole; an empty log gives
an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Messages and characters at most of a rendered run (a longer message is a run of its own).
RUN, RUN_CHARS = 64, 1 << 20


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``mid`` + text + ``close`` for each turn.

    Role and text are escaped with a backslash so that neither ``open``'s first
    two characters nor ``mid``'s can be read inside them: every ``\\``, every
    ``<|`` and every ``|>`` gets one, and taking them away gives the text back.
    """

    open: str = "<|"
    mid: str = "|>\n"
    close: str = "<|end|>\n"
    trained_roles: tuple[str, ...] = ("assistant",)

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text_at])
        if len(held) >= 4096 or chars >= 1 << 22:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _id_type(df: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def fold_messages(events: DataFrame) -> DataFrame:
    """``conv_id, seq, role, text, redone`` of every message: its first ``seq``, its final text, and the ``seq`` of its last regeneration."""
    ship(events.sparkSession)
    spelled, conv = _id_type(events)
    schema = pa.schema([("conv_id", conv), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("redone", pa.int64())])
    rank = F.when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).when(F.col("kind") == "delta", 3).otherwise(0)
    log = events.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), "message_id", rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    single = log.where("message_id IS NULL").select("conv_id", "seq", "role", "text", F.lit(None).cast("long").alias("redone"))
    key = ["conv_id", "message_id"]
    order = [*[F.col(k).asc_nulls_first() for k in key], F.col("seq").asc_nulls_first(), "rank", "role", "text"]
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = log.where("message_id IS NOT NULL").repartition(n, *key).sortWithinPartitions(*order)

    def messages(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = start = redone = role = None
        stated, parts = False, None
        for conv_id, seq, message_id, rank, said, text in rows:
            if parts is None or key != (conv_id, message_id):
                if parts is not None:
                    yield key[0], start, role, "".join(parts), redone
                key, start, redone, role, stated, parts = (conv_id, message_id), seq, None, said, False, []
            if rank == 3:
                parts.append(text)
            else:
                parts = [text]
            if rank == 0 and not stated:
                role, stated = said, True
            if rank == 1 and seq is not None:
                redone = seq
        if parts is not None:
            yield key[0], start, role, "".join(parts), redone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(messages(_rows(batches)), schema, 3)

    folded = named.select("conv_id", "seq", "message_id", "rank", "role", "text").mapInArrow(run, f"conv_id {spelled}, seq long, role string, text string, redone long")
    return folded.unionByName(single)


def _in_order(messages: DataFrame) -> DataFrame:
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("seq").asc_nulls_first(), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, seq, role, text`` of an event log, each conversation in one partition and in order."""
    messages = fold_messages(events)
    spelled, conv = _id_type(messages)
    schema = pa.schema([("conv_id", conv), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def kept(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, at, latest, here = object(), None, None, None
        for conv_id, seq, role, text, redone in rows:
            if now != conv_id:
                now, at, latest, here = conv_id, seq, None, None
            if seq != at:  # regenerations of messages that began before this one
                at, latest, here = seq, max((x for x in (latest, here) if x is not None), default=None), None
            if redone is not None and (here is None or redone > here):
                here = redone
            if latest is None or seq is None or seq >= latest:
                yield conv_id, seq, role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(kept(_rows(batches)), schema, 3)

    return _in_order(messages).mapInArrow(run, f"conv_id {spelled}, seq long, role string, text string")


def render(messages: DataFrame, template: Template = Template(), ordered: bool = False) -> DataFrame:
    """Rendered runs: ``conv_id, run, n_turns, start, formatted, loss_starts, loss_ends``.

    A conversation is the ``formatted`` of its runs, one after another. The loss spans are
    code points of ``formatted``, one per trained turn, in order. ``ordered``: the
    messages are in order already, as ``fold_events`` gives them.
    """
    ship(messages.sparkSession)
    spelled, conv = _id_type(messages)
    spans = pa.list_(pa.int64())
    schema = pa.schema([("conv_id", conv), ("run", pa.int64()), ("n_turns", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()), ("loss_starts", spans), ("loss_ends", spans)])

    def runs(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, number, start, shown, size, lo, hi = object(), 0, 0, [], 0, [], []
        for conv_id, role, text in rows:
            role, text = role or "", text or ""
            if shown and (now != conv_id or len(shown) == RUN or size + len(text) > RUN_CHARS):
                yield now, number, len(shown), start, "".join(shown), lo, hi
                number, start, shown, size, lo, hi = number + 1, start + size, [], 0, [], []
            if now != conv_id:
                now, number, start = conv_id, 0, 0
            head, body = template.open + template.escape(role) + template.mid, template.escape(text)
            if role in template.trained_roles:
                lo.append(size + len(head))
                hi.append(size + len(head) + len(body))
            shown.append(head + body + template.close)
            size += len(shown[-1])
        if shown:
            yield now, number, len(shown), start, "".join(shown), lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(runs(_rows(batches)), schema, 4)

    rows = messages if ordered else _in_order(messages)
    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {spelled}, run long, n_turns long, start long, formatted string, loss_starts array<long>, loss_ends array<long>")


def parse(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The turns of a rendered run or conversation, as (role, text)."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(template.open, at):
            raise ValueError(f"no turn at {at}")
        mid = formatted.index(template.mid, at + len(template.open))
        end = formatted.index(template.close, mid + len(template.mid))
        turns.append((template.unescape(formatted[at + len(template.open) : mid]), template.unescape(formatted[mid + len(template.mid) : end])))
        at = end + len(template.close)
    return turns


def digests(rendered: DataFrame, template: Template = Template(), ordered: bool = False) -> DataFrame:
    """Turn and loss digests by conversation, read back from the rendered runs and their loss spans alone.

    Runs pass as a stream, so only the state of the hashes is held. ``ordered``: the
    runs are in order already, as ``render`` gives them.
    """
    ship(rendered.sparkSession)
    spelled, conv = _id_type(rendered)
    schema = pa.schema([("conv_id", conv), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, n, chars, size, every, loss = None, 0, 0, 0, None, None
        for conv_id, start, shown, lo, hi in rows:
            if every is None or now != conv_id:
                if every is not None:
                    yield now, n, every.hexdigest(), chars, loss.hexdigest(), size
                now, n, chars, size, every, loss = conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if start != size:
                raise ValueError(f"a run of conversation {conv_id} is missing before {start}")
            for role, text in parse(shown, template):
                every.update(f"{role}\n{text}\n".encode())
                n += 1
            for a, b in zip(lo, hi, strict=True):
                text = template.unescape(shown[a:b])
                loss.update(text.encode())
                chars += len(text)
            size += len(shown)
        if every is not None:
            yield now, n, every.hexdigest(), chars, loss.hexdigest(), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(read(_rows(batches)), schema, 2)

    n = int(rendered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rendered if ordered else rendered.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "run")
    return rows.select("conv_id", "start", "formatted", "loss_starts", "loss_ends").mapInArrow(
        run, f"conv_id {spelled}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
