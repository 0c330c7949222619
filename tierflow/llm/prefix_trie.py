"""The trie of conversations' prefixes, by range minima over sorted common prefixes.

1. Turns are dealt by conversation family, sorted and folded one by one. What is kept of a turn is a digest
   of all turns up to it, so that two conversations share a prefix exactly where they share
   its digest, and the code points of its text.
2. A conversation is cut into bands of ``BAND`` turns. A row is one conversation's band: the digest
   before it (the head), and the digests in it. Rows are sorted by ranges of (band, head,
   digests, conversation), so that the members of a prefix are neighbours; a common prefix
   or a common conversation is cut like any other stretch.
3. In a range, ``lcp[i]`` is what row i shares with the row before. A sparse table of range minima
   over it answers, for every prefix at once, two independent binary searches: how far
   left and how far right all rows share it. Members, smallest member and children follow
   from the interval; nothing is walked in order and there is no stack.
4. Prefixes whose interval meets an end of its range, or which end a band, are put together by
   their digest; all others are done.
5. Sums over a subtree are sums over its members. Each node's saving belongs to its smallest
   member. The nodes that a conversation owns are the last ones of its path, so a
   subtree's sum is that of all its members' savings without what its smallest
   member owns above it. Running sums over the ranges of step 2 give the members' sums.

A task holds one range, or the state of one conversation while its turns pass.

Defined results: turns of a conversation with equal ``turn`` are ordered by role, then by digest;
repeated rows are turns of their own; null role or text counts as empty; rows
without ``conv_id`` are no conversation and are left out; an empty table gives an
empty table; texts and conversations of any length are whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .common import discard, materialize, ship

#: Conversations that share the head of one, and the most turns that they can share.
FAMILY, HEADS = 100, 6
#: Turns of a band, and bytes of a digest. Spark samples bands to the driver to find the ranges, so they are short.
BAND, WIDTH = 16, 16
#: The root's digest.
ROOT = bytes(WIDTH)
#: Decimal ids that are hashed at a time where a node's ends go over several ranges.
CHUNK = 4096


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def extended(before: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(before + turn, digest_size=WIDTH).digest()


_ROWS = pa.schema([("band", pa.int32()), ("head", pa.binary()), ("digests", pa.binary()), ("conv_id", pa.int64()), ("ends", pa.bool_()), ("chars", pa.binary())])


def bands(turns: DataFrame) -> DataFrame:
    """Rows ``band, head, digests, conv_id, ends, chars`` of the rebuilt conversations of ``turns(conv_id, turn, role, text)``."""
    ship(turns.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    conv = F.col("conv_id").cast("long")
    family = conv - conv % FAMILY
    rows = turns.where("conv_id IS NOT NULL").select(family.alias("family"), (conv != family).alias("other"), conv.alias("conv_id"), "turn", role.alias("role"), said.alias("said"), F.length(text).cast("long").alias("chars"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["family", "other", "conv_id", F.col("turn").asc_nulls_first(), "role", "said"]
    dealt = rows.repartition(n, "family").sortWithinPartitions(*order).select("family", "conv_id", "said", "chars")

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The first of a family comes before the others, and leaves its first turns to them."""
        family, head, now = None, [], None
        for batch in batches:
            for f, c, said, chars in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if f != family:
                    family, head = f, []
                if now is None or c != now.conv_id:
                    if now is not None:
                        yield from now.close()
                    now = _Path(c)
                    for turn in [] if c == f else head[: now.shared]:
                        yield from now.add(*turn)
                if c == f and len(head) < HEADS:
                    head.append((said, chars))
                now.own += 1
                if c == f or now.own > now.shared:
                    yield from now.add(said, chars)
        if now is not None:
            yield from now.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in conversations(batches):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, _ROWS)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ROWS)

    return dealt.mapInArrow(run, from_arrow_schema(_ROWS))


class _Path:
    """A conversation's bands while its turns come in."""

    def __init__(self, conv_id: int):
        self.conv_id, self.shared, self.own = conv_id, shared_turns(conv_id), 0
        self.band, self.head, self.last = 0, ROOT, ROOT
        self.digests: list[bytes] = []
        self.chars: list[int] = []

    def _row(self, ends: bool) -> dict:
        return {"band": self.band, "head": self.head, "digests": b"".join(self.digests), "conv_id": self.conv_id, "ends": ends, "chars": np.array(self.chars, np.int64).tobytes()}

    def add(self, said: bytes, chars: int) -> Iterator[dict]:
        if len(self.digests) == BAND:
            yield self._row(False)
            self.band, self.head, self.digests, self.chars = self.band + 1, self.last, [], []
        self.last = extended(self.last, said)
        self.digests.append(self.last)
        self.chars.append(chars)

    def close(self) -> Iterator[dict]:
        yield self._row(True)


# --- intervals of a range -----------------------------------------------------------------------------


class RangeMinima:
    """Minima of stretches of powers of two of an array, and searches on them."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``at`` are at least ``least``."""
        end = at + 1
        for k in range(len(self.levels) - 1, -1, -1):
            fits = end + (1 << k) <= self.n
            fits[fits] = self.levels[k][end[fits]] >= least[fits]
            end = end + (fits.astype(np.int64) << k)
        return end - 1

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which on all values after it up to ``at`` are at least ``least``."""
        begin = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = begin - (1 << k) >= 0
            fits[fits] = self.levels[k][begin[fits] - (1 << k) + 1] >= least[fits]
            begin = begin - (fits.astype(np.int64) << k)
        return begin


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Digests that two bands share from the front; where they differ once, they differ on."""
    n = min(len(a), len(b))
    return int((a[:n] == b[:n]).all(axis=1).sum()) if n else 0


_NODES = pa.schema(
    [
        ("kind", pa.string()),
        ("part", pa.int32()),
        ("lo", pa.int64()),
        ("hi", pa.int64()),
        ("id", pa.binary()),
        ("parent", pa.binary()),
        ("above", pa.int64()),
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_ends", pa.int64()),
        ("chars", pa.int64()),
        ("counted", pa.bool_()),
        ("ends", pa.binary()),
    ]
)


def range_nodes(rows: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """The prefixes of one sorted range.

    Rows of ``kind`` done are whole nodes; cut ones have to be put together with other ranges'; member rows
    say where in the range a conversation's row is; ends rows hold pieces of a cut node's ends.
    """
    band, size, conv, ends, new = [], [], [], [], []
    digests, chars, lcp = bytearray(), bytearray(), []
    heads: list[bytes] = []
    before = None
    for batch in rows:
        for b, head, own, c, e, said in zip(*[batch.column(k).to_pylist() for k in _ROWS.names], strict=True):
            now = np.frombuffer(own, np.uint8).reshape(-1, WIDTH)
            same = before is not None and before[:2] == (b, head)
            lcp.append(common_prefix(before[2], now) if same else -1)
            if not same:
                new.append(len(band))
                heads.append(head)
            before = b, head, now
            band.append(b)
            size.append(len(now))
            conv.append(c)
            ends.append(e)
            digests += own
            chars += said
    n = len(band)
    if not n:
        return
    band_, size_, conv_, lcp_ = np.array(band, np.int64), np.array(size, np.int64), np.array(conv, np.int64), np.array(lcp, np.int64)
    ends_ = np.array(ends)
    first_digest = np.concatenate([[0], np.cumsum(size_)])
    hash_ = np.frombuffer(bytes(digests), np.uint8).reshape(-1, WIDTH)
    said_ = np.frombuffer(bytes(chars), np.int64)
    table = RangeMinima(lcp_.astype(np.int8))

    # Candidates: the prefixes that a row does not share with the row before; of a first row also the empty one.
    count = size_ - lcp_
    at = np.repeat(np.arange(n), count)
    depth = np.repeat(lcp_ + 1 - (np.cumsum(count) - count), count) + np.arange(len(at))
    lo, hi = table.left(at, depth), table.right(at, depth)
    # A candidate's parent: the empty prefix of its head, or the prefix one shorter, wherever that began.
    key = at * (BAND + 1) + depth  # ascending
    up = np.where(depth > 0, np.searchsorted(key, table.left(at, np.maximum(depth - 1, 0)) * (BAND + 1) + depth - 1), -1)
    counted = lo > 0
    children = np.bincount(up[(depth > 0) & counted], minlength=len(at))
    low = np.minimum.reduceat(np.append(conv_, np.iinfo(np.int64).max), np.stack([lo, hi + 1], 1).ravel())[::2]
    exact = _exact_ends(size_, lo, hi, depth)
    ending = np.concatenate([[0], np.cumsum(ends_)])
    n_ends = ending[exact] - ending[lo]
    group = np.searchsorted(np.array(new), at, "right") - 1
    linked = (depth == 0) & (band_[at] > 0)  # the last node of the band before, whose own row that band gives
    cut = (lo == 0) | (hi == n - 1) | (depth == BAND) | linked
    known = (up >= 0) & ~cut[up]  # the parent's smallest member
    digest = first_digest[at] + depth - 1

    for a in range(0, len(at), 8192):
        held = []
        for i in range(a, min(a + 8192, len(at))):
            d, first, past = int(depth[i]), int(lo[i]), int(exact[i])
            head, deep = heads[group[i]], int(band_[at[i]]) * BAND + d
            own = hash_[digest[i]].tobytes() if d else head
            row = {"kind": "cut" if cut[i] else "done", "id": own, "depth": deep, "n_convs": 0, "n_children": int(children[i]), "n_ends": 0, "chars": 0, "counted": False}
            if not linked[i]:
                row |= {
                    "part": part,
                    "lo": first,
                    "hi": int(hi[i]),
                    "parent": None if not d else head if d == 1 else hash_[digest[i] - 1].tobytes(),
                    "above": int(low[up[i]]) if known[i] else None,
                    "conv_id": int(low[i]),
                    "n_convs": int(hi[i]) - first + 1,
                    "n_ends": int(n_ends[i]),
                    "chars": int(said_[digest[i]]) if d else 0,
                    "counted": bool(counted[i]),
                }
                if not cut[i]:
                    row["ends"] = hashlib.sha256(_listed(conv_[first:past][ends_[first:past]])).digest()
                elif n_ends[i]:
                    for k in range(first, past, CHUNK):
                        stretch = slice(k, min(k + CHUNK, past))
                        if ends_[stretch].any():
                            held.append({"kind": "ends", "part": part, "lo": k, "id": own, "ends": _listed(conv_[stretch][ends_[stretch]])})
            held.append(row)
        yield pa.RecordBatch.from_pylist(held, _NODES)
    for a in range(0, n, 8192):
        m = min(a + 8192, n) - a
        none = {f.name: pa.nulls(m, f.type) for f in _NODES}
        none |= {"kind": pa.array(["member"] * m), "part": pa.array([part] * m, pa.int32()), "lo": pa.array(np.arange(a, a + m)), "conv_id": pa.array(conv_[a : a + m])}
        yield pa.RecordBatch.from_arrays([none[f.name] for f in _NODES], schema=_NODES)


def _exact_ends(size: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where in the interval lo .. hi the rows of ``depth`` digests end; they are its first, since a prefix sorts before what it begins."""
    change = np.flatnonzero(np.append(size[1:] != size[:-1], True)) + 1
    return np.where(size[lo] == depth, np.minimum(change[np.searchsorted(change, lo, "right")], hi + 1), lo)


def _listed(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


# --- the whole trie -----------------------------------------------------------------------------------


def _ends_digests(pieces: DataFrame, n: int) -> DataFrame:
    """``id, ends`` of nodes whose ends lie in several ranges: the pieces of each pass in order, and only the hash's state is held."""
    schema = pa.schema([("id", pa.binary()), ("ends", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = state = None
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if state is not None:
                        yield {"id": now, "ends": state.digest()}
                    now, state = node, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if state is not None:
            yield {"id": now, "ends": state.digest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in hashed(batches):
            yield pa.RecordBatch.from_pylist([row], schema)

    dealt = pieces.repartition(n, "id").sortWithinPartitions("id", "part", "lo")
    return dealt.select("id", "ends").mapInArrow(run, from_arrow_schema(schema))


def _merged(cut: DataFrame, pieces: DataFrame, n: int) -> DataFrame:
    """The nodes that several ranges, or two bands, have parts of."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children")]
    nodes = materialize(cut.groupBy("id").agg(*sums, *[F.max(c).alias(c) for c in ("depth", "parent", "above", "chars", "counted")], F.min("conv_id").alias("conv_id")), "cut")
    # A child that begins with its range was not counted there, since it may go on from the range before.
    late = nodes.where("NOT counted AND parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("late"))
    whole = nodes.join(late, "id", "left").join(_ends_digests(pieces, n), "id", "left")
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    out = whole.withColumns({"n_children": F.col("n_children") + F.coalesce("late", F.lit(0)), "ends": F.coalesce("ends", nothing)}).drop("late", "counted")
    out = materialize(out, "merged")
    discard(nodes)
    return out


def _member_sums(intervals: DataFrame, members: DataFrame) -> DataFrame:
    """``intervals`` with ``saved, leaves``: the sums of its members' ``owned`` and ``childless``, range by range."""
    schema = pa.schema([*to_arrow_schema(intervals.schema), ("saved", pa.int64()), ("leaves", pa.int64())])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["lo"].to_numpy())
        lo, hi = left["lo"].to_numpy(), left["hi"].to_numpy()
        for name, out in (("owned", "saved"), ("childless", "leaves")):
            running = np.concatenate([[0], np.cumsum(right[name].to_numpy()[order])])
            left = left.append_column(out, pa.array(running[hi + 1] - running[lo]))
        return left.cast(schema)

    return intervals.groupBy("part").cogroup(members.groupBy("part")).applyInArrow(summed, from_arrow_schema(schema))


def trie(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every distinct prefix of the rebuilt conversations."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(bands(turns), "bands")
    keys = ["band", "head", "digests", "conv_id"]
    ranges = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    found = materialize(ranges.mapInArrow(lambda batches: range_nodes(batches, TaskContext.get().partitionId()), from_arrow_schema(_NODES)), "prefixes")
    discard(rows)
    cut = found.where("kind = 'cut'")
    merged = _merged(cut, found.where("kind = 'ends'").select("id", "part", "lo", "ends"), n)

    names = ["id", "part", "lo", "hi", "depth", "conv_id", "above", "n_convs", "n_children", "chars", "ends"]
    none = {c: F.lit(None).cast("long").alias(c) for c in ("lo", "hi")} | {"part": F.lit(None).cast("int").alias("part")}
    every = found.where("kind = 'done'").select(*names, "parent").unionByName(merged.select(*[none.get(c, F.col(c)) for c in names], "parent"))
    # A parent that was cut has its smallest member only now.
    asked = every.where("above IS NULL AND parent IS NOT NULL").drop("above").join(merged.select(F.col("id").alias("parent"), F.col("conv_id").alias("above")), "parent")
    nodes = materialize(every.where("above IS NOT NULL OR parent IS NULL").select(*names).unionByName(asked.select(*names)), "nodes")

    saving = (F.col("n_convs") - 1) * F.col("chars")
    owned = nodes.groupBy("conv_id").agg(F.sum(saving).alias("owned"), F.count_if(F.col("n_children") == 0).alias("childless"))
    members = found.where("kind = 'member'").select("part", "lo", "conv_id").join(owned, "conv_id", "left")
    members = members.select("part", "lo", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("childless", F.lit(0)).alias("childless"))
    whole = nodes.where("part IS NOT NULL")
    parts = cut.where("part IS NOT NULL").select("id", "part", "lo", "hi", *[F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in names[4:]])
    summed = materialize(_member_sums(whole.unionByName(parts), members), "sums")
    # Parts have no depth of their own.
    joined = summed.where("depth IS NULL").groupBy("id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    complete = summed.where("depth IS NOT NULL").unionByName(nodes.where("part IS NULL").join(joined, "id").select(*summed.columns))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    complete = complete.withColumn("before", F.coalesce(F.sum(saving).over(above), F.lit(0)))
    out = complete.select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("before")).alias("saved_tokens"),
        F.lower(F.hex("ends")).alias("ends_sha256"),
    )
    out = materialize(out, "trie")
    discard(found, merged, nodes, summed)
    return out
