"""Packing documents into fixed windows by dynamic programming, order kept.

Tokens of documents in ascending ``doc_id`` order make one stream per range of
ids. A window may end after a document (free), after a sentence
(``SENTENCE_COST``) or, where a sentence is long, every ``HARD_EVERY`` ids in it
(``HARD_COST``). With cut points at ids p and costs c, the best cost of a stream
up to cut j is

    best[j] = c[j] + min over i with p[j] - p[i] <= LENGTH of best[i] + (LENGTH - (p[j] - p[i])),

padding plus penalties; best[i] + p[i] over a sliding range is a monotone queue,
so every cut point enters and leaves it once. A stream is solved a segment at a
time; the open window at a segment's end goes on into the next. The last ids of
a range are cut at powers of two, which need no padding.

Defined results: null text is an empty document, its end id alone; null
``doc_id`` comes first; repeated ids are documents of their own, ordered by
text; a text of any length is encoded and packed whole; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekernel as K
from .common import ship
from .encoding import PieceEncoder

LENGTH = 2048
SENTENCE_COST, HARD_COST, HARD_EVERY = 4, 24, 32
#: Ids solved at a time.
SEGMENT = 1 << 18


def best_cuts(points: np.ndarray, costs: np.ndarray, length: int, tail: bool) -> list[int]:
    """Cut points chosen from ``points`` (ascending, the first is 0), beginning with 0.

    Neighbouring points are at most ``length`` apart. With ``tail`` the last point
    is the last cut; else the cheapest one less than ``length`` before it is.
    """
    p, c = points.tolist(), costs.tolist()
    n = len(p)
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])  # cut points by rising best + point
    value = [0.0] * n
    for j in range(1, n):
        low = p[j] - length
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        b = best[j] = value[i] + length - p[j] + c[j]
        v = value[j] = b + p[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    last = n - 1
    if not tail:
        low = p[-1] - length
        open_ = [j for j in range(n - 1, -1, -1) if p[j] > low]
        last = min(open_, key=lambda j: value[j])
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [p[j] for j in reversed(cuts)]


def powers_of_two(lo: int, hi: int, length: int) -> list[int]:
    """Ends of windows for the ids lo .. hi-1: whole windows, then falling powers of two."""
    out = []
    while lo < hi:
        lo += min(length, 1 << ((hi - lo).bit_length() - 1))
        out.append(lo)
    return out


class Stream:
    """The ids of one range of documents that are not in a closed window yet."""

    def __init__(self, ends_sentence: np.ndarray, length: int = LENGTH):
        self.length, self.ends_sentence = length, ends_sentence
        self.ids: list[np.ndarray] = []
        self.held, self.lead = 0, 0  # ids held; ids of the first document that are gone already
        self.docs: list = []
        self.sizes: list[int] = []
        self.windows = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.held += len(ids)

    def close(self, end: bool) -> dict[str, list] | None:
        """Pieces of the windows that can be closed now; all that is left with ``end``."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        n = len(ids)
        if not n:
            return None
        begins = np.concatenate([[0], np.cumsum(self.sizes)]) - self.lead
        edges = begins[1:]
        sentence = np.flatnonzero(self.ends_sentence[ids]) + 1
        soft = np.union1d(edges, sentence)
        before = np.concatenate([[0], soft[:-1]])
        gap = soft - before
        extra = np.maximum((gap - 1) // HARD_EVERY, 0)
        hard = np.repeat(before, extra) + HARD_EVERY * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        points = np.union1d(np.union1d(soft, hard), [0])
        costs = np.full(len(points), HARD_COST)
        costs[np.searchsorted(points, sentence)] = SENTENCE_COST
        costs[np.searchsorted(points, edges)] = 0
        cuts = best_cuts(points, costs, self.length, False)
        if end:
            cuts = cuts + powers_of_two(cuts[-1], n, self.length)
        out = self._pieces(ids, np.array(cuts), begins)
        done = cuts[-1]
        gone = int(np.searchsorted(edges, done, "right"))
        self.lead = int(done - begins[gone]) if gone < len(self.docs) else 0
        self.docs, self.sizes = self.docs[gone:], self.sizes[gone:]
        self.ids, self.held = [ids[done:]], n - done
        self.windows += len(cuts) - 1
        return out

    def _pieces(self, ids: np.ndarray, cuts: np.ndarray, begins: np.ndarray) -> dict[str, list]:
        at = np.union1d(cuts, begins[(begins > 0) & (begins < cuts[-1])])
        lo, hi = at[:-1], at[1:]
        doc = np.searchsorted(begins, lo, "right") - 1
        window = np.searchsorted(cuts, lo, "right") - 1
        raw = ids.astype("<u4")
        return {
            "doc_id": [self.docs[d] for d in doc.tolist()],
            "start": (lo - begins[doc]).tolist(),
            "length": (hi - lo).tolist(),
            "ids_crc32": [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)],
            "doc_tokens": [self.sizes[d] for d in doc.tolist()],
            "window": (window + self.windows).tolist(),
            "offset": (lo - cuts[window]).tolist(),
        }


def sentence_ends(encoder: PieceEncoder) -> np.ndarray:
    """For each id, whether its token ends with a sentence mark."""
    vocabulary = encoder.tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        out[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = False, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    ``sequence_id`` is the range's number in the high 32 bits and the window's in the low ones.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows of one id (or none) are split by the head of their text, which sorts as the text does; Spark samples the keys to the driver, so they are short.
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer, spaced)
        stream = Stream(sentence_ends(encoder), length)
        base = TaskContext.get().partitionId() << 32
        end = np.array([end_id], np.uint32)

        def batch_of(pieces: dict[str, list]) -> pa.RecordBatch:
            pieces["sequence_id"] = [base + w for w in pieces.pop("window")]
            return pa.RecordBatch.from_arrays([pa.array(pieces[k], pa.int64()) for k in names], names=names)

        for batch in K.trimmed(batches):
            ids_of, at = batch.column(0).to_pylist(), 0
            for ids, count in encoder.encode(batch.column(1)):
                for x in np.split(ids, np.cumsum(count)[:-1]):
                    stream.add(ids_of[at], np.concatenate([x, end]))
                    at += 1
                    if stream.held >= SEGMENT and (pieces := stream.close(False)):
                        yield batch_of(pieces)
        if pieces := stream.close(True):
            yield batch_of(pieces)

    return ordered.mapInArrow(run, ", ".join(f"{k} long" for k in names))
