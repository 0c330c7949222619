"""Language of each word, and of each text, by a linear-chain conditional random field.

A word's features are its n-grams of 2 to ``GRAMS[-1]`` bytes with both ends marked
(so the grams at the ends are its affixes) and the word itself as a lexicon
entry, all hashed. Transitions between the languages of neighbouring words are
learned with them. Labels are per document; for code-switched training text,
stretches of different documents are joined.

Forward-backward is exact for texts of any length: blocks of ``SPAN`` words are
reduced to transfer matrices, messages pass over a text's blocks, and the
marginals follow inside each block. All blocks of a slice move together.

Training reads at most ``PER_LANGUAGE`` labelled documents of each language, a
stretch of ``STRETCH`` characters of each; prediction reads whole texts.

Defined results: ``und`` and score 0 for null texts, for texts without a letter,
and where no row was labelled; null labels are never learned; a null ``doc_id``
is predicted like any other; texts of any length are predicted whole; repeated
rows are predicted alike; ties go to the first language in code-point order; an
empty table gives an empty table; other columns are ignored, or kept by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekernel as K
from .common import ship

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
WORDS = 1 << 15
SPAN = 32
PER_LANGUAGE = 1000
STRETCH = 1000
EPOCHS = 6
#: More labels than this are an error: the model's size goes with their number.
MOST_LANGUAGES = 500


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # (BUCKETS + 1, L), last row zero
    words: np.ndarray  # (WORDS, L)
    moves: np.ndarray  # (L, L) log potentials
    start: np.ndarray  # (L,)


def sliced_words(column: pa.Array):
    """For each slice: lo, hi, bytes, word starts, ends and text numbers."""
    for lo, hi in K.slices(column):
        data, off = K.flat(pc.utf8_lower(pc.fill_null(column.slice(lo, hi - lo), "")))
        start, end, text = K.runs(data, off, K.IS_LETTER)
        yield lo, hi, data, start, end, text


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Distinct words: their hashes, starts, ends, and each word's number among them."""
    h = K.span_hash(data, start, end)
    unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return unique, start[first], end[first], inverse


def emissions(model: Model, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log potentials of each word for each language."""
    framed, off = K.framed(data, start, end)
    score = np.zeros((len(framed), len(model.labels)), np.float32)
    for size in GRAMS:
        score += model.grams[K.gram_buckets(framed, off, size, BUCKETS)]
    total = np.add.reduceat(score, off[:-1], axis=0) if len(start) else score[:0]
    return total + model.words[(hashes % np.uint64(WORDS)).astype(np.int64)]


def marginals(e: np.ndarray, text: np.ndarray, n_texts: int, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum over each text's words of the posterior of every language: (n_texts, L).

    ``e``: log potentials of all words; ``text``: their texts, ascending.
    """
    L, n = e.shape[1], len(e)
    total = np.zeros((n_texts, L))
    if not n:
        return total
    a = np.exp(moves - moves.max())
    e = np.exp(np.clip(e - e.max(1, keepdims=True), -40, 0)).astype(np.float64)
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    words = np.diff(bounds)
    per_text = -(-words // SPAN)
    first_block = np.concatenate([[0], np.cumsum(per_text)])
    b = first_block[-1]
    block_text = np.repeat(np.arange(n_texts), per_text)
    nth = np.arange(b) - first_block[block_text]
    begin = bounds[block_text] + nth * SPAN
    size = np.minimum(SPAN, bounds[block_text + 1] - begin)
    order = np.argsort(-size, kind="stable")  # blocks by falling size: step t works on a leading part
    begin, size = begin[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, SPAN + 1), "right")
    rank = np.empty(b, np.int64)
    rank[order] = np.arange(b)
    # A text's first word has no transition into it.
    opens = (nth == 0)[order]
    # 1. Each block's transfer matrix.
    m = np.broadcast_to(np.eye(L), (b, L, L)).copy()
    for t in range(SPAN):
        k = active[t]
        if not k:
            break
        moved = (m[:k].reshape(-1, L) @ a).reshape(k, L, L)
        if t == 0:
            moved[opens] = m[opens]
        step = moved * e[begin[:k] + t][:, None, :]
        m[:k] = step / step.max(axis=(1, 2), keepdims=True)
    # 2. Messages into each block, over the blocks of a text.
    into = np.empty((b, L))
    out = np.empty((b, L))
    deepest = int(per_text.max())
    texts = np.argsort(-per_text, kind="stable")
    depth = np.searchsorted(-per_text[texts], -np.arange(1, deepest + 1), "right")
    v = np.broadcast_to(np.exp(start - start.max()), (n_texts, L)).copy()
    for k in range(deepest):
        at = rank[first_block[texts[: depth[k]]] + k]
        into[at] = v[: depth[k]]
        nxt = np.einsum("ij,ijk->ik", v[: depth[k]], m[at])
        v[: depth[k]] = nxt / nxt.sum(1, keepdims=True)
    v = np.ones((n_texts, L))
    for k in range(deepest - 1, -1, -1):
        who = texts[: depth[k]]
        at = rank[first_block[who] + k]
        out[at] = v[: depth[k]]
        nxt = np.einsum("ijk,ik->ij", m[at], v[: depth[k]])
        v[: depth[k]] = nxt / nxt.sum(1, keepdims=True)
    # 3. Marginals inside the blocks.
    forward = np.empty((SPAN, b, L))
    v = into
    for t in range(SPAN):
        k = active[t]
        if not k:
            break
        v = (np.where(opens[:, None], v, v @ a) if t == 0 else v[:k] @ a) * e[begin[:k] + t]
        v /= v.sum(1, keepdims=True)
        forward[t, :k] = v
    summed = np.zeros((b, L))
    back = out.copy()
    for t in range(SPAN - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        post = forward[t, :k] * back[:k]
        summed[:k] += post / post.sum(1, keepdims=True)
        nxt = (back[:k] * e[begin[:k] + t]) @ a.T
        back[:k] = nxt / nxt.sum(1, keepdims=True)
    by_block = summed[rank]
    for c in range(L):
        total[:, c] = np.bincount(block_text, by_block[:, c], n_texts)
    return total


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Train by gradient of the conditional log-likelihood on code-switched sequences of labelled stretches."""
    labels = sorted(set(langs))
    L = len(labels)
    model = Model(labels, np.zeros((BUCKETS + 1, L), np.float32), np.zeros((WORDS, L), np.float32), np.zeros((L, L)), np.zeros(L))
    if L < 2:
        return model
    column = pa.array(texts, pa.large_string())
    rng = np.random.default_rng(seed)
    words, owner, grams, gram_word = [], [], [], []
    for lo, _, data, start, end, text in sliced_words(column):
        unique, s, t, inverse = distinct(data, start, end)
        framed, off = K.framed(data, s, t)
        base = sum(len(w) for w in words)
        at = np.repeat(np.arange(len(s)), np.diff(off))
        for size in GRAMS:
            g = K.gram_buckets(framed, off, size, BUCKETS)
            grams.append(g[g < BUCKETS].astype(np.int32))
            gram_word.append((at[g < BUCKETS] + base).astype(np.int32))
        words.append(unique)
        owner.append((text + lo, inverse + base))
    bucket, of_word = np.concatenate(grams), np.concatenate(gram_word)
    order = np.argsort(of_word, kind="stable")
    bucket, of_word = bucket[order], of_word[order]
    lexicon = (np.concatenate(words) % np.uint64(WORDS)).astype(np.int64)
    doc = np.concatenate([x for x, _ in owner])
    word = np.concatenate([y for _, y in owner])
    gold_of = np.array([labels.index(x) for x in langs])
    # Sequences of T words: stretches of 4 to T words of one document, then of another.
    T = 24
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    by_label = [np.flatnonzero((gold_of == c) & (np.diff(bounds) >= 4)) for c in range(L)]
    usable = [c for c in range(L) if len(by_label[c])]
    if not usable:
        return model
    squares = [np.full_like(x, 1e-6) for x in (model.grams, model.words, model.moves, model.start)]
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for _ in range(16):
            n_seq = 256
            seq, gold = np.empty((n_seq, T), np.int64), np.empty((n_seq, T), np.int64)
            for i in range(n_seq):
                at = 0
                while at < T:
                    c = usable[rng.integers(len(usable))]
                    d = by_label[c][rng.integers(len(by_label[c]))]
                    take = min(T - at, int(rng.integers(4, T)), bounds[d + 1] - bounds[d])
                    lo = bounds[d] + rng.integers(0, bounds[d + 1] - bounds[d] - take + 1)
                    seq[i, at : at + take] = word[lo : lo + take]
                    gold[i, at : at + take] = c
                    at += take
            used, local = np.unique(seq, return_inverse=True)
            local = local.reshape(seq.shape)
            lo, hi = np.searchsorted(of_word, used), np.searchsorted(of_word, used, "right")
            size = hi - lo
            flat = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            b = bucket[flat].astype(np.int64)
            who = np.repeat(np.arange(len(used)), size)
            w = model.words[lexicon[used]].astype(float)
            for c in range(L):
                w[:, c] += np.bincount(who, model.grams[b, c], len(used))
            e = w[local]  # (n_seq, T, L)
            post, pair, first = _posteriors(e, model.moves, model.start)
            hot = np.eye(L)
            g_e = hot[gold] - post
            g_moves = sum(np.einsum("ni,nj->ij", hot[gold[:, t]], hot[gold[:, t + 1]]) for t in range(T - 1)) - pair
            g_start = hot[gold[:, 0]].sum(0) - first
            g_word = np.zeros((len(used), L))
            for c in range(L):
                g_word[:, c] = np.bincount(local.ravel(), g_e[..., c].ravel(), len(used))
            g_gram = np.zeros((BUCKETS + 1, L), np.float32)
            for c in range(L):
                g_gram[:, c] = np.bincount(b, g_word[who, c], BUCKETS + 1)
            g_lex = np.zeros((WORDS, L), np.float32)
            np.add.at(g_lex, lexicon[used], g_word)
            for x, g, sq, scale in ((model.grams, g_gram, squares[0], 0.2), (model.words, g_lex, squares[1], 0.2), (model.moves, g_moves, squares[2], 1.0), (model.start, g_start, squares[3], 1.0)):
                g = g / n_seq
                sq += g * g
                x += (rate * scale * g / np.sqrt(sq)).astype(x.dtype)
            model.grams[BUCKETS] = 0
    return model


def _posteriors(e: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """Marginals, summed pair marginals and summed first marginals of equally long sequences."""
    n, T, L = e.shape
    a = np.exp(moves)
    p = np.exp(e - e.max(2, keepdims=True))
    f, scale = np.empty((T, n, L)), np.empty((T, n, 1))
    v = np.exp(start)[None] * p[:, 0]
    for t in range(T):
        if t:
            v = (f[t - 1] @ a) * p[:, t]
        scale[t] = v.sum(1, keepdims=True)
        f[t] = v / scale[t]
    back = np.ones((n, L))
    post = np.empty((n, T, L))
    pair = np.zeros((L, L))
    for t in range(T - 1, -1, -1):
        post[:, t] = f[t] * back / (f[t] * back).sum(1, keepdims=True)
        if t:
            right = p[:, t] * back / scale[t]
            pair += a * np.einsum("ni,nj->ij", f[t - 1], right)
            back = right @ a.T
    return post, pair, post[:, 0].sum(0)


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_LANGUAGES) -> tuple[list[str], list[str]]:
    """At most ``per_language`` stretches for each language: the rows with the smallest hashes.

    Of more than ``most`` labels those with the most rows are learned, and of equally frequent ones the first by name: a bound
    of the fitted model, as ``per_language`` is. Texts of other labels are predicted like all others.
    Returns to the driver (number of languages) * ``per_language`` * ``STRETCH`` characters at most, about.
    """
    # One number per language, as the model itself has: the filter needs no join, so texts are not shuffled.
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per_language / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("lang")))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - STRETCH, F.lit(1))) + 1
    stretch = F.substring(F.col("text"), begin.cast("int"), F.lit(STRETCH))
    # Rows that repeat an id count once, so that they cannot crowd the driver.
    rows = drawn.groupBy("lang", "place", "doc_id").agg(F.min(stretch).alias("text")).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"], r["text"])):
        if len(by.setdefault(r["lang"], [])) < per_language:
            by[r["lang"]].append(r["text"])
    return [t for x in by.values() for t in x], [k for k, x in by.items() for _ in x]


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` and the language and score under the names ``out`` for every row; the model is a broadcast of fixed size."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*columns) if "text" in columns else docs.select(*columns, "text")
    at = kept.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in columns) + f", `{out[0]}` string, `{out[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in K.trimmed(batches):
            column = batch.column(at).cast(pa.large_string())
            letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            sums = np.zeros((len(column), max(1, len(model.labels))))
            for lo, hi, data, start, end, text in sliced_words(column):
                if model.labels and len(start):
                    hashes, s, t, inverse = distinct(data, start, end)
                    e = emissions(model, hashes, data, s, t)[inverse]
                    sums[lo:hi] = marginals(e, text, hi - lo, model.moves, model.start)
            n = sums.sum(1)
            best = sums.argmax(1)
            known = letter & (n > 0)
            names = np.array([*model.labels, "und"], dtype=object)
            pred = names[np.where(known, best, len(model.labels))]
            score = np.where(known, sums[np.arange(len(best)), best] / np.maximum(n, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(columns))] + [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*columns, *out]
            )

    return kept.mapInArrow(run, schema)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows of ``docs`` that have text and ``lang``."""
    return fit(*training_sample(docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"), per_language))
