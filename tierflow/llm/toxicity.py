"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two parts: a learned vector of the word itself and the mean of
learned vectors of its byte n-grams (both hashed). Two gated recurrent units
read a window of ``WINDOW`` words forwards and backwards, attention pools their
states, and a logistic unit scores the window. A text's score is that of its
highest window; a window starts at every word that has ``WINDOW`` words from it
on, so the score does not depend on where in the text a passage stands.

Training is back-propagation through time in numpy. Labels are per document,
so each round a toxic document teaches by its highest window, a clean one by
its highest and a random one. While the network knows nothing yet (the first
``GUIDED`` rounds), the windows are chosen by the log odds of words and n-grams
between the classes instead; these are no inputs. At most ``PER_CLASS`` whole
documents and ``CHARACTERS`` characters of each class are read for training;
scoring reads whole texts.

Defined results: null and empty texts score as an empty window (below the
threshold); texts of any length are scored whole; a null ``doc_id`` is scored
and never learned from; repeated rows score alike, and count once in training;
an empty table gives an empty table; with no label, or one class only, every
text scores that class's share; other columns are ignored, or kept by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekernel as K
from .common import ship
from .langid import distinct, sliced_words

WINDOW = 8
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
WORDS = 1 << 16
DIM = 8
HIDDEN = 6
PER_CLASS = 1000
CHARACTERS = 6_000_000
EPOCHS = 10
#: Rounds in which counted evidence chooses the windows to learn from.
GUIDED = 6
#: Training steps at least; small samples go round more often, in smaller batches.
LEAST_STEPS = 200
#: A feature is evidence from this share of the toxic training documents on (and from three).
LEAST_SHARE = 0.02
THRESHOLD = 0.3
#: Windows of a training step, and windows scored at once (so many that they stay in the cache).
BATCH, CHUNK = 256, 2048


@dataclass
class Model:
    gram_vectors: np.ndarray  # (BUCKETS + 1, DIM)
    word_vectors: np.ndarray  # (WORDS, DIM)
    w: dict[str, np.ndarray]
    constant: float | None = None


def word_inputs(model: Model, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Input vectors of distinct words: word vector and mean gram vector."""
    framed, off = K.framed(data, start, end)
    n = np.diff(off)
    sums = np.zeros((len(framed), DIM), np.float32)
    for size in GRAMS:
        sums += model.gram_vectors[K.gram_buckets(framed, off, size, BUCKETS)]
    grams = np.add.reduceat(sums, off[:-1], axis=0) / n[:, None]
    return np.concatenate([model.word_vectors[(hashes % np.uint64(WORDS)).astype(np.int64)], grams], axis=1).astype(np.float32)


INPUT = 2 * DIM


def windows(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word place of every window, and its text; a text of fewer words than a window has one, empty without words."""
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    n = np.diff(bounds)
    count = np.maximum(1, n - WINDOW + 1)
    owner = np.repeat(np.arange(n_texts), count)
    first = bounds[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return first, np.minimum(first + WINDOW, bounds[owner + 1]), owner


def window_words(word: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of each window's words, -1 past its end."""
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], np.append(word, -1)[np.minimum(at, len(word))], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (T, n, HIDDEN) from gate inputs x (T, n, 3 HIDDEN); ``trace`` gets what the backward pass needs."""
    T, n, _ = x.shape
    H = HIDDEN
    h = np.zeros((n, H), np.float32)
    out = np.empty((T, n, H), np.float32)
    for t in range(T):
        a = h @ u
        zr = _sigmoid(x[t, :, : 2 * H] + a[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(x[t, :, 2 * H :] + r * a[:, 2 * H :])
        new = (c + z * (h - c)) * mask[t]
        if trace is not None:
            trace.append((h, z, r, c, a[:, 2 * H :]))
        h = out[t] = new
    return out


def logits(model: Model, gates: np.ndarray, index: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logit of every window; ``gates``: rows of both directions' gate inputs for each word, the last row for padding."""
    w, H = model.w, HIDDEN
    T = index.shape[1]
    at = index.T
    mask = (at >= 0).astype(np.float32)[:, :, None]
    x = gates[at]  # -1 takes the padding row
    fx, bx = x[:, :, : 3 * H], x[::-1, :, 3 * H :]
    ft, bt = ([], []) if trace is not None else (None, None)
    hf = _gru(fx, mask, w["uf"], ft)
    hb = _gru(bx, mask[::-1], w["ub"], bt)[::-1]
    h = np.concatenate([hf, hb], axis=2)  # (T, n, 2H)
    s = h @ w["att"] + (mask[:, :, 0] - 1) * 30
    s = np.exp(s - s.max(0))
    alpha = s / s.sum(0)
    pooled = np.einsum("tn,tnk->nk", alpha, h)
    if trace is not None:
        trace.update(ft=ft, bt=bt, h=h, alpha=alpha, pooled=pooled, mask=mask, at=at, T=T)
    return pooled @ w["out"] + w["bias"][0]


def sweep(model: Model, gates: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Logit of the full window from every start in a stretch of words: ``logits`` without padding.

    Step t of all windows reads one slice of the stretch. Gates are halved, so
    that the logistic function is a hyperbolic tangent, and of the states only
    their attention and their output are kept.
    """
    w, H = model.w, HIDDEN
    n = len(word) - WINDOW + 1
    halved = np.repeat(np.array([0.5, 0.5, 1, 0.5, 0.5, 1], np.float32), H)
    x = np.ascontiguousarray((gates[word] * halved).T)
    seen = np.zeros((WINDOW, 2, n), np.float32)
    a, h, d = np.empty((3 * H, n), np.float32), np.empty((H, n), np.float32), np.empty((H, n), np.float32)
    for side, order in enumerate((range(WINDOW), range(WINDOW - 1, -1, -1))):
        gate = x[3 * H * side : 3 * H * (side + 1)]
        u = np.ascontiguousarray(w["uf" if side == 0 else "ub"].T) * np.float32(0.5)
        read = np.stack([w["att"][H * side : H * (side + 1)], w["out"][H * side : H * (side + 1)]])
        h[:] = 0
        for t in order:
            np.matmul(u, h, out=a)
            zr, c = a[: 2 * H], a[2 * H :]
            zr += gate[: 2 * H, t : t + n]
            np.tanh(zr, out=zr)
            zr += 1
            c *= zr[H:]
            c += gate[2 * H :, t : t + n]
            np.tanh(c, out=c)
            np.subtract(h, c, out=d)
            d *= zr[:H]
            d *= np.float32(0.5)
            np.add(c, d, out=h)
            seen[t] += read @ h
    e = seen[:, 0]
    e = np.exp(e - e.max(0))
    return (e * seen[:, 1]).sum(0) / e.sum(0) + w["bias"][0]


def window_logits(model: Model, gates: np.ndarray, word: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Logit of every window; ``word``: the gate row of each word, in order, as ``first`` is."""
    out = np.empty(len(first), np.float32)
    full, short = np.flatnonzero(end - first == WINDOW), np.flatnonzero(end - first < WINDOW)
    at = first[full]
    for a in range(0, len(word) - WINDOW + 1, CHUNK):
        some = slice(*np.searchsorted(at, [a, a + CHUNK]))
        if some.start < some.stop:
            lo, hi = at[some.start], at[some.stop - 1]
            out[full[some]] = sweep(model, gates, word[lo : hi + WINDOW])[at[some] - lo]
    for a in range(0, len(short), CHUNK):
        some = short[a : a + CHUNK]
        out[some] = logits(model, gates, window_words(word, first[some], end[some]))
    return out


def gate_rows(model: Model, x: np.ndarray) -> np.ndarray:
    """Gate inputs of both directions for each word, and a padding row."""
    w = model.w
    both = np.concatenate([x @ w["wf"] + w["bf"], x @ w["wb"] + w["bb"]], axis=1)
    return np.concatenate([both, np.zeros((1, both.shape[1]), np.float32)]).astype(np.float32)


def _gru_back(g: np.ndarray, trace: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u`` from those of the states."""
    T, n, H = g.shape
    gx = np.empty((T, n, 3 * H), np.float32)
    gu = np.zeros_like(u)
    carry = np.zeros((n, H), np.float32)
    for t in range(T - 1, -1, -1):
        h, z, r, c, a = trace[t]
        d = (g[t] + carry) * mask[t]
        dz = d * (h - c) * z * (1 - z)
        dc = d * (1 - z) * (1 - c * c)
        dr = dc * a * r * (1 - r)
        gx[t] = np.concatenate([dz, dr, dc], axis=1)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        gu += h.T @ da
        carry = d * z + da @ u.T
    return gx, gu


def gradients(model: Model, gates: np.ndarray, index: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss, gradients of the dense weights but the input ones, and of ``gates``."""
    w, H, tr = model.w, HIDDEN, {}
    p = _sigmoid(logits(model, gates, index, tr))
    n = len(label)
    loss = -float(np.mean(label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9)))
    d = ((p - label) / n).astype(np.float32)
    g = {"out": tr["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
    dp = d[:, None] * w["out"][None]
    alpha, h = tr["alpha"], tr["h"]
    dh = alpha[:, :, None] * dp[None]
    da = np.einsum("nk,tnk->tn", dp, h)
    ds = alpha * (da - (alpha * da).sum(0))
    g["att"] = np.einsum("tn,tnk->k", ds, h)
    dh = dh + ds[:, :, None] * w["att"]
    gf, g["uf"] = _gru_back(dh[:, :, :H], tr["ft"], tr["mask"], w["uf"])
    gb, g["ub"] = _gru_back(dh[::-1, :, H:], tr["bt"], tr["mask"][::-1], w["ub"])
    both = np.concatenate([gf, gb[::-1]], axis=2) * tr["mask"]
    flat, at = both.reshape(-1, 6 * H), tr["at"].ravel() % len(gates)
    dg = np.stack([np.bincount(at, flat[:, k], len(gates)) for k in range(6 * H)], axis=1).astype(np.float32)
    return loss, g, dg


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    H = HIDDEN

    def small(*shape):
        return (rng.standard_normal(shape) * 0.2).astype(np.float32)

    w = {"wf": small(INPUT, 3 * H), "wb": small(INPUT, 3 * H), "bf": np.zeros(3 * H, np.float32), "bb": np.zeros(3 * H, np.float32), "uf": small(H, 3 * H), "ub": small(H, 3 * H), "att": small(2 * H), "out": small(2 * H), "bias": np.array([-2.0], np.float32)}
    model = Model(small(BUCKETS + 1, DIM), small(WORDS, DIM), w)
    model.gram_vectors[BUCKETS] = 0
    y = np.asarray(toxic)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    # All words of the sample, their distinct ones numbered through.
    words, grams, gram_word, owner, size = [], [], [], [], []
    for lo, _, data, start, end, text in sliced_words(pa.array(texts, pa.large_string())):
        unique, s, t, inverse = distinct(data, start, end)
        framed, off = K.framed(data, s, t)
        base = sum(len(x) for x in words)
        at = np.repeat(np.arange(len(s)), np.diff(off))
        for k in GRAMS:
            b = K.gram_buckets(framed, off, k, BUCKETS)
            grams.append(b[b < BUCKETS].astype(np.int32)), gram_word.append((at[b < BUCKETS] + base).astype(np.int32))
        words.append(unique), owner.append((text + lo, inverse + base)), size.append(np.diff(off))
    lexicon = (np.concatenate(words) % np.uint64(WORDS)).astype(np.int64)
    n_words, length = len(lexicon), np.concatenate(size)
    bucket, of_word = np.concatenate(grams), np.concatenate(gram_word)
    doc, word = np.concatenate([a for a, _ in owner]), np.concatenate([b for _, b in owner])

    order = np.argsort(of_word, kind="stable")
    bucket, of_word = bucket[order], of_word[order]
    del order, words, grams, gram_word, owner
    used = np.unique(word * len(y) + doc)
    used = used[np.argsort(used % len(y), kind="stable")]  # by document
    seen_word, seen_doc = used // len(y), used % len(y)
    del used
    counts = {k: np.zeros((2, n), np.int64) for k, n in (("word", WORDS), ("gram", BUCKETS + 1))}
    for a in range(0, len(y), 100):  # documents counted together
        at = slice(*np.searchsorted(seen_doc, [a, a + 100]))
        lo, hi = np.searchsorted(of_word, seen_word[at]), np.searchsorted(of_word, seen_word[at], "right")
        n = hi - lo
        flat = bucket[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        for name, items, docs in (("word", lexicon[seen_word[at]], seen_doc[at]), ("gram", flat.astype(np.int64), np.repeat(seen_doc[at], n))):
            pairs = np.unique(items * len(y) + docs)
            for c in (0, 1):
                np.add.at(counts[name][c], pairs[y[pairs % len(y)] == c] // len(y), 1)
    del seen_word, seen_doc

    def evidence(none: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Positive log odds of a feature's document frequency, none for a feature of few toxic documents."""
        odds = np.log((one + 0.5) / (y.sum() + 1)) - np.log((none + 0.5) / ((1 - y).sum() + 1))
        return np.where(one >= max(3, LEAST_SHARE * y.sum()), np.clip(odds, 0, 6), 0).astype(np.float32) / 3

    word_evidence, gram_evidence = evidence(*counts["word"]), evidence(*counts["gram"])
    gram_evidence[BUCKETS] = 0

    begin, end, of_doc = windows(doc, len(y))
    strongest = np.zeros(n_words, np.float32)
    np.maximum.at(strongest, of_word, gram_evidence[bucket])
    hint = np.append(np.maximum(word_evidence[lexicon], strongest)[word], np.float32(0))
    guide = np.zeros(len(begin), np.float32)
    for k in range(WINDOW):
        np.maximum(guide, np.where(begin + k < end, hint[np.minimum(begin + k, len(word))], 0), out=guide)

    def inputs(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of some distinct words; their grams' buckets and whose they are."""
        lo, hi = np.searchsorted(of_word, which), np.searchsorted(of_word, which, "right")
        n = hi - lo
        b = bucket[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
        who = np.repeat(np.arange(len(which)), n)
        means = np.stack([np.bincount(who, model.gram_vectors[b, k], len(which)) for k in range(DIM)], axis=1) / length[which, None]
        return np.concatenate([model.word_vectors[lexicon[which]], means], axis=1).astype(np.float32), b, who

    def nudge(vectors: np.ndarray, squares: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
        """AdaGrad on the rows ``at`` (repeats add up)."""
        rows, place = np.unique(at, return_inverse=True)
        total = np.stack([np.bincount(place, g[:, k], len(rows)) for k in range(DIM)], axis=1).astype(np.float32)
        squares[rows] += (total**2).mean(1)
        vectors[rows] -= 0.05 * total / np.sqrt(squares[rows])[:, None]

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    sq_gram, sq_word = np.full(BUCKETS + 1, 1e-6, np.float32), np.full(WORDS, 1e-6, np.float32)
    step = 0
    every = np.arange(n_words)
    batch = max(32, min(BATCH, 2 * len(y) // 12))
    for epoch in range(max(epochs, LEAST_STEPS * batch // (2 * len(y)))):
        if epoch < GUIDED:
            score = guide + rng.random(len(guide), np.float32) * np.float32(0.01)  # ties by chance
        else:
            x = np.concatenate([inputs(every[a : a + 20_000])[0] for a in range(0, n_words, 20_000)])
            score = window_logits(model, gate_rows(model, x), word, begin, end)
        best = np.lexsort((-score, of_doc))
        first = best[np.searchsorted(of_doc[best], np.arange(len(y)))]
        clean = np.flatnonzero(y[of_doc] == 0)
        chosen = np.concatenate([first, rng.choice(clean, min(len(clean), len(y)), replace=False)])
        rng.shuffle(chosen)
        for a in range(0, len(chosen), batch):
            part = chosen[a : a + batch]
            # An empty window is clean.
            rows = np.concatenate([window_words(word, begin[part], end[part]), np.full((1, WINDOW), -1)])
            want = np.append(y[of_doc[part]], 0).astype(np.float32)
            used, local = np.unique(rows[rows >= 0], return_inverse=True)
            near = np.full(rows.shape, -1)
            near[rows >= 0] = local
            x, b, who = inputs(used)
            _, g, dg = gradients(model, gate_rows(model, x), near, want)
            g["wf"], g["wb"] = x.T @ dg[:-1, : 3 * H], x.T @ dg[:-1, 3 * H :]
            g["bf"], g["bb"] = dg[:-1, : 3 * H].sum(0), dg[:-1, 3 * H :].sum(0)
            dx = dg[:-1, : 3 * H] @ w["wf"].T + dg[:-1, 3 * H :] @ w["wb"].T
            step += 1
            for k, v in w.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            nudge(model.word_vectors, sq_word, lexicon[used], dx[:, :DIM])
            nudge(model.gram_vectors, sq_gram, b, (dx[:, DIM : 2 * DIM] / length[used, None])[who])
    return model


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """Score of every text of an Arrow column."""
    out = np.empty(len(column))
    if model.constant is not None:
        out[:] = model.constant
        return out
    for lo, hi, data, start, end, text in sliced_words(column):
        if len(start):
            hashes, s, t, inverse = distinct(data, start, end)
            gates = gate_rows(model, word_inputs(model, hashes, data, s, t))
        else:
            gates, inverse = np.zeros((1, 6 * HIDDEN), np.float32), np.zeros(0, np.int64)
        first, end_, owner = windows(text, hi - lo)
        best = np.full(hi - lo, -np.inf)
        np.maximum.at(best, owner, window_logits(model, gates, inverse, first, end_))
        out[lo:hi] = _sigmoid(best)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, characters: int = CHARACTERS) -> tuple[list[str], list[int]]:
    """Whole labelled texts of each class, in the order of a hash of their ids: at most ``per_class``, and ``characters`` in all.

    A text that does not fit into what is left of the characters is passed over,
    so the driver holds 2 * ``characters`` at most, and long texts are learned from.
    Raises ValueError if a class has labelled texts but each of them alone is longer than ``characters``.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 30))
    with_text = docs.where("text IS NOT NULL").select("doc_id", "text")
    # Rows that repeat an id count once, so that they cannot crowd the driver.
    sizes = with_text.select("doc_id", F.length("text").alias("chars")).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.max("chars").alias("chars")).withColumn("place", place)
    counts = {r["toxic"]: r["count"] for r in sizes.groupBy("toxic").count().collect()}
    drawn: list[int] = []
    for k, of_class in sorted(counts.items()):
        n, left = 0, characters
        # A bound on the hash leaves about three times as many as are wanted, so tasks send next to nothing however many they are.
        bound = int((1 << 30) * min(1.0, 3 * per_class / of_class))
        for r in sizes.where((F.col("toxic") == k) & (F.col("place") < bound)).orderBy("place", "doc_id").limit(2 * per_class).collect():
            if n < per_class and r["chars"] <= left:
                n, left = n + 1, left - r["chars"]
                drawn.append(r["doc_id"])
    # At most 2 * per_class ids, so they are broadcast and texts are not shuffled.
    ids = docs.sparkSession.createDataFrame([(i,) for i in drawn], known.select("doc_id").schema)
    rows = with_text.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).join(known, "doc_id").withColumn("place", place).collect() if drawn else []
    by: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r["place"], r["text"])):
        by[int(r["toxic"])].append(r["text"])
    # A table without labelled texts, or labels of one class, give a constant model; a lost class is an error.
    if not (by[0] and by[1]) and len(counts) == 2:
        raise ValueError(f"texts of both classes are labelled, but only {len(by[0])} clean and {len(by[1])} toxic ones have at most {characters} characters")
    return by[0] + by[1], [0] * len(by[0]) + [1] * len(by[1])


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``columns`` and the score and verdict under the names ``out`` for every row; the model is a broadcast of fixed size."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*columns) if "text" in columns else docs.select(*columns, "text")
    at = kept.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in columns) + f", `{out[0]}` double, `{out[1]}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.trimmed(batches):
            score = score_texts(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(columns))] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*columns, *out]
            )

    return kept.mapInArrow(run, schema)
