"""The training-data operators against brute force, round trips and held-out labels, with edge rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierflow.llm import chat, embedding_dedup, encoding, entries, html_text, langid, minhash, mixing, packing, quality, token_store, toxicity
from tierflow.llm.common import components

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ["", None, " \n\t", "one", "a b c d e f g", "a b c d e f g", "ß ünï 42 …", "word " * 3000, "!!! ???"]


def documents(spark, texts):
    """Rows with clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), i, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, at long, score double")


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (1, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ---------------------------------------------------------------------------------------------


LOG = "conv_id long, seq long, message_id long, kind string, role string, text string"


def conversations(rendered):
    """Runs joined: conv_id -> (turns, trained texts)."""
    out = {}
    for r in sorted(rendered.collect(), key=lambda r: (repr(r.conv_id), r.run)):
        turns, loss = out.setdefault(r.conv_id, ([], []))
        assert sum(len(t[0]) for t in turns) >= 0 and r.n_turns == len(chat.parse(r.formatted))
        turns += chat.parse(r.formatted)
        loss += [chat.Template.unescape(r.formatted[a:b]) for a, b in zip(r.loss_starts, r.loss_ends, strict=True)]
    return out


def plain_fold(log):
    """The log folded one event at a time."""
    rank = {"regenerate": 1, "edit": 2, "delta": 3}
    low = lambda x: (x is not None, x)
    messages, cuts, singles = {}, [], []
    for conv, seq, message, kind, role, text in sorted(log, key=lambda e: (low(e[1]), rank.get(e[3], 0), e[4] or "", e[5] or "")):
        role, text = role or "", text or ""
        if message is None:
            singles.append([conv, seq, role, text])
            continue
        m = messages.setdefault((conv, message), {"seq": seq, "role": role, "stated": False, "text": ""})
        m["text"] = m["text"] + text if kind == "delta" else text
        if rank.get(kind, 0) == 0 and not m["stated"]:
            m["role"], m["stated"] = role, True
        if kind == "regenerate" and seq is not None:
            cuts.append((conv, m["seq"], seq))
    every = singles + [[c, m["seq"], m["role"], m["text"]] for (c, _), m in messages.items()]
    kept = [x for x in every if x[1] is None or not any(c == x[0] and (lo is None or lo < x[1]) and x[1] < hi for c, lo, hi in cuts)]
    out = {}
    for conv, _, role, text in sorted(kept, key=lambda x: (low(x[1]), x[2], x[3])):
        out.setdefault(conv, []).append((role, text))
    return out


def test_fold_and_render(spark):
    log = [
        (1, 0, 10, "message", "user", "hi"),
        (1, 1, 11, "message", "assistant", ""),
        (1, 2, 11, "delta", None, "wor"),
        (1, 3, 11, "delta", None, "ld"),
        (1, 4, 12, "message", "user", "drop me"),
        (1, 5, 11, "regenerate", None, None),
        (1, 6, 11, "delta", None, "new <|end|> \\ |> "),
        (1, 7, 13, "message", "user", "kept"),
        (1, 8, 10, "edit", None, "hello"),
        (2, 0, None, None, None, None),
        (None, 0, 1, "message", "assistant", "a"),
        (None, 0, 1, "delta", None, "b"),
        (None, 1, 1, "delta", None, "c"),
    ]
    events = spark.createDataFrame(log, LOG).withColumns({"rank": F.lit("x"), "redone": F.lit(1), "run": F.lit(2)})
    shown = conversations(chat.render(chat.fold_events(events)))
    assert shown[1] == ([("user", "hello"), ("assistant", "new <|end|> \\ |> "), ("user", "kept")], ["new <|end|> \\ |> "])
    assert shown[2] == ([("", "")], []) and shown[None] == ([("assistant", "abc")], ["abc"])
    assert chat.digests(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_fold_equals_plain_fold(spark, monkeypatch):
    """Random logs with nulls, ties and repeated rows; runs of three turns."""
    monkeypatch.setattr(chat, "RUN", 3)
    rnd = random.Random(3)
    log = []
    for _ in range(700):
        conv, message = rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(12)])
        log.append((conv, rnd.choice([None, *range(60)]), message, rnd.choice(["message", "delta", "delta", "edit", "regenerate", None, "odd"]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b\\", "<|", "|>é", None, ""])))
    log += log[:30]
    want = plain_fold(log)
    rendered = chat.render(chat.fold_events(spark.createDataFrame(log, LOG).repartition(5)))
    assert {k: v[0] for k, v in conversations(rendered).items()} == want
    for r in chat.digests(rendered).collect():
        turns = want[r.conv_id]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_messages_longer_than_a_run(spark):
    """Texts above ``RUN_CHARS`` are runs of their own, cut nowhere; what stands around them goes into other runs."""
    long = "</turn> ü" * (chat.RUN_CHARS // 9 + 10)
    texts = ["short", long, "after", "again", long + "x", None]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rendered = chat.render(spark.createDataFrame(rows, "conv_id long, seq long, role string, text string"))
    assert [r.n_turns for r in sorted(rendered.collect(), key=lambda r: r.run)] == [1, 1, 2, 1, 1]
    turns, loss = conversations(rendered)[1]
    assert turns == [(r, t or "") for _, _, r, t in rows] and loss == [t or "" for _, _, r, t in rows if r == "assistant"]
    (got,) = chat.digests(rendered).collect()
    assert got.n_turns == 6 and got.loss_chars == sum(map(len, loss))
    assert got.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows).encode()).hexdigest()



def test_turns_through_the_fold(spark):
    """Every row of a table comes back from its events: repeated rows, equal and null turns, null texts, a long conversation."""
    rnd = random.Random(2)
    rows = [(5, i, "assistant" if i % 2 else "user", "".join(rnd.choice("<|>\\end a\né") for _ in range(rnd.randrange(30)))) for i in range(300)]
    rows += [rows[7], rows[7], (6, None, "assistant", "x"), (6, 0, None, None), (6, 0, "assistant", "b"), (6, 0, "assistant", "a"), (None, 1, "user", "y " * 200_000)]
    rnd.shuffle(rows)
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold_events(entries.turn_events(turns)), ordered=True), ordered=True).collect()}
    for conv in (5, 6, None):
        mine = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(b for _, a, b in mine if a == "assistant").encode()).hexdigest()


# --- 2 and 8 ------------------------------------------------------------------------------------------


@tables
def test_toxicity_held_out(spark):
    got = entries.op2_toxicity(spark, SF.replace("0.001", "0.01")).toPandas()
    labels = pd.read_parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    m = got[got.held_out].merge(labels, on="doc_id")
    assert (m.predicted[m.toxic == 1] == 1).mean() >= 0.5 and (m.predicted[m.toxic == 0] == 0).mean() >= 0.9
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_edges(spark):
    docs = documents(spark, EDGE)
    model = toxicity.fit(["you idiot there", "a calm day"] * 10, [1, 0] * 10, epochs=2)
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    assert len(got) == len(EDGE) and got[0].score == got[1].score == got[2].score and got[0].predicted == 0
    assert got[4].score == got[5].score
    assert toxicity.predict(docs.limit(0), model).count() == 0
    assert toxicity.score_texts(toxicity.fit([], []), pa.array(["x"])).tolist() == [0.0]


def test_toxicity_of_a_passage_wherever_it_stands():
    """A text's score is that of the highest of all its windows, at every word."""
    rng = np.random.default_rng(1)
    calm = [f"calm{i}" for i in range(60)]
    insult = "you utter idiot and fool get lost right now".split()
    model = toxicity.fit([" ".join(rng.choice(calm, 20)) for _ in range(30)] + [" ".join([*rng.choice(calm, 12), *insult]) for _ in range(30)], [0] * 30 + [1] * 30, epochs=3)
    body = rng.choice(calm, 70).tolist()
    texts = [" ".join([*body[:k], *insult, *body[k:]]) for k in range(61)] + ["", "one", " ".join(body[:8]), " ".join(body[:9])]
    for text, score in zip(texts, toxicity.score_texts(model, pa.array(texts)), strict=True):
        words = text.split()
        each = [" ".join(words[i : i + toxicity.WINDOW]) for i in range(max(1, len(words) - toxicity.WINDOW + 1))]
        assert abs(toxicity.score_texts(model, pa.array(each)).max() - score) < 1e-5
    rows = toxicity.gate_rows(model, rng.standard_normal((40, toxicity.INPUT)).astype(np.float32))
    word = rng.integers(0, 40, 300)
    plain = toxicity.logits(model, rows, word[np.arange(301 - toxicity.WINDOW)[:, None] + np.arange(toxicity.WINDOW)])
    assert np.allclose(toxicity.sweep(model, rows, word), plain, atol=1e-4)


def test_network_equals_plain_loops():
    """Scores of whole texts against the network written out with one number at a time."""
    from math import exp, tanh

    model = toxicity.fit(["you utter idiot there now my friend", "a calm day here by the sea and sun"] * 6, [1, 0] * 6, epochs=1)
    w, H, K = model.w, toxicity.HIDDEN, toxicity.K

    def sigmoid(x):
        return 1 / (1 + exp(-x))

    def vector(word):
        data = np.frombuffer(word.encode(), np.uint8)
        lo, hi = np.zeros(1, np.int64), np.array([len(data)])
        framed = b"\1" + word.encode() + b"\2"
        grams = []
        for n in toxicity.GRAMS:
            for i in range(len(framed) - n + 1):
                key = n
                for b in framed[i : i + n]:
                    key = (key << 8 | b) % 2**64
                grams.append(model.gram_vectors[int(K.mix(np.array([key], np.uint64))[0]) % toxicity.BUCKETS])
        mean = np.sum(grams, axis=0) / len(framed) if grams else np.zeros(toxicity.DIM)
        return [*model.word_vectors[int(K.span_hash(data, lo, hi)[0]) % toxicity.WORDS], *mean]

    def run(inputs, wx, bx, u):
        h, out = [0.0] * H, []
        for x in inputs:
            gate = [sum(a * wx[i][k] for i, a in enumerate(x)) + bx[k] for k in range(3 * H)]
            z = [sigmoid(gate[k] + sum(h[m] * u[m][k] for m in range(H))) for k in range(H)]
            r = [sigmoid(gate[H + k] + sum(h[m] * u[m][H + k] for m in range(H))) for k in range(H)]
            c = [tanh(gate[2 * H + k] + r[k] * sum(h[m] * u[m][2 * H + k] for m in range(H))) for k in range(H)]
            h = [z[k] * h[k] + (1 - z[k]) * c[k] for k in range(H)]
            out.append(h)
        return out

    texts = ["You utter IDIOT there, now 7 go-away my über friend of old", "one two", "idiot"]
    for text, score in zip(texts, toxicity.score_texts(model, pa.array(texts)), strict=True):
        words = [vector(x) for x in re.findall(r"[a-z\u0080-\U0010ffff]+", text.lower())]
        best = -1e9
        for i in range(max(1, len(words) - toxicity.WINDOW + 1)):
            part = words[i : i + toxicity.WINDOW]
            one, two = run(part, w["wf"], w["bf"], w["uf"]), run(part[::-1], w["wb"], w["bb"], w["ub"])[::-1]
            states = [[*a, *b] for a, b in zip(one, two, strict=True)]
            weight = [exp(sum(a * b for a, b in zip(s, w["att"], strict=True))) for s in states]
            pooled = [sum(x * s[k] for x, s in zip(weight, states, strict=True)) / sum(weight) for k in range(2 * H)]
            best = max(best, sum(a * b for a, b in zip(pooled, w["out"], strict=True)) + w["bias"][0])
        assert abs(sigmoid(best) - score) < 1e-5


def test_network_gradient():
    """Back-propagation against differences."""
    model = toxicity.fit(["you idiot there now", "a calm day here"] * 6, [1, 0] * 6, epochs=1)
    rng = np.random.default_rng(0)
    gates = rng.standard_normal((6, 6 * toxicity.HIDDEN)).astype(np.float32)
    index = np.array([[0, 1, 2, 3], [4, 2, -1, -1], [1, 1, 0, -1]])
    label = np.array([1, 0, 1], np.float32)
    _, g, dg = toxicity.gradients(model, gates, index, label)

    def loss():
        p = 1 / (1 + np.exp(-toxicity.logits(model, gates, index)))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for array, grad in ((model.w["uf"], g["uf"]), (model.w["ub"], g["ub"]), (model.w["att"], g["att"]), (gates, dg)):
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(4)]:
            if array is gates and at[0] == 5:
                continue
            old = array[at]
            array[at] = old + 1e-2
            up = loss()
            array[at] = old - 1e-2
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


@tables
def test_language_held_out(spark):
    got = entries.op8_language(spark, SF.replace("0.001", "0.01")).toPandas()
    m = got[got.held_out].merge(pd.read_parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), on="doc_id")
    assert (m.lang_pred == m.lang).mean() >= 0.97


def test_language_edges(spark):
    docs = documents(spark, EDGE)
    model = langid.fit(["the cat sat on the mat and the dog ran off"] * 3 + ["der hund und die katze sind nicht hier im haus"] * 3, ["en"] * 3 + ["de"] * 3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[0] == got[1] == got[2] == got[8] == ("und", 0.0) and got[4] == got[5] and got[7][0] in ("en", "de")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit([], [])).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_the_most_frequent_languages_are_learned(spark):
    """More labels than a model may have: the most frequent ones, then by name; nulls and other labels are predicted all the same."""
    rows = [(i, "hello there friend", "c" if i < 4 else "b" if i < 7 else f"x{i}") for i in range(12)] + [(12, "hello", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.training_sample(docs.where("lang IS NOT NULL"), most=3)[1]) == {"c", "b", "x10"}
    many = spark.createDataFrame([(i, "a b", f"l{i:04d}") for i in range(langid.MOST_LANGUAGES + 40)], "doc_id long, text string, lang string")
    labels = langid.training_sample(many)[1]
    assert sorted(labels) == [f"l{i:04d}" for i in range(langid.MOST_LANGUAGES)]
    model = langid.fit(*langid.training_sample(docs.where("lang IS NOT NULL"), most=3))
    found = langid.predict(docs, model).collect()
    assert len(found) == 13 and {r.lang_pred for r in found} <= {"c", "b", "x10"}


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    moves, start = rng.standard_normal((3, 3)), np.zeros(3)
    e = rng.standard_normal((5, 3))
    want, total = np.zeros(3), 0.0
    for path in product(range(3), repeat=5):
        w = np.exp(start[path[0]] + sum(e[t, c] for t, c in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for c in path:
            want[c] += w
    got = langid.marginals(e, np.array([1] * 5), 3, moves, start)
    assert np.allclose(got[1], want / total) and not got[0].any() and not got[2].any()
    # Texts over many blocks: one long text equals plain forward-backward.
    e = rng.standard_normal((200, 3))
    post, _, _ = langid._posteriors(e[None], moves, start)
    assert np.allclose(langid.marginals(e, np.zeros(200, int), 1, moves, start)[0], post[0].sum(0))


# --- 3 and 10 ----------------------------------------------------------------------------------------

ODD = ["  a", "a  ", "a\n\nb", "\n\n a \n b\t\tc  ", "it's a 'S  'test\n's a's.' b.'s", "<|endoftext|> x", "é è\r\n ç İ ﬁ", "a.b,c!! d.", "a  \n y", "x　y"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_texts(name, spaced):
    encoder = encoding.PieceEncoder(encoding.tokenizer_file(name), spaced)
    rnd = random.Random(4)
    texts = EDGE + ODD + ["".join(rnd.choice(" \n\t.,'’!aABßé1 ") for _ in range(60)) for _ in range(300)]
    got = [x.tolist() for ids, count in encoder.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_store_round_trip(spark, tmp_path):
    texts = EDGE + ODD + ["the same text again and again"] * 12
    docs = documents(spark, texts)
    path = str(tmp_path / "store")
    file = encoding.tokenizer_file("byte_bpe_50k.json")
    token_store.write_store(docs, path, file, 2, partitions=3)
    encoder = encoding.PieceEncoder(file, True)
    at = 0
    got = {r.doc_id: r for r in token_store.read_store(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (at, len(ids), ids)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.read_document(spark, path, 4) == [got[4].ids]
    token_store.write_store(docs.limit(0), str(tmp_path / "empty"), file, 2)
    assert token_store.read_store(spark, str(tmp_path / "empty")).count() == 0


def test_packing_covers_every_id(spark):
    texts = EDGE + ODD + ["A short one. And more of it! " * 40] * 5 + ["no end " * 5000]
    docs = documents(spark, texts)
    file = encoding.tokenizer_file("word_bpe_49k.json")
    got = packing.pack(docs, file, 1, partitions=2).toPandas()
    encoder = encoding.PieceEncoder(file, False)
    for i, t in enumerate(texts):
        ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = got[got.doc_id == i].sort_values("start")
        assert pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == len(ids)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    padding = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
        total = int(s.length.sum())
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding <= 0.02 * got.length.sum()
    assert packing.pack(docs.limit(0), file, 1).count() == 0


def test_cuts_equal_plain_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(20):
        points = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 30))])
        costs = rng.integers(0, 6, 31)
        length = 20
        best = [0.0] + [np.inf] * 30
        for j in range(1, 31):
            for i in range(j):
                if points[j] - points[i] <= length:
                    best[j] = min(best[j], best[i] + length - (points[j] - points[i]) + costs[j])
        cuts = packing.best_cuts(points, costs, length, True)
        at = np.searchsorted(points, cuts)
        assert cuts[-1] == points[-1] and sum(length - (b - a) for a, b in zip(cuts, cuts[1:])) + costs[at[1:]].sum() == best[-1]


# --- 4 ----------------------------------------------------------------------------------------------


def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 24))
    x = np.repeat(base, 5, axis=0) + 0.12 * rng.standard_normal((200, 24))
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] + [1.0] * 23, 1), (203, [None] + [1.0] * 23, 1), (204, rows[0][1], None), (205, [1.0, 2.0], 0), (206, [], 0), (None, rows[1][1], 1), (3, rows[3][1], 0)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<double>, label int, block int")
    got = embedding_dedup.near_duplicates(df, block=16).toPandas()
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (np.arange(200)[:, None] % 3 == np.arange(200) % 3)
    np.fill_diagonal(link, False)
    one = {r.vec_id: r for r in got.itertuples() if r.vec_id == r.vec_id}
    extra = link[3].copy()
    extra[3] = True  # the repeated row of vector 3
    low = np.arange(200)
    while True:
        new = np.minimum(low, np.where(link, low[None, :], 10**9).min(1))
        if (new == low).all():
            break
        low = new
    for i in range(200):
        assert one[i].component_id == low[i]
        if i not in np.flatnonzero(extra) and not (i == 1 or link[1][i]):
            assert one[i].n_links == link[i].sum()
    for i in range(200, 207):
        assert (one[i].n_links, one[i].component_id, one[i].kept) == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_many_equal_vectors_are_one_class(spark):
    """5,000 copies (zeros of both signs among them), one null id, a near vector in another block, and one id with two vectors."""
    e, f = [1.0, 0.0, 0.0], [0.99, 0.141, 0.0]  # cosine 0.99
    far = [0.0, 0.0, 1.0]
    rows = [(i, [1.0, -0.0 if i % 2 else 0.0, 0.0], "x") for i in range(10, 5009)] + [(None, e, "x")]
    rows += [(3, f, "x"), (5, [0.0, 1.0, 0.0], "x"), (7, far, "x"), (10, far, "x"), (1, e, "y"), (2, [0.0, 0.0, -1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = embedding_dedup.near_duplicates(df, block=1).toPandas()
    assert len(got) == len(rows)
    many = got[got.vec_id > 10]
    assert len(many) == 4998 and set(many.n_links) == {5000} and set(many.component_id) == {3}
    of = {k: sorted(zip(g.n_links, g.component_id, g.kept, strict=True)) for k, g in got[got.vec_id <= 10].groupby("vec_id")}
    assert of == {1: [(0, 1, True)], 2: [(0, 2, True)], 3: [(5000, 3, True)], 5: [(0, 5, True)], 7: [(1, 3, False)], 10: [(1, 3, False), (5000, 3, False)]}
    none = got[got.vec_id.isna()].iloc[0]
    assert none.n_links == 5000 and none.component_id != none.component_id and none.kept
    assert embedding_dedup.near_duplicates(df.where("vec_id IS NULL")).first().component_id is None


def test_a_vector_without_id_joins_two_others(spark):
    """The row between has no id; the ends do not link themselves."""
    turn = lambda t: [float(np.cos(t)), float(np.sin(t))]
    df = spark.createDataFrame([(1, turn(0.0), 0), (None, turn(0.18), 0), (2, turn(0.36), 0)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, block=1).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (2, None, True)}


# --- 5 ----------------------------------------------------------------------------------------------


def test_html():
    page = """<html><head><title>T</title></head><body><div class="cookie-banner"><p>We use cookies here, please accept all of them.</p></div>
    <div id="sidebar"><p>Some sidebar text, long enough to look like one.</p></div><main><h1>Head &amp; line</h1><p>Para   one with <a href=x>link</a> here.
    <ul><li>item one<li>item two</ul><form><p>Subscribe to get more of it.</p></form><script>var a = "<p>no</p>";</script></main>
    <section class="comments"><p>First! A long reader comment stands here.</p></section><footer>f</footer>"""
    assert html_text.extract(page) == "Head & line\nPara one with link here.\nitem one\nitem two"
    assert [html_text.extract(x) for x in (None, "", "<p>", "<<<>", "&#x20;")][:3] == ["", "", ""]


def test_minimum_cut_equals_enumeration():
    from itertools import product

    rng = random.Random(8)
    for _ in range(30):
        n = 7
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, i + 1, rng.uniform(0, 1.5)) for i in range(n - 1)] + [(0, 4, 0.7), (2, 6, 0.4)]

        def price(side):
            return sum(abs(c) for c, s in zip(costs, side) if (c > 0) != s) + sum(w for i, j, w in edges if side[i] != side[j])

        assert abs(price(html_text.minimum_cut(costs, edges)) - min(price(s) for s in product([False, True], repeat=n))) < 1e-9


def test_html_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article><p>Some real text stands here.</p></article>", "y")], "page_id long, url string, html string, page string")
    df = df.unionByName(df.where("page_id IS NULL"))  # a repeated row
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect()), key=repr)
    assert got == [(1, "", 0)] + [(None, "Some real text stands here.", 27)] * 2
    assert html_text.main_text(df.limit(0)).count() == 0


@tables
def test_html_cut_mends_what_blocks_alone_get_wrong():
    """Pages without the names that give blocks away: fewer errors with the edges than without."""
    pages = [re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(nav|footer|li|ul|h1)\b[^>]*>", r"<\1div>", p)) for p in pd.read_parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet").html.head(1200)]
    model = html_text.fit(pages[:400])
    wrong, turned = {}, 0
    for scale in (0.0, model.edge_scale):
        wrong[scale] = 0
        for p in map(html_text.parse, pages[400:]):
            keep = html_text.labels(p, html_text.Model(model.weights, scale))
            wrong[scale] += sum(k != b.labelled for k, b in zip(keep, p.blocks, strict=True))
            turned += sum(k != (c > 0) for k, c in zip(keep, html_text.costs_of(p, model), strict=True))
    assert model.edge_scale > 0 and turned > 0 and wrong[model.edge_scale] < wrong[0.0]


def test_html_long_pages():
    import time

    for part in ("<x ", "<div>a ", "<b>", '<a title="', "<script>x</script ", "<div></x></p>", "<p>ab. ", "</div", "<!-- ", "&amp", "<p>Some words, and more.</p><div class=ad>x</div>"):
        began = time.process_time()
        html_text.extract(part * (240_000 // len(part)))
        assert time.process_time() - began < 5, part  # a rescan for each tag would take minutes


# --- 6 ----------------------------------------------------------------------------------------------


def targets(sizes):
    free, left, out = set(sizes), sum(sizes.values()), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(spark):
    rnd = random.Random(9)
    texts = EDGE + [" ".join(["w"] * rnd.randrange(1, 400)) for _ in range(120)]
    docs = documents(spark, texts)
    got = mixing.taken(docs).toPandas()
    size = [len(WORD.findall(t or "")) for t in texts]
    source = {i: (f"s{i % 3}" if i % 4 else None) for i in range(len(texts))}
    total = {}
    for i, n in enumerate(size):
        total[source[i]] = total.get(source[i], 0) + n
    want = targets(total)
    used = dict.fromkeys(total, 0)
    for r in got.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.taken <= 3 * r.size
        used[source[r.doc_id]] += r.taken
    assert len(got) == len(texts) and all(abs(used[s] - want[s]) <= 1 for s in want)
    again = mixing.taken(docs.repartition(3)).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    mixed = mixing.mixed_documents(docs).toPandas()
    assert {k: mixed[mixed.doc_id == k].text.map(lambda t: len(WORD.findall(t))).sum() for k in mixed.doc_id} == {r.doc_id: r.taken for r in got.itertuples() if r.taken}
    assert mixing.taken(docs.limit(0)).count() == 0


def test_mix_equals_a_plain_walk_over_slots(spark, monkeypatch):
    """Every document's words, slot by slot, and the shards that a draw gives."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rnd = random.Random(19)
    rows = [(i, " ".join(f"{i}w{k}" for k in range(rnd.randrange(1, 90))), rnd.choice(["a", "b", "b", "b", None])) for i in range(80)]
    rows += [rows[3], rows[3], (5, "x " * 40, "a"), (None, "y " * 50, "b"), (None, None, "b"), (7, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.placed_documents(docs).collect()
    recipe, written = mixing.mix(docs, shard_words=300)
    recipe, written = recipe.collect(), written.collect()
    assert len(placed) == len(rows)
    want, total = {}, {}
    for r in recipe:
        mine = sorted((p for p in placed if p.source == r.source and p.size), key=lambda p: p.at)
        stream = [(p["__key_a"], p["__key_b"], p.copy, k) for p in mine for k in range(p["size"])]
        assert [p.at for p in mine] == [sum(q["size"] for q in mine[:k]) for k in range(len(mine))] and len(stream) == r.source_size
        blocks = [stream[k : k + 16] for k in range(0, len(stream), 16)]
        left, slot = round(min(r.target, 3 * r.source_size)), 0
        while left > 0:
            nth, place = divmod(slot, len(blocks))
            block = int(mixing.permute(np.array([place]), np.array([len(blocks)]), np.array([mixing.source_seed(r.source)]))[0])
            for word in blocks[block][:left]:
                want[r.source, nth, block, word] = 1
            left -= len(blocks[block])
            slot += 1
        total[r.source] = slot
    got = {(w.source, w["pass"], w.block, (w["__key_a"], w["__key_b"], w.copy, k)): 1 for w in written if w["pass"] is not None for k in range(w.lo, w.hi)}
    assert got == want
    by_doc = {}
    for (_, _, _, (a, b, copy, _)) in want:
        by_doc[a, b, copy] = by_doc.get((a, b, copy), 0) + 1
    assert sorted(r.taken for r in mixing.taken(docs).collect()) == sorted(by_doc.get((p["__key_a"], p["__key_b"], p.copy), 0) for p in placed)
    # Another draw: other shards, the same slots.
    _, other = mixing.mix(docs, draw=1, shard_words=300)
    shards = [{(w.source, w["pass"], w.block): w.shard for w in x if w["pass"] is not None} for x in (written, other.collect())]
    assert shards[0].keys() == shards[1].keys() and shards[0] != shards[1] and len(set(shards[0].values())) > 4
    assert {s: sum(k[0] == s for k in shards[0]) for s in total} == total
    for shard in set(shards[0].values()):  # written in the order of the slots
        turns = [w.turn for w in written if w.shard == shard]
        assert turns == sorted(turns)


def test_shards_are_one_multinomial_draw():
    total, depth = 5000, 4
    whole = mixing.shards_of(0, total, total, depth, 7)
    parts = np.concatenate([mixing.shards_of(lo, min(lo + 777, total), total, depth, 7) for lo in range(0, total, 777)])
    assert (whole == parts).all() and (np.diff(whole) >= 0).all()
    counts = np.bincount(whole, minlength=16)
    assert counts.sum() == total and counts.std() > 0 and ((counts - total / 16) ** 2 / (total / 16)).sum() < 45
    many = np.array([np.bincount(mixing.shards_of(0, 64, 64, 2, s), minlength=4) for s in range(400)])
    assert abs(many.mean(0) - 16).max() < 0.8 and abs(many.var(0) - 12).max() < 4  # n p and n p (1 - p)
    assert mixing.shards_of(0, 3, 3, 0, 1).tolist() == [0, 0, 0]


def test_permutation():
    for n in (1, 2, 3, 10, 257):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 77))
        assert sorted(got) == list(range(n)) and all(mixing.place_of(int(got[i]), n, 77) == i for i in range(n))


# --- 7 ----------------------------------------------------------------------------------------------


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_minhash(spark):
    rnd = random.Random(10)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = list(EDGE)
    for _ in range(6):
        base = [rnd.choice(vocabulary) for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(120)] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[-1].upper()] * 3
    docs = documents(spark, texts)
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    for chunk, slack in ((256, 0.15), (5, 0.15), (5, 0.95)):  # the last: every pair of a bucket is confirmed in tiles
        minhash.CHUNK, minhash.SLACK = chunk, slack
        got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
        assert len(got) == len(texts)
        for i in range(len(texts)):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), low[i], low[i] == i)
    minhash.CHUNK, minhash.SLACK = 256, 0.15
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimate():
    rng = np.random.default_rng(11)
    both, only = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    one, two = np.concatenate([both, only[:200]]), np.concatenate([both, only[200:]])
    packed = minhash.pack(minhash.minima([np.unique(one), np.unique(two)]))
    assert abs(minhash.estimated(packed[:1], packed[1:])[0] - 800 / 1200) < 0.12


# --- 9 ----------------------------------------------------------------------------------------------


def test_quality(spark):
    rnd = random.Random(12)
    texts = EDGE + [" ".join(rnd.choice(["a", "bb", "c|", "DD\n", "e.\n\n", "f#"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 80, 400)] + ["x y z " * 40, "same line\nsame line\n" * 30]
    got = {r.doc_id: r for r in quality.verdicts(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {p for k, g in enumerate(tri) if tri.count(g) > 1 for p in (k, k + 1, k + 2)} if len(words) < 2000 else set(range(len(words)))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality.verdicts(documents(spark, texts).limit(0)).count() == 0


# --- odd rows ---------------------------------------------------------------------------------------


def test_null_and_repeated_ids(spark, tmp_path):
    """Token store, packing, quality, language and toxicity: null ids, fully repeated rows, two texts under one id, a very long text."""
    long = "Some words, and more of them. " * 12_000
    rows = [(None, "a b c"), (None, "d e"), (1, "same text"), (1, "same text"), (2, "one"), (2, "two words"), (3, None), (4, ""), (5, long)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, size long, start long, words string")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    file = encoding.tokenizer_file("byte_bpe_50k.json")
    encoder = encoding.PieceEncoder(file, True)
    token_store.write_store(docs, str(tmp_path / "s"), file, 2, partitions=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, str(tmp_path / "s")).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=key):
        ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    file = encoding.tokenizer_file("word_bpe_49k.json")
    encoder = encoding.PieceEncoder(file, False)
    packed = packing.pack(docs, file, 1, partitions=3).toPandas()
    sizes = sorted(len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert packed.length.sum() == sum(sizes) and sorted(packed[packed.start == 0].doc_tokens) == sizes and packed.doc_id.isna().sum() == 2
    judged = quality.verdicts(docs).collect()
    assert sorted(((r.doc_id, r.n_words) for r in judged), key=repr) == sorted(((i, len(WORD.findall(t or ""))) for i, t in rows), key=repr)
    langs = langid.fit(["yes it is the one"] * 4 + ["ja das ist der"] * 4, ["en"] * 4 + ["de"] * 4)
    toxic = toxicity.fit(["you idiot there", "a calm day"] * 10, [1, 0] * 10, epochs=2)
    for out in (langid.predict(docs, langs).collect(), toxicity.predict(docs, toxic).collect()):
        assert sorted((r.doc_id for r in out), key=repr) == sorted((i for i, _ in rows), key=repr)


# --- pipeline -----------------------------------------------------------------------------------------


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == names
        path = f"{entries.shared_dir(spark)}/test-{random.random()}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
    assert before.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    pieces = cp.STAGES[-1][1](spark, before, SF)
    assert pieces.agg(F.sum("length")).first()[0] > 0 and pieces.where("length > 2048").count() == 0


def clashing(spark):
    """Documents, some of them odd, with columns named as the operators name theirs."""
    rnd = random.Random(21)
    table = pd.read_parquet(f"{SF}/documents.parquet").head(60)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table.itertuples()]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], None, None, 5), (None, rows[3][1] + " end", "en", "src1", 5), (None, None, None, None, None), (900, "", "en", "src1", 0), (901, "12 34 !!", "en", "src1", 0), (902, rows[4][1] * 30, rows[4][2], "src2", 0)]
    names = ["size", "whole", "los", "his", "lang_pred", "share", "score", "predicted", "pass", "shard", "class", "component", "copy", "at", "key_a"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names)
    return spark.createDataFrame([(*r, *[rnd.randrange(9) for _ in names]) if k != 1 else (*r, *[None] * len(names)) for k, r in enumerate(rows)], schema)


@tables
def test_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    docs = clashing(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == out.columns and empty.count() == 0
        if name in ("language", "toxicity", "near_duplicates"):
            before = sorted(map(repr, docs.collect()))
            assert all(repr(r) in before for r in rows)
        if name == "toxicity":
            assert any(r.doc_id is None for r in rows)


@tables
def test_language_stage_equals_brute_force(spark):
    """What goes: no letter, no language with the share, or another one than the label; posteriors by plain forward-backward."""
    import corpus_pipeline as cp

    docs = clashing(spark)
    first = docs.where("doc_id = 0").limit(1)  # a German text under another label
    docs = docs.unionByName(first.withColumns({"doc_id": F.lit(903).cast("long"), "lang": F.lit("fr")}))
    kept = sorted(map(repr, cp.language(spark, docs, SF).collect()))
    model = langid.learn(docs.where(entries.crc_mod("doc_id", 5) != 0))
    want = []
    for r in docs.collect():
        words = [[*langid.sliced_words(pa.array([r.text or ""]))][0]]
        _, _, data, start, end, _ = words[0]
        if not re.search(r"[^\W\d_]", r.text or "") or not len(start):
            continue
        e = np.stack([langid.emissions(model, langid.K.span_hash(data, start[k : k + 1], end[k : k + 1]), data, start[k : k + 1], end[k : k + 1])[0] for k in range(len(start))]).astype(float)
        post, _, _ = langid._posteriors(e[None], model.moves, model.start)
        share = post[0].mean(0)
        if share.max() >= cp.LEAST_SHARE and r.lang in (None, model.labels[share.argmax()]):
            want.append(repr(r))
    assert kept == sorted(want) and len(kept) < docs.count() - 3


def odd_ids(spark):
    """Rows of null ids, fully repeated rows, and two texts under one id, each with a copy elsewhere."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [(None, text["a"], "s"), (None, text["a"], "s"), (1, text["b"], "s"), (1, text["b"], "s"), (2, text["c"], "t"), (2, text["d"] + " end", "t")]
    rows += [(3, text["d"], "t"), (4, text["c"], "t"), (None, text["e"], None), (9, None, "t"), (9, None, "t")]
    return text, spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_minhash_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    text, docs = odd_ids(spark)
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    want = [(None, None, True)] * 3 + [(1, 1, True)] * 2 + [(2, 2, True)] * 2 + [(3, 2, False), (4, 2, False)] + [(9, 9, True)] * 2
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert left == sorted([(None, text["a"]), (1, text["b"]), (2, text["c"]), (2, text["d"] + " end"), (None, text["e"]), (9, None)], key=repr)
    # One copy's row under a shared id goes, the other text of that id stays.
    shared = spark.createDataFrame([(5, text["a"], "x"), (7, text["a"], "x"), (7, text["b"], "x")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, shared, SF).collect()) == [5, 7]
    assert cp.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_mixing_null_and_repeated_ids(spark):
    _, docs = odd_ids(spark)
    docs = docs.unionByName(spark.createDataFrame([(2, "short", "en", "t", 5)], docs.schema))
    every = mixing.taken(docs).collect()
    assert len(every) == docs.count() and sum(r.doc_id == 9 for r in every) == 2  # repeated empty rows stay apart
    targets = {r.source_size: r.target for r in every}
    mixed = mixing.mixed_documents(docs).toPandas()
    words = mixed.text.map(lambda t: len(WORD.findall(t)))
    for s in ("s", "t", None):
        mine = mixed.source.isna() if s is None else mixed.source == s
        size = sum(len(WORD.findall(r.text or "")) for r in docs.collect() if r.source == s)
        assert abs(words[mine].sum() - targets[size]) <= 1
    assert mixed.doc_id.isna().any() and mixed.columns.tolist() == docs.columns


def test_samples_count_repeated_ids_once(spark):
    docs = spark.createDataFrame([(1, "ja nein", "de")] * 5 + [(2, "yes no", "en"), (None, "oui non", "fr")], "doc_id long, text string, lang string")
    texts, langs = langid.training_sample(docs)
    assert sorted(zip(langs, texts, strict=True)) == [("de", "ja nein"), ("en", "yes no"), ("fr", "oui non")]  # null is an id
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels) == (["yes no", "ja nein"], [0, 1])


def test_toxic_sample_holds_whole_texts_within_its_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * (100 if i < 40 else 9)) for i in range(50)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(51)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels, per_class=3)
    assert toxic == [0] * 3 + [1] * 3 and set(map(len, texts)) <= {9, 100}
    texts, toxic = toxicity.training_sample(docs, labels, characters=230)
    assert all(sum(len(t) for t, y in zip(texts, toxic, strict=True) if y == k) <= 230 for k in (0, 1)) and {len(t) for t in texts} == {9, 100}
    with pytest.raises(ValueError, match="both classes"):
        toxicity.training_sample(docs.where("doc_id < 40 OR doc_id % 2 = 0"), labels, characters=50)
    assert toxicity.training_sample(docs.limit(0), labels) == ([], [])


def framed_page(body="", wrapper="", article=""):
    text = "".join(f"<p>{'A sentence of the article that is long enough to be one. ' * 3}</p>" for _ in range(4))
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"
    comments = '<div class="comments"><article class="comment-body"><p>I like this text very much, thank you for it.</p></article></div>'
    return f'<html><head><title>t</title></head><body{body}><div{wrapper}>{menu}<main><article{article}><h1>Title</h1>{text}</article></main>{comments}</div><footer>Copyright 2024</footer></body></html>'


@pytest.mark.parametrize("name", ["has-banner", "single-post with-sidebar", "no-comments", "search-results widget-area", "page-with-menu newsletter-popup"])
def test_classes_of_what_frames_the_page_say_nothing_of_its_blocks(name):
    plain = html_text.extract(framed_page())
    assert plain.startswith("Title\n") and "thank you" not in plain and "Copyright" not in plain and "Home" not in plain
    for place in ("body", "wrapper"):
        assert html_text.extract(framed_page(**{place: f' class="{name}"'})) == plain
    assert "thank you" not in html_text.extract(framed_page().replace('class="comments"', 'class="x"'))


@tables
def test_body_classes_change_no_page():
    pages = pd.read_parquet(f"{SF}/pages.parquet").html.tolist()
    model = html_text.fit(pages)
    for name in ("has-banner", "single-post with-sidebar", "no-comments"):
        other = [re.sub("<body", f'<body class="{name}"', p, count=1) for p in pages]
        assert [html_text.extract(p, model) for p in other] == [html_text.extract(p, model) for p in pages]


def test_rules_are_ordered_by_rejection_per_cost(spark):
    """Two rules that reject the same rows, one of them slow; and two that cost the same, of which one rejects nothing."""
    counted = quality.with_counts(documents(spark, ["some words of a text " * 200] * 40))
    slow = "length(regexp_replace(repeat(text, 20), '(a|o|e)(.)\\\\1?', '$2')) > 0"
    assert quality.cascade_order(counted, {"slow": slow, "cheap": "length(text) > 0"}) == ["cheap", "slow"]
    assert quality.cascade_order(counted, {"none": slow.replace("> 0", "< 0"), "all": slow}) == ["all", "none"]
