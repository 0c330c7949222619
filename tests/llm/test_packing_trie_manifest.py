"""The prefix trie, the manifest and best-fit packing against brute force, with edge rows."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm import best_fit, entries, manifest, prefix_trie
from tierflow.llm.common import crc_mod
from tierflow.llm.encoding import tokenizer_file

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def same(a, b):
    return sorted(map(repr, map(tuple, a))) == sorted(map(repr, map(tuple, b)))


# --- 11 --------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """Every prefix of every rebuilt conversation, one at a time."""
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    said = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in said.items()}
    built, members, below = {}, {}, {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(said.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    for path in members:
        if path:
            below.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = below.get(path, [])
        leaves[path] = sum(leaves[k] for k in kids) if kids else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids)
    out = []
    for path, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(path))
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(below.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_turns(seed, n):
    """Shared beginnings of all lengths around a band, ties, nulls, repeated rows."""
    rnd, rows = random.Random(seed), []
    for c in [*range(n), -5, -250, 100_000]:
        trunk = rnd.choice("ab")
        for t in range(rnd.choice([1, 2, 3, 5, 15, 16, 17, 31, 32, 33, 40])):
            text = f"{trunk}{t}" if rnd.random() < 0.97 else rnd.choice([None, "", "é" * 5, "x"])
            rows.append((c, t or rnd.choice([None, 0]), rnd.choice(["user", None]) if c % 50 == 3 else ["user", "assistant"][t % 2], text))
    rows += [(None, 1, "user", "no conversation"), (3, 1, "user", "t"), (3, 1, "user", "t")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [random_turns(1, 130), [(7, 0, "user", "a")], [], [(7, 0, "u", "a")] + [(200, k, "u", "z") for k in range(100)]], ids=["random", "one", "none", "long"])
def test_trie(spark, rows):
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit(1), "id": F.lit("clash")}).repartition(3)
    assert same(prefix_trie.trie(df).collect(), plain_trie(rows))


def test_trie_of_copies_over_ranges(spark):
    """One conversation many times over: its nodes are cut by every range, and so are its ends."""
    rows = [(1000 + c, t, "user", f"turn {t}") for c in range(300) for t in range(7)] + [(c, 0, "user", "other") for c in range(900, 906)]
    assert same(prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(4)).collect(), plain_trie(rows))


def test_range_minima():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 100):
        values = rnd.integers(-1, 5, n)
        table = prefix_trie.RangeMinima(values)
        at, least = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        right = [next((p - 1 for p in range(a + 1, n) if values[p] < e), n - 1) for a, e in zip(at, least, strict=True)]
        left = [next((p for p in range(a, 0, -1) if values[p] < e), 0) for a, e in zip(at, least, strict=True)]
        assert table.right(at, least).tolist() == right
        assert table.left(at, least).tolist() == left


# --- 12 --------------------------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_manifest(rows):
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        out = []
        for nodes in tree[:-1]:
            run = i - i % 8
            out.append((nodes[run:i], nodes[i + 1 : run + 8]))
            i //= 8
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    kept = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for g in names}
    trees = {g: levels([plain_leaf(r) for r in kept[g]]) for g in names}
    forest = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(kept[g]):
            steps = path(trees[g], i) + path(forest, k)
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = plain_leaf((*r[:4], r[4] and r[4].translate(LOWER))) if altered else plain_leaf(r)
            for a, b in steps:
                node = sha(*a, node, *b)
            out.append((r[0], plain_leaf(r), trees[g][-1][0], forest[-1][0], sha(*[x for a, b in steps for x in a + b]), node, node == forest[-1][0]))
    return out


def random_documents(seed):
    """Ids far apart, negative, repeated and null; groups of all sizes; one row many times."""
    rnd, rows = random.Random(seed), []
    for i in range(700):
        doc_id = rnd.choice([i, -i * 7919, i << 40, None, 7, 8, (1 << 63) - 1 - i, -(1 << 63) + i]) if i % 3 == 0 else i
        rows.append((doc_id, rnd.choice(["a", None, "é"]), "en" if i % 3 else rnd.choice(["de", None, "", "fr"]), rnd.choice([None, i]), rnd.choice([None, "", "Ab Éé", "x" * 50 + "Q"])))
    return rows + [(7, "a", "en", 1, "Same")] * 600 + [(None, "b", "zz", 2, "t")] * 3 + [(5, None, f"l{i}", 1, "T") for i in range(12)]


@pytest.mark.parametrize("rows", [random_documents(4), [(1, None, None, None, None)], []], ids=["random", "one", "none"])
def test_manifest(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("clash"), "tree": F.lit(1), "n": F.lit(2)}).repartition(3)
    altered = F.when(crc_mod("doc_id", 3) == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert same(manifest.manifest(df, altered).collect(), plain_manifest(rows))


@tables
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_manifest"])
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entries.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entries.ORACLE_SQL[name]})").fetchall()
    assert same(got.collect(), want)


# --- 13 --------------------------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    """One piece at a time, the largest first, where it leaves least room."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(capacity - s)
    return len(room)


def fewest(sizes, capacity):
    """The least number of bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(k, room):
        if len(room) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(room)
            return
        for i in {r: i for i, r in enumerate(room) if r >= sizes[k]}.values():
            go(k + 1, [r - sizes[k] if j == i else r for j, r in enumerate(room)])
        go(k + 1, [*room, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_best_fit_and_bounds():
    rnd = random.Random(3)
    for trial in range(150):
        capacity = rnd.choice([10, 24, 60])
        sizes = [rnd.randint(1, rnd.choice([capacity, capacity // 2])) for _ in range(rnd.randint(0, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, np.int64)
        bins = best_fit.best_fit_decreasing(counts)
        assert sum(m for _, m in bins) == plain_best_fit(sizes, capacity), trial
        assert sum(counts) == sum(k * m for contents, m in bins for _, k in contents)
        assert best_fit.lower_bound(counts) <= (fewest(sizes, capacity) if sizes else 0) <= sum(m for _, m in bins)
        plan = best_fit.layout(bins, capacity)
        each = [(s, k) for s in range(1, capacity + 1) for k in range(counts[s])]
        if each:
            size, place = np.array(each).T
            number, offset = best_fit.placed(size, place, plan)
            for b in set(number.tolist()):
                inside = sorted(zip(offset[number == b].tolist(), size[number == b].tolist(), strict=True))
                assert [o for o, _ in inside] == np.concatenate([[0], np.cumsum([s for _, s in inside])[:-1]]).tolist()
                assert sum(s for _, s in inside) <= capacity


def checked(rows, texts, length=1024):
    """Every id once, pieces in place, sequences gapless and within length."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = []
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % length or length
        ends = [first, *range(first + length, len(ids) + 1, length)]
        want += [(i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip([0, *ends], ends))]  # noqa: B905
    assert same([tuple(r)[:5] for r in rows], want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in sequences.values():
        end = 0
        for offset, n in sorted(inside):
            assert offset == end
            end += n
        assert end <= length
    return len(sequences)


def test_pack_exchanges_between_partitions(spark):
    rnd = random.Random(8)
    texts = [(rnd.choice([i, None, 5]), rnd.choice([None, "", "word " * rnd.randint(1, 900), "a b " * 1500, "Ünï 漢字 " * rnd.randint(1, 60)])) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"length": F.lit(1), "part": F.lit("clash")}).repartition(4)
    rows = best_fit.pack(df, tokenizer_file("byte_bpe_50k.json"), 2, partitions=20).collect()
    packed = checked(rows, texts)
    counts = np.bincount([r.length for r in rows], minlength=1025)
    alone = best_fit.pack(df, tokenizer_file("byte_bpe_50k.json"), 2, partitions=1).collect()
    least, single = best_fit.lower_bound(counts), checked(alone, texts)
    assert least <= single <= least * 1.01 + 1
    assert least <= packed <= least * 1.03 + 2
    assert any(r.sequence_id >> 56 > 0 for r in rows)  # some pieces went to a pool


def test_pack_edges(spark):
    schema = "doc_id long, text string"
    assert best_fit.pack(spark.createDataFrame([], schema), tokenizer_file("byte_bpe_50k.json"), 2).count() == 0
    texts = [(1, None), (1, None), (None, ""), (2, "long " * 20_000)]
    assert checked(best_fit.pack(spark.createDataFrame(texts, schema), tokenizer_file("byte_bpe_50k.json"), 2).collect(), texts)
