"""Search by trigrams against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators.filters import search
from tierflow.sources import textindex
from tierflow.sources.textindex import TextIndex

from test_ordered import scanned

SCHEMA = "id long, name string, note string"
WORDS = ["Alpha", "beta", "GAMMA", "delta", "ΣΊΣΥΦΟΣ", "naïve", "a%b_c", "😀😀x", "don't", "b\\n", "tab\there", "İstanbul"]


def table_rows(n, seed, first=0):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice([None, "", "ab", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 4)))])
    return [(first + i, pick(), pick()) for i in range(n)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Three epochs: 300 rows, 60 of them changed with 40 new ones, and 10 of those changed again."""
    loads = [table_rows(300, 1), table_rows(100, 2, 240), table_rows(10, 3, 320)]
    frames = [spark.createDataFrame([*x, (None, "alpha without a key", None)], SCHEMA).repartition(3) for x in loads]
    index = TextIndex(spark, f"file://{tmp_path_factory.mktemp('text')}/i x", "id", ["name", "note"], frames[0].schema, 4)
    for epoch, df in enumerate(frames):
        index.upsert(df, epoch)
    now = {r[0]: r for x in loads for r in x}
    return index, spark.createDataFrame(list(now.values()), SCHEMA), frames


@pytest.mark.parametrize("query", ["alpha", "LPH", "gamma delta", "σίσυφος", "%b_", "😀😀x", "n't", "b\\n", "b\th", "istanbul", "nowhere", "ab", "x", "", "naïve alpha beta gamma delta"])
def test_search_equals_scan(indexed, query):
    index, now, _ = indexed
    for columns in (None, ["note"]):
        want = search(now, query, columns or ["name", "note"])
        assert sorted(map(tuple, index.search(query, columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_all_rows_and_repeated_epochs(spark, indexed):
    index, now, frames = indexed
    for epoch in (1, 2, 0):
        index.upsert(frames[epoch], epoch)
    assert sorted(map(tuple, index.read().collect())) == sorted(map(tuple, now.collect()))
    with pytest.raises(ValueError, match="not indexed"):
        index.search("alpha", ["id"])


def test_many_places_match_whole_files(indexed, monkeypatch):
    index, now, _ = indexed
    monkeypatch.setattr(textindex, "BROADCAST_PLACES", 3)
    assert index.search("beta").count() == search(now, "beta", ["name", "note"]).count() > 3


def test_few_rows_and_files_are_read(spark, tmp_path, monkeypatch):
    """A rare word: one file of many is opened, one row's text is matched, and few postings are read."""
    monkeypatch.setattr(textindex, "ROWS_PER_FILE", 500)
    df = spark.range(20_000).select("id", F.concat(F.lit("common words "), F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") == 7_777, " needle").otherwise("")).alias("text"))
    index = TextIndex(spark, f"file://{tmp_path}/i", "id", ["text"], df.schema, 4)
    index.upsert(df, 0)
    found = index.candidates("NEEDLE")
    assert [r.id for r in index.search("NEEDLE").collect()] == [7_777]
    assert found.count() == 1 and len([f for f in found.inputFiles() if "/rows/" in f]) == 1
    assert index.store.part("files", [0]).count() >= 40
    asked = index.store.part("postings", [0]).where("field = 'text' AND gram = 'eed'")
    assert scanned(asked)[1] < index.store.part("postings", [0]).count() / 4
    # Every trigram is there, though not together.
    assert index.search("words common").count() == 0


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    index = TextIndex(spark, f"file://{tmp_path}/i", "id", ["name"], df.schema, 4)
    assert index.read().count() == index.search("abc").count() == 0
    index.upsert(df, 0)
    assert index.read().count() == index.search("abc").count() == index.search("a").count() == 0
    index.upsert(spark.createDataFrame([(1, "xabcx", None)], SCHEMA), 1)
    assert [r.id for r in index.search("ABC").collect()] == [1]


def test_postings_are_made_by_stretches(spark, tmp_path, monkeypatch):
    """A trigram of many rows is one posting a stretch and not one a row; letters beyond the 16-bit plane and texts of under three."""
    grams, ends, numbers = textindex.trigrams(["😀😀x", "ab", "", "abab", "x😀😀x"])
    assert {g: numbers[a:b].tolist() for g, a, b in zip(grams, ends[:-1], ends[1:])} == {"😀😀x": [0, 4], "aba": [3], "bab": [3], "x😀😀": [4]}
    df = spark.range(5_000).select("id", F.concat(F.lit("common words "), F.col("id").cast("string")).alias("text"))
    index = TextIndex(spark, f"file://{tmp_path}/i", "id", ["text"], df.schema, 4)
    index.upsert(df, 0)
    files = index.store.part("files", [0]).count()
    common = index.store.part("postings", [0]).where("gram = 'com'")
    assert common.count() <= files and common.selectExpr("sum(size(steps))").first()[0] == 5_000
    assert index.search("words 4321").count() == 1
