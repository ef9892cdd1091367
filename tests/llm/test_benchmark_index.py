"""The benchmark's index: null ids, size, and one result whatever the number of items."""

import random

from pyspark.sql import functions as F

from lociform.llm import decontamination
from tests.llm.test_operators import frame, prose


def test_null_ids_are_rows_of_their_own(spark):
    rng = random.Random(21)
    item, other = prose(rng, 30), prose(rng, 25)
    docs = frame(spark, [(None, prose(rng, 40) + " " + item), (None, prose(rng, 90)), (None, None), (3, other), (4, prose(rng, 60))])
    bench = spark.createDataFrame([(None, item), (None, other), (5, None), (7, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontamination.matches(docs, bench).collect())
    assert got == [("3", "None"), ("None", "7"), ("None", "None")]
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns
    # the clean rows without an id stay
    assert sorted(str(r.doc_id) for r in left.collect()) == ["4", "None", "None"]
    named = bench.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    assert {r.item_id for r in decontamination.matches(docs, named).collect()} == {None, "i7"}


def test_names_of_the_operator_do_not_clash(spark):
    rng = random.Random(22)
    item = prose(rng, 30)
    docs = frame(spark, [(1, item), (2, prose(rng, 50))])
    for name in ("_found", "_text", "word", "item_id", "cosine"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    left = decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and [(r.doc_id, r["_found"]) for r in left.collect()] == [(2, "own _found")]


def test_many_items_are_found_like_few(spark, monkeypatch):
    rng = random.Random(23)
    items = [(k, prose(rng, rng.randint(9, 14))) for k in range(6000)]
    wanted = rng.sample(range(6000), 40)
    texts = [(k, prose(rng, 40) + "\n" + items[k][1] + "\n" + prose(rng, 40)) for k in wanted] + [(10_000 + k, prose(rng, 100)) for k in range(40)]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench, rank=32).collect()}
    assert {(k, k) for k in wanted} <= pairs
    # the same in blocks of another size
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 500)
    assert pairs == {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench, rank=32).collect()}


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    """Every item is searched, however many blocks of words there are, and no block holds more words than the bound."""
    rng = random.Random(26)
    items = [(k, prose(rng, 20)) for k in range(60)] + [(None, prose(rng, 20)), (99, "one two")]
    items.append((61, items[3][1]))
    texts = [(k, prose(rng, 30) + "\n" + t) for k, (_, t) in enumerate(items)] + [(1000 + k, prose(rng, 60)) for k in range(20)]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(str((r.doc_id, r.item_id)) for r in decontamination.matches(docs, bench).collect())
    monkeypatch.setattr(decontamination, "MAX_WORDS", 500)
    blocks = list(decontamination.item_blocks(bench, "item_id", "text"))
    assert len(blocks) == 5 and sorted(str(i) for b in blocks for i in b) == sorted(map(str, items))
    assert max(sum(len(t.split()) for _, t in b) for b in blocks) <= 500
    assert sorted(str((r.doc_id, r.item_id)) for r in decontamination.matches(docs, bench).collect()) == whole and len(whole) >= 64
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == list(range(1000, 1020))


def test_a_very_long_text_and_ties(spark):
    rng = random.Random(24)
    item = prose(rng, 20)
    long = prose(rng, 30_000)
    docs = frame(spark, [(1, long), (2, long + " " + item), (2, long + " " + item), (3, (item + " ") * 50), (4, item[:-1])])
    got = [r.doc_id for r in decontamination.matches(docs, spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")).collect()]
    assert sorted(got) == [2, 2, 2, 2, 3, 3, 4, 4]
