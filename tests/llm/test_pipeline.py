"""The pipeline over a small corpus with planted cases, and over an empty table."""

import random

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, prose


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    good = [(k, prose(rng, rng.randint(40, 120))) for k in range(150)]
    junk = [(200 + k, "\n".join(["##$$ " + prose(rng, 4) + " |||"] * 6)) for k in range(60)]
    item = prose(rng, 30)
    planted = [(300, good[0][1]), (301, prose(rng, 60) + "\n" + item), (302, prose(rng, 50) + " a.b@c.org " + prose(rng, 50)), (303, None), (304, ""), (None, prose(rng, 90))]
    rows = [(k, t, "en", None if k == 7 else f"s{(k or 0) % 3}", len(t or ""), "x", 1, 0.5, 1, 3) for k, t in good + junk + planted]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k, _ in good[:100]] + [(k, 0, 0) for k, _ in junk[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        if name != "mixture":
            assert after.columns == docs.columns
        docs = after
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    quality, unique, clean, private, mixed = kept
    assert {k for k, _ in good} <= quality and len({k for k, _ in junk} & quality) <= 3
    assert 300 in quality and 300 not in unique and 0 in unique
    assert 301 in unique and 301 not in clean
    assert clean == private and mixed <= private
    assert all("@" not in r.text for r in docs.where("doc_id = 302").collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
