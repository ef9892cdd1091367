"""Tables of a dataset folder and the association-study views over them.

The views project the star-schema test tables deterministically: line items are variant rows of six
datasets, parts are genes, events are regulatory peaks, orders are catalogued associations.  Each view
has the same definition as SQL text (``SQL``) for checks by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _letter(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, "ACGT")), index.cast("int") + 1)


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """vid, ds, chr, pos, ea, nea, beta, se, z (absolute) and maf of each variant row."""
    d = table(spark, folder, "lineitem")
    x = (F.col("l_quantity") - 25.5) / 24.5 * (F.col("l_discount") / 0.1)
    part = F.col("l_partkey")
    return d.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + part % 1_000_000).cast("long").alias("vid"),
        (F.col("l_suppkey") % 6).cast("int").alias("ds"),
        (part % 22 + 1).cast("int").alias("chr"),
        (part * 4999 % 10_000_000 + 1).cast("long").alias("pos"),
        _letter(part % 4).alias("ea"),
        _letter((part + 1 + F.floor(part / 4) % 3) % 4).alias("nea"),
        (x * x * x * 0.24).alias("beta"),
        (F.lit(0.03) + F.lit(0.1) * F.col("l_tax")).alias("se"),
        (part % 50 / 100.0).alias("maf"),
    ).withColumn("z", F.abs(F.col("beta") / F.col("se")))


def genes(spark: SparkSession, folder: str) -> DataFrame:
    start = F.col("p_partkey") * 7919 % 10_000_000 + 1
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("gid"), (F.col("p_partkey") % 22 + 1).cast("int").alias("chr"), start.alias("start"), (start + 2000 * F.col("p_size")).cast("long").alias("end"),
        F.col("p_name").alias("gene"), F.col("p_type").alias("biotype"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_size").alias("size"),
    )


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    start = F.col("event_id") * 3571 % 10_000_000
    return table(spark, folder, "events").select(
        F.col("event_id").alias("peak"), F.col("event_type").alias("mark"), (F.col("user_id") % 5).cast("int").alias("eid"), (F.col("event_id") % 22 + 1).cast("int").alias("chr"),
        start.alias("start"), (start + 2000 + F.floor(F.col("value") * 400).cast("long")).alias("end"), F.col("value").alias("signal"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cid"), F.concat(F.lit("rs"), (F.col("o_orderkey") % 5000).cast("string")).alias("rsid"), (F.col("o_custkey") % 22 + 1).cast("int").alias("chr"),
        (F.col("o_orderkey") * 7907 % 10_000_000 + 1).cast("long").alias("pos"), F.col("o_orderpriority").alias("trait"), (F.col("o_orderkey") * 31 % 400 / 10.0 + 1).alias("mlogp"),
    )


def dosages(spark: SparkSession, folder: str) -> DataFrame:
    """i and d: simulated dosages of 64 people, the sum of four consecutive vectors, so that neighbours are linked."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    out = e.select(F.col("vec_id").alias("i"), F.col("e").alias("d"))
    for k in (1, 2, 3):
        out = out.join(e.select((F.col("vec_id") - k).alias("i"), "e"), "i").select("i", F.zip_with("d", "e", lambda a, b: a + b).alias("d"))
    return out


#: People of a simulated panel, width of its blocks of linked variants, weight of a block, and the steps of its frequencies.
PEOPLE, LINKED, WEIGHT, STEP = 32, 50_000, 1.5, 0.05


def panel(spark: SparkSession, folder: str, population: int = 0) -> DataFrame:
    """chr, pos, a1, a2, freq and dosages (0 to 2 of a1 in each of 32 people) of the positions of variants.

    Haplotypes are the signs of a vector of the variant and one that its block of 50 kb shares, so that
    neighbours are linked; populations share neither.  Every fifth variant has its alleles the other way round.
    """
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = e.agg(F.count("*").alias("n_vectors"))  # one row
    part, pos = F.col("p_partkey"), F.col("p_partkey") * 4999 % 10_000_000 + 1
    rows = table(spark, folder, "part").select(part.alias("part"), (part % 22 + 1).cast("int").alias("chr"), pos.alias("pos")).join(F.broadcast(n))
    own = F.pmod(F.col("part") + 17 * population, F.col("n_vectors")).alias("own")
    block = F.pmod(F.col("chr") * 131 + F.floor(F.col("pos") / LINKED) + 7 * population, F.col("n_vectors")).alias("block")
    rows = rows.select("part", "chr", "pos", own, block)
    rows = rows.join(e.select(F.col("vec_id").alias("own"), F.col("e").alias("x")), "own").join(e.select(F.col("vec_id").alias("block"), F.col("e").alias("y")), "block")
    over = ((F.col("part") + population) % 7 - 3) * STEP
    sides = F.transform(F.zip_with("x", "y", lambda x, y: x + y * WEIGHT), lambda v: (v > over).cast("int"))
    dosage = F.transform(F.sequence(F.lit(1), F.lit(PEOPLE)), lambda k: F.element_at("side", k) + F.element_at("side", k + PEOPLE))
    ea, nea = _letter(F.col("part") % 4), _letter((F.col("part") + 1 + F.floor(F.col("part") / 4) % 3) % 4)
    turned = F.col("part") % 5 == 0
    out = rows.select("part", "chr", "pos", F.when(turned, nea).otherwise(ea).alias("a1"), F.when(turned, ea).otherwise(nea).alias("a2"), sides.alias("side"))
    out = out.select("chr", "pos", "a1", "a2", dosage.alias("dosages"))
    return out.select("chr", "pos", "a1", "a2", (F.aggregate("dosages", F.lit(0), lambda a, x: a + x) / (2.0 * PEOPLE)).alias("freq"), "dosages")


#: The same views for another engine; literals with an exponent are doubles there.
SQL = {
    "v": """v AS (SELECT *, abs(beta / se) AS z FROM (SELECT CAST((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS BIGINT) AS vid, CAST(l_suppkey % 6 AS INT) AS ds,
  CAST(l_partkey % 22 + 1 AS INT) AS chr, l_partkey * 4999 % 10000000 + 1 AS pos, ['A','C','G','T'][CAST(l_partkey % 4 + 1 AS INT)] AS ea,
  ['A','C','G','T'][CAST((l_partkey + 1 + (l_partkey // 4) % 3) % 4 + 1 AS INT)] AS nea, x * x * x * 0.24e0 AS beta, 0.03e0 + 0.1e0 * l_tax AS se, (l_partkey % 50) / 100.0e0 AS maf
  FROM (SELECT *, (l_quantity - 25.5e0) / 24.5e0 * (l_discount / 0.1e0) AS x FROM lineitem)))""",
    "g": """g AS (SELECT p_partkey AS gid, CAST(p_partkey % 22 + 1 AS INT) AS chr, p_partkey * 7919 % 10000000 + 1 AS "start",
  CAST(p_partkey * 7919 % 10000000 + 1 + 2000 * p_size AS BIGINT) AS "end", p_name AS gene, p_type AS biotype, p_brand AS brand,
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_size AS size FROM part)""",
    "k": """k AS (SELECT event_id AS peak, event_type AS mark, CAST(user_id % 5 AS INT) AS eid, CAST(event_id % 22 + 1 AS INT) AS chr, event_id * 3571 % 10000000 AS "start",
  event_id * 3571 % 10000000 + 2000 + CAST(floor(value * 400) AS BIGINT) AS "end", value AS signal FROM events)""",
    "pn": f"""pn AS (SELECT chr, pos, a1, a2, list_sum(dosages) / {2.0 * PEOPLE}e0 AS freq, dosages FROM (SELECT chr, pos, CASE WHEN part % 5 = 0 THEN nea ELSE ea END AS a1, CASE WHEN part % 5 = 0 THEN ea ELSE nea END AS a2,
    list_transform(range(1, {PEOPLE + 1}), lambda k: CAST(side[k] > (part % 7 - 3) * {STEP}e0 AS INT) + CAST(side[k + {PEOPLE}] > (part % 7 - 3) * {STEP}e0 AS INT)) AS dosages
  FROM (SELECT q.*, ['A','C','G','T'][CAST(part % 4 + 1 AS INT)] AS ea, ['A','C','G','T'][CAST((part + 1 + (part // 4) % 3) % 4 + 1 AS INT)] AS nea,
      list_transform(list_zip(o.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) + CAST(x[2] AS DOUBLE) * {WEIGHT}e0) AS side
    FROM (SELECT p_partkey AS part, CAST(p_partkey % 22 + 1 AS INT) AS chr, p_partkey * 4999 % 10000000 + 1 AS pos, n FROM part, (SELECT count(*) AS n FROM embeddings)) q
    JOIN embeddings o ON o.vec_id = part % n JOIN embeddings b ON b.vec_id = (chr * 131 + (pos - pos % {LINKED}) // {LINKED}) % n)))""",
    "c": """c AS (SELECT o_orderkey AS cid, 'rs' || (o_orderkey % 5000) AS rsid, CAST(o_custkey % 22 + 1 AS INT) AS chr, o_orderkey * 7907 % 10000000 + 1 AS pos,
  o_orderpriority AS trait, (o_orderkey * 31 % 400) / 10.0e0 + 1 AS mlogp FROM orders)""",
}
