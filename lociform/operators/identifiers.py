"""Identifiers of variants: matching to a list of known ones, and the chain of recovery where that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.scalar import stable_id

#: Unmatched variants of a dataset from which no service is asked for them: so many tell of a wrong build.
MOST_ASKED = 2000


def newest(records: Column) -> Column:
    """Of records in order (newest build first, unknown builds last, then as listed): the first, or the last where no build is known; null of none."""
    first = F.get(records, F.lit(0))
    return F.when(first["build"].isNotNull(), first).otherwise(F.try_element_at(records, F.lit(-1)))


def matched(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (chr, pos, ea, nea, ...) with rsid, reason, candidate and n_candidates.

    known: chr, pos, ref, alts (an array), rsid, build (null where unknown) and line, its place in the list.
    Forward: nea is ref and ea one of alts; reverse: the other way round, which counts if nothing is forward.
    Of several records the newest build counts, and the last one where no build is known.  Where only the
    position is known, rsid is null and candidate names the newest record there.  A null allele matches nothing.

    The records of a position come together as one list before they meet rows, so that rows are never multiplied.
    """
    record = F.struct((-F.coalesce("build", F.lit(-1))).alias("age"), "line", "rsid", F.upper("ref").alias("ref"), F.transform("alts", lambda a: F.upper(a)).alias("alts"), "build")
    places = known.where("rsid is not null").groupBy("chr", "pos").agg(F.array_sort(F.collect_list(record)).alias("_known"))
    ea, nea = F.upper("ea"), F.upper("nea")
    forward = F.filter("_known", lambda r: F.coalesce((r["ref"] == nea) & F.array_contains(r["alts"], ea), F.lit(False)))
    reverse = F.filter("_known", lambda r: F.coalesce((r["ref"] == ea) & F.array_contains(r["alts"], nea), F.lit(False)))
    met = rows.join(places, ["chr", "pos"], "left").withColumn("_f", newest(forward)).withColumn("_r", newest(reverse))
    reason = (
        F.when(F.col("_known").isNull(), "no_pos").when(F.col("_f").isNotNull(), "matched_forward")
        .when(F.col("_r").isNotNull(), "matched_reverse").otherwise("pos_only_allele_mismatch")
    )
    rsid = F.coalesce("_f.rsid", "_r.rsid")
    candidate = F.when(rsid.isNull(), newest(F.col("_known"))["rsid"])
    return met.select(*rows.columns, rsid.alias("rsid"), reason.alias("reason"), candidate.alias("candidate"), F.coalesce(F.size("_known"), F.lit(0)).cast("long").alias("n_candidates"))


def recovered(rows: DataFrame, known: DataFrame, answers: DataFrame, others: DataFrame, dataset: str = "ds", most: int = MOST_ASKED) -> DataFrame:
    """rows with rsid, step (local, service, other file or missing), asked and from_dataset.

    known as for matched().  A dataset with fewer than most unmatched rows has the service asked for them: answers
    (key, rsid) are its stored replies, key being stable_id.  others: dataset, chr, pos, ea, nea and rsid of other
    files, of which the smallest dataset counts, then the smallest id.  What none of them knows is missing.
    """
    first = matched(rows, known).withColumn("_key", stable_id(F.col("chr"), F.col("pos"), F.col("ea"), F.col("nea")))
    left = first.where("rsid is null").groupBy(F.col(dataset).alias("_ds")).agg(F.count("*").alias("_left"))
    # a row for each dataset
    told = first.join(F.broadcast(left), F.col(dataset).eqNullSafe(F.col("_ds")), "left").withColumn("asked", F.col("rsid").isNull() & (F.col("_left") < most))
    replies = answers.where("rsid is not null").groupBy(F.col("key").alias("_key")).agg(F.min("rsid").alias("_reply"))
    elsewhere = others.where("rsid is not null").groupBy(stable_id(F.col("chr"), F.col("pos"), F.col("ea"), F.col("nea")).alias("_key"))
    elsewhere = elsewhere.agg(F.min(F.struct(F.col(dataset).alias("at"), F.col("rsid").alias("id"))).alias("_other"))
    met = told.join(replies, "_key", "left").join(elsewhere, "_key", "left")
    reply = F.when(F.col("asked"), F.col("_reply"))
    step = F.when(F.col("rsid").isNotNull(), "local").when(reply.isNotNull(), "service").when(F.col("_other").isNotNull(), "other file").otherwise("missing")
    done = met.withColumn("step", step).withColumn("_id", F.coalesce("rsid", reply, "_other.id"))
    return done.select(*rows.columns, F.col("_id").alias("rsid"), "step", "asked", F.when(F.col("step") == "other file", F.col("_other.at")).alias("from_dataset"))
