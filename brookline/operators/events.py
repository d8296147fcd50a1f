"""The event store: events found by rules, kept once each, linked to the rules' symbols up to a cap a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a later sighting of an event overwrites.
FIELDS = ["title", "occurred_at"]


def key_of(provider: Column, provider_event_id: Column) -> Column:
    """Key of a new event: any writer gives the same one."""
    return F.sha2(F.concat_ws("\x1f", provider, provider_event_id), 256)


def sightings(batch: DataFrame, known: DataFrame) -> DataFrame:
    """batch with event_key and is_head: the known event of the same provider and id, else of the same link; else that of the
    first of the batch with its id, or else its link. A head is a new event. Equi joins and windows of single ids and links only.
    """
    by_id = known.select("provider", "provider_event_id", F.col("event_key").alias("_a"))
    by_url = known.groupBy("provider", "canonical_url").agg(F.min("event_key").alias("_b"))
    met = batch.join(by_id, ["provider", "provider_event_id"], "left").join(by_url, ["provider", "canonical_url"], "left").withColumn("_known", F.coalesce("_a", "_b"))
    place = [F.col("rule_id"), F.col("occurred_at"), F.col("provider_event_id"), F.col("canonical_url")]
    same_id, same_url = (W.partitionBy("provider", c).orderBy(*place) for c in ("provider_event_id", "canonical_url"))
    first = met.withColumn("_of_id", F.row_number().over(same_id) == 1).withColumn("_url", F.first("canonical_url").over(same_id))
    head = first.withColumn("_new", F.col("_of_id") & F.col("_known").isNull())
    head = head.withColumn("is_head", F.col("_new") & (F.sum(F.col("_new").cast("int")).over(same_url.rowsBetween(W.unboundedPreceding, W.currentRow)) == 1))
    heads = head.where("is_head").select("provider", F.col("canonical_url").alias("_url"), key_of(F.col("provider"), F.col("provider_event_id")).alias("_made"))
    keyed = head.join(heads, ["provider", "_url"], "left")
    return keyed.withColumn("event_key", F.coalesce("_known", "_made")).drop("_a", "_b", "_known", "_of_id", "_url", "_new", "_made")


def store(known: DataFrame, links: DataFrame, batch: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(events, links) after a batch of sightings (rule_id, symbol, provider, provider_event_id, canonical_url and FIELDS).

    Oldest first, a sighting is taken while its rule's links of that UTC day are below the cap; it adds its event, or
    overwrites the FIELDS of the one that is there, and links it, once for each rule and symbol. Links that exist do not
    count again. Links: (event_key, symbol, rule_id). A window holds one rule's sightings of one day.
    """
    day = F.to_date("occurred_at")
    had = links.join(known.select("event_key", day.alias("day")), "event_key").groupBy("rule_id", "day").agg(F.count("*").alias("_had"))
    place = [F.col("occurred_at"), F.col("provider_event_id"), F.col("canonical_url")]
    seen = sightings(batch, known).withColumn("day", day)
    linked = links.select("event_key", "symbol", "rule_id", F.lit(True).alias("_linked"))
    marked = seen.join(linked, ["event_key", "symbol", "rule_id"], "left")
    once = F.row_number().over(W.partitionBy("event_key", "symbol", "rule_id").orderBy(*place)) == 1
    marked = marked.withColumn("_new", (once & F.col("_linked").isNull()).cast("int"))
    before = F.coalesce(F.sum("_new").over(W.partitionBy("rule_id", "day").orderBy(*place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = marked.withColumn("_before", before).join(had, ["rule_id", "day"], "left").where(F.col("_before") + F.coalesce("_had", F.lit(0)) < cap)
    fields = F.struct("rule_id", *place, *[F.col(c) for c in FIELDS if c != "occurred_at"])
    last = taken.groupBy("event_key").agg(F.max(fields).alias("_last"))
    own = taken.groupBy("event_key").agg(F.min(F.struct("rule_id", *place, "provider")).alias("_first"))
    updated = known.join(last, "event_key", "left").withColumns({c: F.coalesce(F.col(f"_last.{c}"), F.col(c)) for c in FIELDS}).drop("_last")
    added = last.join(own, "event_key").join(known.select("event_key"), "event_key", "left_anti")
    added = added.select("event_key", F.col("_first.provider").alias("provider"), F.col("_first.provider_event_id").alias("provider_event_id"), F.col("_first.canonical_url").alias("canonical_url"), *[F.col(f"_last.{c}").alias(c) for c in FIELDS])
    return updated.unionByName(added), links.unionByName(taken.where("_new = 1").select("event_key", "symbol", "rule_id"))
