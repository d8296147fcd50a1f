"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only.

Each source has a target: its weighted share of the mix, held at MAX_COPIES times what it has, the excess reshared by
weight among the others. A source wants m = target / size copies of its words. Each document gets floor(m) whole copies for
certain; one more it gets with an inclusion probability p of its own, by its length: with r = m - floor(m),
p = r + min(r, 1 - r) * (g - mean of g), where g = size / (size + HALF) rises from 0 to 1 and its mean is weighted by size.
So p is between 0 and 1, longer documents are likelier, and the expected words are the target's. With a weight column, a
document instead wants m in proportion to its weight. Documents are then ranked by q = (u / (1 - u)) / (p / (1 - p)), the
random odds over the inclusion odds, with u a seeded hash of the document, and the lowest are taken until the source's words
are as near to the target as whole documents allow.

The order statistic is turned into prefix sums by running_rank() over fine steps of ln q, so that a source with a third
of all words is never sorted in one task; neither is the table of sources, however many there are.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own and comes last; a null or
non-positive weight counts as 1; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm.shared import col, documents, ordered_rank, packed, running_rank, stage, unpacked, word_count

WEIGHTS, SHARE, MAX_COPIES, SEED = (3, 1, 2), 1.5, 2, "pareto-1"
#: Words at which a document's g is a half; g is kept in thousandths, so that sums do not depend on their order.
HALF = 512
#: Steps of ln q for the prefix sums; at most about 0.02 % of a source's documents fall into one.
STEPS, SPAN = 1024, 40


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with target: the level at which sum(min(cap, weight * level)) is the whole share."""
    by_name = F.col("source").asc_nulls_last()
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    placed = ordered_rank(sizes, [by_name])
    weighed = placed.select("source", "source_size", F.element_at(weights, (F.col("before") % len(WEIGHTS) + 1).cast("int")).alias("w"), (F.col("source_size") * MAX_COPIES).alias("cap"))
    # the level if all sources before this one, in the order in which they fill up, are held at their caps
    filling = ordered_rank(weighed, [F.col("cap") / F.col("w"), by_name], "cap", "w")
    level = (F.col("whole_cap") / MAX_COPIES * SHARE - F.col("before_cap")) / (F.col("whole_w") - F.col("before_w"))
    tried = stage(filling.withColumn("level", level).select("source", "source_size", "w", "cap", "level"), "mix-levels")
    # the first source that does not fill up sets the level; those after it would only lower it
    final = tried.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.max("level")).first()[0]
    return tried.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(final).cast("double")).alias("target"))


def by_source(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with the columns that table has for its source; null is a source too."""
    renamed = table.withColumnRenamed("source", "_s")
    return df.join(renamed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def drawn(df: DataFrame) -> DataFrame:
    """Adds _whole, the copies taken for certain, _p, the probability of one more, and _q, the logarithm of the odds ratio."""
    own = F.least(F.lit(float(MAX_COPIES)), F.col("target") * F.col("_k") / F.col("_mass"))
    level = F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.col("source_size"))
    some = F.col("source_size") > 0
    split = df.withColumn("_m", F.when(some & F.col("_k").isNull(), level).when(F.col("_mass") > 0, own).otherwise(F.lit(0.0))).withColumn("_whole", F.floor("_m"))
    rest = F.col("_m") - F.col("_whole")
    bent = (F.col("_g") - F.col("_bent") / F.col("source_size")) / F.lit(1000.0)
    split = split.withColumn("_p", F.when(some & F.col("_k").isNull(), rest + F.least(rest, 1 - rest) * bent).otherwise(rest))
    q = F.ln(F.col("_u") / (1 - F.col("_u"))) - F.ln(F.col("_p") / (1 - F.col("_p")))
    return split.withColumn("_q", F.when(F.col("_p") > 0, q))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) of docs in a struct `row`, with size, source_size, target and copies (0 to MAX_COPIES)."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    weight_of = F.when(col(weight) > 0, col(weight)).otherwise(1.0) if weight else F.lit(None)
    row = packed(docs.select(*[col(c) for c in carry]) if carry else docs)
    sized = stage(docs.select(row, col(source).alias("source"), word_count(col(text)).alias("size"), ((digits + F.lit(0.5)) / F.lit(float(1 << 52))).alias("_u"), weight_of.cast("double").alias("_k"), F.monotonically_increasing_id().alias("_uid")).withColumn("_g", F.expr(f"size * 1000 div (size + {HALF})")), "mix-rows")
    totals = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("_k") * F.col("size")).alias("_mass"), F.sum(F.col("_g") * F.col("size")).alias("_bent")), "mix-totals")
    goal = by_source(totals.select("source", "_mass", "_bent"), targets(totals.select("source", "source_size")))
    order = F.struct("_q", "_u", "size", "_uid")
    thin = drawn(by_source(sized.select("_uid", "source", "size", "_u", "_k", "_g"), goal))
    step = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("_q"))) * STEPS).cast("int")
    ranked = running_rank(thin.where("_p > 0").withColumn("_b", step).withColumn("_draw", F.col("size")), ["source"], "_b", [order], "_draw")
    certain = thin.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    # the nearest cut: a document is taken if at least half of it is still wanted, so what is taken is a prefix
    taken = by_source(ranked, certain).where(F.col("_certain") + F.col("before") + F.col("size") / 2 <= F.col("target"))
    cuts = taken.groupBy("source").agg(F.max(order).alias("_cut"))
    plan = stage(goal.join(cuts.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c"), "mix-plan")
    extra = F.when((F.col("_p") > 0) & (order <= F.col("_cut")), 1).otherwise(0)
    return drawn(by_source(sized, plan)).select("row", "size", "source_size", "target", (F.col("_whole") + extra).cast("int").alias("copies"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was taken, with the columns of docs."""
    mixed = mix(docs).where("copies > 0")
    return unpacked(mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir, "doc_id", "text", "source"), carry=["doc_id", "source"])
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("row.source").alias("source"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * (size * 1000 // (size + {HALF})))::BIGINT AS bent, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
  FROM d GROUP BY source
), filling AS (
  SELECT *, {MAX_COPIES} * source_size AS cap,
    (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum({MAX_COPIES} * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY {MAX_COPIES} * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, bent, least(cap::DOUBLE, w * max(CASE WHEN level * w <= cap THEN level END) OVER ()) AS target FROM filling
), m AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least({MAX_COPIES}::DOUBLE, t.target / t.source_size::DOUBLE) ELSE 0 END AS m,
    CASE WHEN t.source_size > 0 THEN (size * 1000 // (size + {HALF}) - t.bent / t.source_size::DOUBLE) / 1000::DOUBLE ELSE 0 END AS bend
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(m) AS whole, m - floor(m) + least(m - floor(m), 1 - (m - floor(m))) * bend AS p FROM m
), q AS (
  SELECT *, CASE WHEN p > 0 THEN ln(u / (1 - u)) - ln(p / (1 - p)) END AS q FROM p
), c AS (
  SELECT *, sum(whole * size) OVER (PARTITION BY source) + coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND before + size / 2.0 <= target THEN 1 ELSE 0 END))::BIGINT AS taken, source FROM c
"""
