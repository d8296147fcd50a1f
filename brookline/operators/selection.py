"""Values at given ranks of each group, without holding or sorting a large group anywhere.

A group of at most SMALL values is a bounded list. For larger ones a quantile sketch of each group, combined on the map side, proposes two
values around the rank, and exact counts below, at, between and above them tell in which part the rank is. Either one of the two
values is the answer, or the search goes on strictly within that part, so every round ends with fewer values, whatever the sketch
was worth; with a good one a part has some hundredth of the values. What moves are sketches and counts, never the values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline import session

#: Values of a group that may be held as a list; steps of the sketch's grid, and its accuracy.
SMALL, STEPS, ACCURACY = 10_000, 256, 10_000
Rank = Callable[[Column], Column]


def floor_rank(fraction: float) -> Rank:
    """Place, from 0, of the value at floor((n - 1) * fraction); the fraction is held to 0..1."""
    return lambda n: F.floor((n - 1) * F.lit(min(1.0, max(0.0, fraction)))).cast("long")


def nearest_rank(per_cent: float) -> Rank:
    """Place, from 0, of the value at rank ceil(per_cent / 100 * n), the first at least."""
    return lambda n: (F.least(F.greatest(F.ceil(F.lit(per_cent / 100) * n), F.lit(1)), n) - 1).cast("long")


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{session.shared_folder(df.sparkSession)}/selection-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """One row for each group with a value that is not NULL: the keys, and the value at each rank under its name."""
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"))
    groups = [f"_k{i}" for i in range(len(keys))]
    sizes = kept(rows.groupBy(*groups).agg(F.count("*").alias("_n")))
    back = [F.col(g).alias(k) for g, k in zip(groups, keys)]
    most = sizes.agg(F.max("_n")).first()[0] or 0
    pick = lambda name: F.element_at("_p", (ranks[name](F.size("_p")) + 1).cast("int")).alias(name)
    few = rows if most <= SMALL else joined(rows, sizes.where(F.col("_n") <= SMALL).select(*groups), groups)
    lists = few.groupBy(*groups).agg(F.sort_array(F.collect_list("_v")).alias("_p"))  # at most SMALL
    out = lists.select(*back, *map(pick, ranks))
    if most <= SMALL:
        return out
    large = sizes.where(F.col("_n") > SMALL)
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).alias("_rank")) for name, rank in ranks.items()]))
    found = searched(rows, groups, large.select(*groups, asked.alias("_a")).select(*groups, "_a.*"))
    wide = found.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return out.unionByName(wide.select(*back, *ranks))


def joined(rows: DataFrame, state: DataFrame, groups: list[str]) -> DataFrame:
    """Rows with the state of their group; a NULL key is a key. The state is small or spread by its keys; a hot key is split by the adaptive skew join."""
    other = state.select(*[F.col(c).alias(f"{c}_s") if c in groups else F.col(c) for c in state.columns])
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_s"))
    return rows.join(other, same).drop(*[f"{g}_s" for g in groups])


def searched(rows: DataFrame, groups: list[str], asked: DataFrame) -> DataFrame:
    """(groups, _name, _v) of the ranks asked for: the part between two values, both excluded, that holds a rank is narrowed down."""
    kind, keys = rows.schema["_v"].dataType, [*groups, "_name"]
    state = kept(asked.withColumns({"_low": F.lit(None).cast(kind), "_high": F.lit(None).cast(kind)}))
    inside = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high")))
    grid, found = [i / STEPS for i in range(STEPS + 1)], []
    while not state.isEmpty():
        part = joined(rows, state, groups).where(inside)
        sketch = part.groupBy(*keys).agg(F.first("_rank").alias("_rank"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.count("*").alias("_n"), F.percentile_approx("_v", grid, ACCURACY).alias("_q"))
        step = F.floor(F.col("_rank") * STEPS / F.col("_n")).cast("int")
        guess = kept(sketch.select(*keys, "_rank", "_low", "_high", F.element_at("_q", F.greatest(step - 1, F.lit(0)) + 1).alias("_a"), F.element_at("_q", F.least(step + 2, F.lit(STEPS)) + 1).alias("_b")))
        v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
        tallies = {"_below": v < a, "_at_a": v == a, "_between": (v > a) & (v < b), "_at_b": (v == b) & (a < b)}
        counts = joined(rows, guess, groups).where(inside).groupBy(*keys, "_rank", "_low", "_high", "_a", "_b").agg(*[F.count_if(c).alias(n) for n, c in tallies.items()])
        ends, total = {}, F.lit(0)
        for name in tallies:
            ends[name], total = (total, total + F.col(name)), total + F.col(name)
        rank = F.col("_rank")
        where = F.lit("above")
        for name in reversed(tallies):
            where = F.when(rank < ends[name][1], name).otherwise(where)
        told = kept(counts.withColumn("_where", where))
        found.append(told.where("_where IN ('_at_a', '_at_b')").select(*keys, F.when(F.col("_where") == "_at_a", a).otherwise(b).alias("_v")))
        went = F.col("_where")
        start = F.when(went == "_below", F.lit(0)).when(went == "_between", ends["_between"][0]).otherwise(total)
        rest = told.where("_where NOT IN ('_at_a', '_at_b')").select(
            *keys, (rank - start).alias("_rank"), F.when(went == "_below", F.col("_low")).when(went == "_between", a).otherwise(b).alias("_low"),
            F.when(went == "_below", a).when(went == "_between", b).otherwise(F.col("_high")).alias("_high"),
            F.when(went == "_between", F.col("_between")).alias("_left"),
        )
        short = rest.where(F.col("_left") <= SMALL).drop("_left")
        lists = joined(rows, short, groups).where(inside).groupBy(*keys, "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_p"))  # at most SMALL
        found.append(lists.select(*keys, F.element_at("_p", (F.col("_rank") + 1).cast("int")).alias("_v")))
        state = kept(rest.where(~F.coalesce(F.col("_left") <= SMALL, F.lit(False))).drop("_left"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
