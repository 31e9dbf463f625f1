"""Order-dependent token budgets without giving one task an unbounded group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.session import cut_lineage


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "cum", slices: int | None = None
) -> DataFrame:
    """Inclusive running sum per key in order, safe for a key that holds most rows.

    Rows are range-partitioned by (keys, order), so a hot key is cut into consecutive slices; each
    slice is summed alone and then shifted by the total of the slices before it. The slice number is
    written out (checkpoint) before use, since a recomputed range partitioning may cut elsewhere.
    """
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(
        df.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn("_slice", F.spark_partition_id())
    )
    totals = cut.groupBy(*keys, "_slice").agg(F.sum(value).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(*keys, "_slice", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift"))
    local = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        cut.withColumn("_local", F.sum(value).over(local))
        .join(shifts, keys + ["_slice"])
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_local", "_shift", "_slice")
    )


#: Steps (distinct running totals) of a change's groups that are folded in one row.
CELL = 20_000


def _used(totals: list[np.ndarray], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """What groups take in turn, for any rest of the budget, as a step function: from rest breaks[i] on they take used[i]."""
    rest = np.arange(budget + 1)
    for steps in totals:
        fits = np.searchsorted(steps, rest, "right")
        rest = rest - np.where(fits > 0, np.append(steps, 0)[fits - 1], 0)
    used = np.arange(budget + 1) - rest
    breaks = np.flatnonzero(np.append(True, used[1:] != used[:-1]))
    return breaks, used[breaks]


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for i, budget in enumerate(batch.column("budget").to_pylist()):
            cells = batch.column("totals")[i].values
            made.append(_used([np.asarray(cells[k].values, dtype=np.int64) for k in range(len(cells))], max(int(budget), 0)))
        columns = [batch.column("pr_id"), batch.column("_cell"), batch.column("budget"), *[pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, ["pr_id", "_cell", "budget", "breaks", "used"])


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of the budget that each cell of a change finds; cells come in order and one number is carried."""
    change, rest = None, 0
    for batch in batches:
        out = []
        for i, (pr, budget) in enumerate(zip(batch.column("pr_id").to_pylist(), batch.column("budget").to_pylist(), strict=True)):
            if pr != change:
                change, rest = pr, max(int(budget), 0)
            out.append(rest)
            breaks, used = (np.asarray(batch.column(c)[i].values) for c in ("breaks", "used"))
            rest -= int(used[np.searchsorted(breaks, rest, "right") - 1])
        yield pa.RecordBatch.from_arrays([batch.column("pr_id"), batch.column("_cell"), pa.array(out, pa.int64())], ["pr_id", "_cell", "rest"])


def _packed(steps: DataFrame, group: list[str], cell: int) -> DataFrame:
    """Groups of a change in cells of about `cell` steps, with the rest of the budget that is left when a cell's turn comes.

    A change with few steps is one cell. What a cell takes is a step function of the rest it finds, known for all cells at once; following
    the functions along a change's cells gives every cell its rest.
    """
    sized = steps.withColumn("_w", F.size("steps").cast("bigint") + 1)
    large = cut_lineage(sized.groupBy("pr_id").agg(F.sum("_w").alias("_n")).where(F.col("_n") > cell).select("pr_id"))
    pack = F.sort_array(F.collect_list(F.struct(*group, "steps"))).alias("gs")
    one = steps.join(large, "pr_id", "left_anti").groupBy("pr_id").agg(F.max("budget").alias("budget"), pack)
    one = one.select("pr_id", "budget", "gs", F.col("budget").cast("bigint").alias("rest"), F.lit(False).alias("stop"))
    if large.isEmpty():
        return one
    numbered = running_total(sized.join(large, "pr_id", "left_semi"), ["pr_id"], group, "_w", "_at")
    cells = numbered.withColumn("_cell", F.expr(f"(_at - _w) div {cell}")).groupBy("pr_id", "_cell").agg(F.max("budget").alias("budget"), pack)
    cells = cut_lineage(cells)
    asked = cells.select("pr_id", "_cell", F.col("budget").cast("bigint").alias("budget"), F.transform("gs", lambda g: g["steps"]).alias("totals"))
    key = cells.schema["pr_id"].dataType.simpleString()
    functions = asked.mapInArrow(_functions, f"pr_id {key}, _cell bigint, budget bigint, breaks array<bigint>, used array<bigint>")
    rests = functions.repartition("pr_id").sortWithinPartitions("pr_id", "_cell").mapInArrow(_rests, f"pr_id {key}, _cell bigint, rest bigint")
    # Once the budget is used up, nothing more is taken, be it free.
    many = cells.join(rests, ["pr_id", "_cell"]).select("pr_id", "budget", "gs", "rest", ((F.col("_cell") > 0) & (F.col("rest") <= 0)).alias("stop"))
    return one.unionByName(many)


def budget_break(rows: DataFrame, budgets: DataFrame, group: list[str], order: list[str], cell: int = CELL) -> DataFrame:
    """Take rows (pr_id, group, order, tokens) under a budget per change.

    A group ends at its first row that does not fit; the next group goes on; all ends when the
    budget is used up. Per group only the distinct running totals up to the budget matter, and a change's groups are folded in cells of
    bounded size, so neither a change with very many rows nor one with very many groups is one row or one task. Rows that bring the running
    total of their group (cum) are not summed again. What comes after a group's first row over the budget is left out at once; that row stays, since
    a group counts as one of the change's though it takes nothing.
    """
    summed = rows if "cum" in rows.columns else running_total(rows, ["pr_id", *group], order, "tokens")
    cum = cut_lineage(summed.join(budgets, "pr_id").where("cum - coalesce(tokens, 0) <= budget"))
    # Written, since a change's size, its small and its large groups are asked for one after another.
    steps = cut_lineage(cum.groupBy("pr_id", *group).agg(
        F.max("budget").alias("budget"),
        F.array_sort(F.collect_set(F.when(F.col("cum") <= F.col("budget"), F.col("cum")))).alias("steps"),
    ))

    def step(acc: Column, g: Column) -> Column:
        fits = F.filter(g["steps"], lambda s: s <= acc["rest"])
        limit = F.when(~acc["stop"] & (F.size(fits) > 0), F.element_at(fits, -1))
        rest = acc["rest"] - F.coalesce(limit, F.lit(0))
        return F.struct(rest.alias("rest"), (acc["stop"] | (rest <= 0)).alias("stop"), F.concat(acc["limits"], F.array(limit)).alias("limits"))

    start = F.struct("rest", "stop", F.array().cast("array<bigint>").alias("limits"))
    limits = _packed(steps, group, cell).select("pr_id", "gs", F.aggregate("gs", start, step, lambda a: a["limits"]).alias("limits"))
    limits = limits.select("pr_id", F.explode(F.arrays_zip("gs", "limits")).alias("z")).select(
        "pr_id", *[F.col(f"z.gs.{c}").alias(c) for c in group], F.col("z.limits").alias("limit")
    )
    return cum.join(limits, ["pr_id", *group]).where(F.col("cum") <= F.col("limit")).select(*rows.columns)


def budget_skip(items: DataFrame, budget: str = "budget", order: str = "ord", keep: int = C.SYMBOLS_PER_PR) -> DataFrame:
    """Take items in order, skipping those that do not fit; only the first keep items are offered.

    items: pr_id, order, tokens, budget, and what is to be kept. The offer is at most keep rows per
    change, cut by a ranked limit that Spark also applies before the shuffle.
    """
    w = W.partitionBy("pr_id").orderBy(order)
    offered = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    packed = offered.groupBy("pr_id").agg(
        F.max(budget).alias("_b"), F.sort_array(F.collect_list(F.struct("_n", "tokens"))).alias("_i")
    )
    taken = packed.select(
        "pr_id",
        F.explode(
            F.aggregate(
                "_i",
                F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("ns")),
                lambda a, i: F.when(a["used"] + i["tokens"] > F.col("_b"), a).otherwise(
                    F.struct((a["used"] + i["tokens"]).alias("used"),
                             F.concat(a["ns"], F.array(i["_n"])).alias("ns"))
                ),
                lambda a: a["ns"],
            )
        ).alias("_n"),
    )
    return offered.join(taken, ["pr_id", "_n"], "left_semi").select(*items.columns)
