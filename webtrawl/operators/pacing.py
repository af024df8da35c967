"""Fetch pacing: at most ``limit`` fetches of a root in any window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtrawl.functions.times import MICROS, floor_div, from_micros, micros
from webtrawl.operators.ordered import TASK_ROWS, has_large_group, rank_rows, running_max

# Three fetches a second.
MAX_FETCHES = 3
WINDOW_SECONDS = 1

# A bucket spans this many windows, so 1/64 of the rows are copied to the next one.
_WINDOWS_PER_BUCKET = 64


def rate_audit(
    fetches: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    limit: int = MAX_FETCHES,
) -> DataFrame:
    """Fetches of the same root in the window ending at each fetch, both ends included.

    ``fetches`` needs root and ts.  A root's history is cut into time buckets;
    the tail of each bucket is copied to the next one, where it only counts.
    One shuffle, and no task holds more than a bucket of one root.
    """
    window = window_seconds * MICROS
    width = window * _WINDOWS_PER_BUCKET
    at = micros(F.col("ts"))
    own = floor_div(F.col("_at"), width)
    tail = F.col("_at") + window >= (own + 1) * width
    rows = (
        fetches.withColumn("_at", at)
        .withColumn("_own", own)
        .withColumn("_bucket", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    )
    # Each fetch counts one from its instant on, and is taken off again after the
    # window: a running sum, which a frame of unbounded start adds up in one pass.
    enters = F.struct(F.col("_at").alias("when"), F.lit(1).alias("step"))
    leaves = F.struct((F.col("_at") + window + 1).alias("when"), F.lit(-1).alias("step"))
    steps = rows.withColumn("_step", F.explode(F.array(enters, leaves))).withColumns(
        {"_when": F.col("_step.when"), "_add": F.col("_step.step")}
    )
    so_far = (
        Window.partitionBy("root", "_bucket")
        .orderBy("_when")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        steps.withColumn("in_window", F.sum("_add").over(so_far))
        .where((F.col("_add") == 1) & (F.col("_bucket") == F.col("_own")))
        .withColumn("over_limit", F.col("in_window") > limit)
        .drop("_at", "_own", "_bucket", "_step", "_when", "_add")
    )


def paced_schedule(
    arrivals: DataFrame,
    tie: str,
    window_seconds: int = WINDOW_SECONDS,
    limit: int = MAX_FETCHES,
    admitted: DataFrame | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Earliest start of each fetch that keeps its root under the limit.

    ``arrivals`` needs root and ts; ``tie`` orders equal instants.  The i-th
    arrival starts at ``max(t_i, start_(i-limit) + w)``.  Arrivals that are
    ``limit`` apart form a chain, and along a chain ``start - m * w`` is the
    running maximum of ``t - m * w``: no loop over rows.

    ``admitted`` (root, slot, at) holds the last starts of earlier batches:
    slot ``limit - s`` is the s-th last one, ``at`` in microseconds.  A row that
    comes later than its batch takes the earliest place after those starts.
    """
    # A slot is free only when more than the window has passed.
    w = window_seconds * MICROS + 1
    rows = arrivals.withColumn("_at", micros(F.col("ts")))
    if admitted is not None:
        newest = admitted.groupBy("root").agg(F.max("at").alias("_newest"))
        rows = rows.join(newest, "root", "left").withColumn("_at", F.greatest("_at", "_newest"))
    large = has_large_group(arrivals, ["root"], task_rows)
    ranked = rank_rows(rows, ["root"], ["_at", "ts", tie], "_i", large=large)
    chained = (
        ranked.withColumn("_slot", ((F.col("_i") - 1) % limit).cast("int"))
        .withColumn("_m", floor_div(F.col("_i") - 1, limit))
        .withColumn("_slack", F.col("_at") - F.col("_m") * w)
    )
    if large:
        run = running_max(chained, ["root", "_slot"], "_m", "_slack", "_run", task_rows)
    else:
        so_far = (
            Window.partitionBy("root", "_slot")
            .orderBy("_m")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        run = chained.withColumn("_run", F.max("_slack").over(so_far))
    if admitted is not None:
        earlier = admitted.select("root", F.col("slot").alias("_slot"), (F.col("at") + w).alias("_free"))
        run = run.join(earlier, ["root", "_slot"], "left").withColumn(
            "_run", F.greatest("_run", "_free")
        )
    start = F.col("_run") + F.col("_m") * w
    return run.select(
        *arrivals.columns,
        from_micros(start).alias("start_ts"),
        (start - micros(F.col("ts"))).alias("delay_us"),
    )


def last_admitted(schedule: DataFrame, admitted: DataFrame | None, limit: int = MAX_FETCHES) -> DataFrame:
    """The state to hand to the next batch: each root's last ``limit`` starts.

    Starts never fall along a root's order, so the last ones are the greatest.
    """
    starts = schedule.select("root", micros(F.col("start_ts")).alias("at"))
    if admitted is not None:
        starts = starts.unionByName(admitted.select("root", "at"))
    # Salted first pass: each salt keeps its own greatest, then the salts meet.
    salted = starts.withColumn("_salt", F.pmod(F.xxhash64("root", "at"), F.lit(64)))
    greatest = Window.partitionBy("root", "_salt").orderBy(F.desc("at"))
    overall = Window.partitionBy("root").orderBy(F.desc("at"))
    return (
        salted.withColumn("_r", F.row_number().over(greatest))
        .where(F.col("_r") <= limit)
        .withColumn("_s", F.row_number().over(overall))
        .where(F.col("_s") <= limit)
        .select("root", (F.lit(limit) - F.col("_s")).alias("slot"), "at")
    )


def fair_order(waiting: DataFrame, order: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """One url of each root per turn, first come first served within a root.

    The result is sorted by turn, then root.
    """
    return rank_rows(waiting, ["root"], order, "turn", task_rows).orderBy("turn", "root")
