"""Analysis of optimization histories: run_id, iteration, total_loss, pos_grad, rad_grad, ... a row for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sphaera.functions.scalar import round_sig5


def _by_iteration():
    return W.partitionBy("run_id").orderBy("iteration")


def convergence(steps: DataFrame, window: int, threshold: float, small: float = 1e-4) -> DataFrame:
    """steps with loss_change, small_grads and converged over the last ``window`` rows; null where there are fewer."""
    w = _by_iteration().rowsBetween(1 - window, 0)
    first = F.first("total_loss").over(w)
    full = F.count("*").over(w) == window
    change = F.abs(first - F.col("total_loss")) / F.greatest(F.abs(first), F.lit(1e-5))
    n_small = F.count_if((F.col("pos_grad") < small) & (F.col("rad_grad") < small)).over(w)
    out = steps.withColumn("loss_change", F.when(full, change)).withColumn("small_grads", F.when(full, n_small > window // 2))
    return out.withColumn("converged", (F.col("loss_change") < threshold) | F.col("small_grads"))


def density_trigger(steps: DataFrame, interval: int, patience: int = 1, small: float = 1e-4) -> DataFrame:
    """steps, which have last_event (the iteration of the last pass, 0 before the first), with trigger."""
    w = _by_iteration().rowsBetween(1 - patience, 0)
    first = F.first("total_loss").over(w)
    plateau = F.abs(first - F.col("total_loss")) / F.greatest(F.abs(first), F.lit(1e-5)) < 0.01
    few = lambda c: F.count_if(F.col(c) < small).over(w) > patience // 2
    enough = F.count("*").over(w) == patience
    since = F.greatest(F.col("iteration") - F.col("last_event"), F.lit(0))
    return steps.withColumn("trigger", F.when(since < interval, False).when(since > 2 * interval, True).otherwise(enough & (plateau | (few("pos_grad") & few("rad_grad")))))


def thinned(steps: DataFrame, k: int) -> DataFrame:
    """At most k rows of each run by position: where i steps of (n - 1) / (k - 1), cut to whole numbers, lie, the last row for the last step; losses have 5 significant digits."""
    by_run = W.partitionBy("run_id")
    ranked = steps.withColumn("pos", F.row_number().over(_by_iteration()) - 1).withColumn("n", F.count("*").over(by_run))
    step = (F.col("n") - 1) / F.lit(float(max(k - 1, 1)))
    near = F.floor(F.col("pos") / step)  # the products are rounded, so the step that hits may be next to it
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = near + d
        hit = hit | ((i >= 0) & (i < max(k - 1, 1)) & (F.floor(i * step) == F.col("pos")))
    last = (F.col("pos") == F.col("n") - 1) if k > 1 else F.lit(False)
    out = ranked.where((F.col("n") <= k) | hit | last).drop("pos", "n")
    return out.withColumn("total_loss", round_sig5("total_loss")) if "total_loss" in out.columns else out


def iteration_statistics(spheres: DataFrame) -> DataFrame:
    """run_id, iteration, num_spheres, min_r, max_r, mean_r of rows of a sphere each."""
    return spheres.groupBy("run_id", "iteration").agg(F.count("*").alias("num_spheres"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.avg("r").alias("mean_r"))


def latest(steps: DataFrame) -> DataFrame:
    """The last row of each run by one aggregate."""
    rest = [c for c in steps.columns if c != "run_id"]
    return steps.groupBy("run_id").agg(F.max_by(F.struct(*rest), "iteration").alias("s")).select("run_id", "s.*")


def to_json(steps: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, history: the JSON of a run, a list for each series in the order of iterations; runs are bounded by their iterations."""
    series = [c for c in steps.columns if c != "run_id"]
    lists = F.sort_array(F.collect_list(F.struct("iteration", *(c for c in series if c != "iteration"))))
    runs = steps.groupBy("run_id").agg(lists.alias("s"))
    passes = events.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in events.columns if c != "run_id")))).alias("density_control_events"))
    at = runs.join(passes, "run_id", "left")
    empty = F.array().cast(passes.schema["density_control_events"].dataType)
    return at.select("run_id", F.to_json(F.struct(*(F.col(f"s.{c}").alias(c) for c in series), F.coalesce("density_control_events", empty).alias("density_control_events"))).alias("history"))
