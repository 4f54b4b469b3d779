"""Searches between points and spheres, keyed by run_id.

points: run_id, pid, x, y, z.  spheres: run_id, sid, cx, cy, cz, r.  Every join has the run
as an equality key, so it is a hash or merge join whose residual is the geometry, and what
follows it aggregates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.functions.scalar import dist

P, C = ("x", "y", "z"), ("cx", "cy", "cz")


def with_gap(points: DataFrame, spheres: DataFrame) -> DataFrame:
    """All pairs of a run with d, the distance to the center, and gap, d less the radius."""
    pairs = points.join(spheres, "run_id")
    return pairs.withColumn("d", dist(P, C)).withColumn("gap", F.col("d") - F.col("r"))


def nearest_sphere(points: DataFrame, spheres: DataFrame) -> DataFrame:
    """run_id, pid, gap, sid, d: the sphere of smallest gap for each point, the lowest sid among equals."""
    best = with_gap(points, spheres).groupBy("run_id", "pid").agg(F.min(F.struct("gap", "sid", "d")).alias("b"))
    return best.select("run_id", "pid", "b.gap", "b.sid", "b.d")


def least_gap(points: DataFrame, spheres: DataFrame, keep: tuple = ()) -> DataFrame:
    """run_id, pid, keep, gap: the smallest gap of each point; by hashing, as one number is the minimum of."""
    return with_gap(points, spheres).groupBy("run_id", "pid", *keep).agg(F.min("gap").alias("gap"))


def two_nearest(points: DataFrame, spheres: DataFrame) -> DataFrame:
    """run_id, pid, sid, best, second: as nearest_sphere, with the second smallest gap (1e6 where a run has one sphere).

    Two minima, each combined before its shuffle: a list of a point's gaps would move them all.
    """
    gaps = with_gap(points, spheres)
    best = gaps.groupBy("run_id", "pid").agg(F.min(F.struct("gap", "sid")).alias("b"))
    rest = gaps.join(best, ["run_id", "pid"]).where(F.col("sid") != F.col("b.sid"))
    second = rest.groupBy("run_id", "pid").agg(F.min("gap").alias("second"))
    return best.join(second, ["run_id", "pid"], "left").select("run_id", "pid", "b.sid", F.col("b.gap").alias("best"), F.coalesce("second", F.lit(1e6)).alias("second"))


def nearest_sample(points: DataFrame, spheres: DataFrame) -> DataFrame:
    """run_id, sid, pid, d: the nearest point for each center, the lowest pid among equals."""
    best = with_gap(points, spheres).groupBy("run_id", "sid").agg(F.min(F.struct("d", "pid")).alias("b"))
    return best.select("run_id", "sid", "b.pid", "b.d")


def boundary_pairs(points: DataFrame, spheres: DataFrame) -> DataFrame:
    """run_id, sid, pid, depth of the points strictly inside a sphere."""
    return with_gap(points, spheres).where("r - d > 0").select("run_id", "sid", "pid", (F.col("r") - F.col("d")).alias("depth"))


def boundary_pairs_by_cell(points: DataFrame, spheres: DataFrame, cell: float) -> DataFrame:
    """boundary_pairs by an equality join on grid cells: a sphere goes to each cell that its box meets, a point to its own.

    For runs with many points and small spheres; a cell of about the largest radius keeps
    the cells of a sphere at 27 or fewer.
    """
    at = lambda x: F.floor(x / cell)
    s = spheres
    for c in C:
        s = s.withColumn(f"k{c}", F.explode(F.sequence(at(F.col(c) - F.col("r")), at(F.col(c) + F.col("r")))))
    p = points.select("*", *(at(F.col(x)).alias(f"k{c}") for x, c in zip(P, C, strict=True)))
    near = p.join(s, ["run_id", *(f"k{c}" for c in C)]).withColumn("d", dist(P, C))
    return near.where("r - d > 0").select("run_id", "sid", "pid", (F.col("r") - F.col("d")).alias("depth"))


def csr(pairs: DataFrame) -> DataFrame:
    """run_id, sid, pids: the ascending list of each sphere's points, for readers that want lists; bounded by a run's samples."""
    return pairs.groupBy("run_id", "sid").agg(F.sort_array(F.collect_list("pid")).alias("pids"))


def sphere_pairs(spheres: DataFrame) -> DataFrame:
    """run_id, i, j, d, ri, rj for each pair of a run's spheres with i < j."""
    a = spheres.select("run_id", F.col("sid").alias("i"), F.col("r").alias("ri"), *(F.col(c).alias(f"a{c}") for c in C))
    b = spheres.select("run_id", F.col("sid").alias("j"), F.col("r").alias("rj"), *(F.col(c).alias(f"b{c}") for c in C))
    pairs = a.join(b, "run_id").where("i < j")
    return pairs.select("run_id", "i", "j", dist([f"a{c}" for c in C], [f"b{c}" for c in C]).alias("d"), "ri", "rj")


def nested(spheres: DataFrame) -> DataFrame:
    """run_id, sid of the spheres that lie in another; of two that hold one another the lower sid isn't listed."""
    p = sphere_pairs(spheres)
    later = p.where("d + rj <= ri").select("run_id", F.col("j").alias("sid"))
    earlier = p.where("d + ri <= rj AND NOT d + rj <= ri").select("run_id", F.col("i").alias("sid"))
    return later.union(earlier).distinct()


def first_extreme(values: DataFrame, keys: list[str], value: str, idx: str, largest: bool = False) -> DataFrame:
    """keys, idx, value of the smallest (or largest) value, the first index among equals."""
    order: Column = F.struct(-F.col(value) if largest else F.col(value), F.col(idx))
    return values.groupBy(*keys).agg(F.min_by(F.struct(F.col(idx).alias("idx"), F.col(value).alias("value")), order).alias("e")).select(*keys, F.col("e.idx").alias(idx), F.col("e.value").alias(value))


def lower_median(value: str) -> Column:
    """The lower of the two middle values where the count is even; an aggregate."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")
