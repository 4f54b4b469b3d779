"""Fitting losses as aggregates, by run_id, and the gradient step in relational form.

inside: run_id, pid, x, y, z.  surface: the same with normals nx, ny, nz.  spheres: run_id,
sid, cx, cy, cz, r, and m where masses matter.  targets: run_id, mass, com x/y/z, inertia
ixx..izz, scale.  Each function gives run_id and a column named after the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sphaera.functions.scalar import dot, minus, relu
from sphaera.operators import search

#: The losses in the order in which a total is added up; the last isn't implemented and has weight 0.
LOSSES = ("coverage", "overlap", "boundary", "surface", "containment", "sqem", "hausdorff", "mesh_containment", "mass", "com", "inertia", "flatness")
#: Weights of the presets in the order of LOSSES.
PRESETS = {
    "V": (5000.0, 0.1, 1.0, 0.1, 1.0, 10.0, 0.0, 100.0, 0.0, 0.0, 0.0, 0.0),
    "S": (0.01, 0.01, 1000.0, 10.0, 1.0, 1000.0, 10.0, 500.0, 0.0, 0.0, 0.0, 0.0),
    "B": (1500.0, 0.3, 1.0, 50.0, 10.0, 3000.0, 0.0, 10.0, 0.0, 0.0, 0.0, 0.0),
    "Obj": (100.0, 0.3, 0.0, 50.0, 1.0, 50.0, 10.0, 500.0, 30.0, 10.0, 30.0, 0.0),
    "Obj-mass": (100.0, 0.3, 0.0, 50.0, 1.0, 50.0, 10.0, 500.0, 30.0, 10.0, 30.0, 0.0),
}
TOP_SHARE, EPS = 0.15, 1e-20


def _counts(spheres: DataFrame) -> DataFrame:
    return spheres.groupBy("run_id").agg(F.count("*").alias("n"))


def coverage(nearest: DataFrame) -> DataFrame:
    """Mean positive gap; nearest is search.nearest_sphere of the inside samples."""
    return nearest.groupBy("run_id").agg(F.avg(relu("gap")).alias("coverage"))


def surface(nearest: DataFrame) -> DataFrame:
    return nearest.groupBy("run_id").agg(F.avg(F.abs("gap")).alias("surface"))


def _over_pairs(spheres: DataFrame, term: Column, name: str) -> DataFrame:
    sums = search.sphere_pairs(spheres).groupBy("run_id").agg(F.sum(term).alias("s"))
    n = F.col("n").cast("double")
    return _counts(spheres).join(sums, "run_id", "left").select("run_id", (F.coalesce("s", F.lit(0.0)) / (n * n)).alias(name))


def overlap(spheres: DataFrame) -> DataFrame:
    """Mean depth of overlap over ordered pairs."""
    return _over_pairs(spheres, 2 * relu(F.col("ri") + F.col("rj") - F.col("d")), "overlap")


def containment(spheres: DataFrame) -> DataFrame:
    """Mean squared excess by which a sphere holds another, over ordered pairs."""
    a, b = relu(F.col("ri") - F.col("d") - F.col("rj")), relu(F.col("rj") - F.col("d") - F.col("ri"))
    return _over_pairs(spheres, a * a + b * b, "containment")


def boundary(samples: DataFrame, spheres: DataFrame) -> DataFrame:
    """Mean depth of surface samples in spheres over all pairs."""
    depth = search.with_gap(samples, spheres).groupBy("run_id").agg(F.avg(relu(F.col("r") - F.col("d"))).alias("boundary"))
    return depth


def hausdorff(nearest: DataFrame, share: float = TOP_SHARE) -> DataFrame:
    """Mean square of the largest positive gaps, the top share of a run's samples (one at least)."""
    ranked = nearest.select("run_id", relu("gap").alias("h"), "pid")
    by_run = W.partitionBy("run_id")
    ranked = ranked.withColumn("rank", F.row_number().over(by_run.orderBy(F.desc("h"), "pid"))).withColumn("k", F.greatest(F.lit(1), F.floor(F.count("*").over(by_run) * share)))
    return ranked.where("rank <= k").groupBy("run_id").agg(F.avg(F.col("h") * F.col("h")).alias("hausdorff"))


def sqem(samples: DataFrame, nearest: DataFrame, spheres: DataFrame) -> DataFrame:
    """Mean squared error of the nearest sphere along the sample's normal."""
    at = samples.join(nearest.select("run_id", "pid", "sid"), ["run_id", "pid"]).join(spheres, ["run_id", "sid"])
    e = dot(("nx", "ny", "nz"), minus(search.P, search.C)) - F.col("r")
    return at.groupBy("run_id").agg(F.avg(e * e).alias("sqem"))


def _side(samples: DataFrame, spheres: DataFrame) -> DataFrame:
    """Each sphere with its nearest surface sample and sd, how far its center is outside along that sample's normal."""
    near = search.nearest_sample(samples, spheres).select("run_id", "sid", "pid")
    at = spheres.join(near, ["run_id", "sid"]).join(samples, ["run_id", "pid"])
    return at.withColumn("sd", dot(("nx", "ny", "nz"), minus(search.C, search.P)))


def mesh_containment(samples: DataFrame, spheres: DataFrame) -> DataFrame:
    return _side(samples, spheres).groupBy("run_id").agg(F.avg(relu("sd") * relu("sd")).alias("mesh_containment"))


def project_inside(samples: DataFrame, spheres: DataFrame, scale: float) -> DataFrame:
    """Spheres whose center is outside, moved just inside along the normal; moved tells which."""
    at, out = _side(samples, spheres), F.col("sd") > 0
    moved = [F.when(out, F.col(c) - F.col(n) * (F.col("sd") + F.lit(1e-4 * scale))).otherwise(F.col(c)).alias(c) for c, n in zip(search.C, ("nx", "ny", "nz"), strict=True)]
    return at.select("run_id", "sid", *moved, "r", out.alias("moved"))


def moments(spheres: DataFrame) -> DataFrame:
    """run_id, mass, com_x/y/z and inertia ixx..iyz of solid spheres of masses m about their common center.

    One pass: sums of m, m c and m c c^T give the inertia by the parallel-axis rule.
    """
    m, r = F.col("m"), F.col("r")
    second = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    sums = spheres.groupBy("run_id").agg(F.sum("m").alias("mass"), F.sum(0.4 * m * r * r).alias("own"), *(F.sum(m * F.col(f"c{a}")).alias(f"s{a}") for a in "xyz"), *(F.sum(m * F.col(f"c{a}") * F.col(f"c{b}")).alias(f"s{a}{b}") for a, b in second))
    central = {(a, b): F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("mass") for a, b in second}
    trace = central["x", "x"] + central["y", "y"] + central["z", "z"]
    inertia = [((F.col("own") + trace if a == b else F.lit(0.0)) - central[a, b]).alias(f"i{a}{b}") for a, b in second]
    return sums.select("run_id", "mass", *((F.col(f"s{a}") / F.col("mass")).alias(f"com_{a}") for a in "xyz"), *inertia)


def physics(spheres: DataFrame, targets: DataFrame) -> DataFrame:
    """run_id, mass, com, inertia: relative squared errors against targets t_mass, t_com_*, t_i**, t_scale."""
    at = moments(spheres).join(targets, "run_id")
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    com = sum((sq(f"com_{a}", f"t_com_{a}") for a in "xyz"), F.lit(0.0)) / (F.col("t_scale") * F.col("t_scale") + EPS)
    weight = {"xx": 1, "yy": 1, "zz": 1, "xy": 2, "xz": 2, "yz": 2}
    off = sum((w * sq(f"i{k}", f"t_i{k}") for k, w in weight.items()), F.lit(0.0))
    norm = sum((w * F.col(f"t_i{k}") * F.col(f"t_i{k}") for k, w in weight.items()), F.lit(0.0))
    return at.select("run_id", (sq("mass", "t_mass") / (F.col("t_mass") * F.col("t_mass") + EPS)).alias("mass"), com.alias("com"), (off / (norm + EPS)).alias("inertia"))


def marginal_values(inside: DataFrame, surface_: DataFrame, spheres: DataFrame, w_inside: float, w_surface: float) -> DataFrame:
    """run_id, sid, value: what each sphere spares its samples, the difference to their second-best sphere."""
    out = spheres.select("run_id", "sid", F.lit(0.0).alias("v"))
    for samples, weight in ((inside, w_inside), (surface_, w_surface)):
        if weight > 0:
            near = search.two_nearest(samples, spheres)
            out = out.union(near.select("run_id", "sid", weight * (F.col("second") - F.col("best"))))
    return out.groupBy("run_id", "sid").agg(F.sum("v").alias("value"))


def survivors(values: DataFrame, bad: Column, k: int) -> DataFrame:
    """The rows of values that stay when k are culled: high value first, lower sid among equals, bad ones last."""
    by_run = W.partitionBy("run_id")
    v = F.when(bad, float("-inf")).otherwise(F.col("value"))
    ranked = values.withColumn("rank", F.row_number().over(by_run.orderBy(v.desc(), "sid"))).withColumn("n", F.count("*").over(by_run))
    return ranked.where(F.col("rank") <= F.col("n") - k).drop("n")


def clip(grads: DataFrame, columns: list[str], most: float) -> DataFrame:
    """Gradients scaled so that a run's norm is at most ``most``."""
    norm = F.sqrt(F.sum(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))).over(W.partitionBy("run_id")))
    factor = F.least(F.lit(1.0), most / (norm + 1e-6))
    return grads.select(*(c for c in grads.columns if c not in columns), *((F.col(c) * factor).alias(c) for c in columns))


def adam(rows: DataFrame, param: str, grad: str, lr: float, step: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """One Adam step of a parameter with moments {param}_m and {param}_v; step counts from 1."""
    g = F.col(grad)
    m, v = b1 * F.col(f"{param}_m") + (1 - b1) * g, b2 * F.col(f"{param}_v") + (1 - b2) * g * g
    rows = rows.withColumn(f"{param}_m", m).withColumn(f"{param}_v", v)
    return rows.withColumn(param, F.col(param) - lr / (1 - b1**step) * F.col(f"{param}_m") / (F.sqrt(F.col(f"{param}_v")) / (1 - b2**step) ** 0.5 + eps))
