"""Composes the evaluation of a weight set: only what weighs is planned, and searches are shared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.operators import losses, search


def evaluate(inside: DataFrame, surface: DataFrame, spheres: DataFrame, targets: DataFrame | None, weights: dict[str, float] | tuple) -> DataFrame:
    """run_id, the value of each loss of weight other than 0, and total, added up in the order of losses.LOSSES.

    A loss of weight 0 adds neither a join nor an aggregate.  The nearest spheres of the
    inside and of the surface samples are each one shared plan (a reused exchange).
    """
    w = weights if isinstance(weights, dict) else dict(zip(losses.LOSSES, weights, strict=True))
    if w.get("flatness"):
        raise ValueError("flatness isn't implemented; its weight must be 0")
    active = [x for x in losses.LOSSES if w.get(x)]
    on_surface = search.nearest_sphere(surface, spheres)
    make = {
        "coverage": lambda: losses.coverage(search.nearest_sphere(inside, spheres)),
        "overlap": lambda: losses.overlap(spheres),
        "boundary": lambda: losses.boundary(surface, spheres),
        "surface": lambda: losses.surface(on_surface),
        "containment": lambda: losses.containment(spheres),
        "sqem": lambda: losses.sqem(surface, on_surface, spheres),
        "hausdorff": lambda: losses.hausdorff(on_surface),
        "mesh_containment": lambda: losses.mesh_containment(surface, spheres),
    }
    parts = [make[x]() for x in active if x in make]
    if physical := [x for x in active if x in ("mass", "com", "inertia")]:
        parts.append(losses.physics(spheres, targets).select("run_id", *physical))
    if not parts:
        return spheres.select("run_id").distinct().withColumn("total", F.lit(0.0))
    joined = reduce(lambda a, b: a.join(b, "run_id"), parts)
    total = reduce(lambda a, b: a + b, (F.lit(float(w[x])) * F.col(x) for x in active))
    return joined.select("run_id", *active, total.alias("total"))
