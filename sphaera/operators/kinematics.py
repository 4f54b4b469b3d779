"""Poses of links over joint trees: joint (package_id, parent, child, px, py, pz, roll, pitch, yaw)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sphaera.functions.scalar import dot, rpy_rows
from sphaera.plans.durable import durable

R = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
T = ("tx", "ty", "tz")
IDENTITY = {r: 1.0 if r[1] == r[2] else 0.0 for r in R} | dict.fromkeys(T, 0.0)


def compose(a: str, b: str) -> dict:
    """Columns of the pose a, then b within it; a and b are prefixes of poses' columns."""
    rows = [[f"{a}r{i}{k}" for k in range(3)] for i in range(3)]
    turn = {f"r{i}{j}": dot(rows[i], [f"{b}r{k}{j}" for k in range(3)]) for i in range(3) for j in range(3)}
    return turn | {t: dot(rows[i], [f"{b}{x}" for x in T]) + F.col(f"{a}{t}") for i, t in enumerate(T)}


def joint_poses(joint: DataFrame) -> DataFrame:
    """joint with its pose's columns, named j_r00 .. j_tz."""
    rows = rpy_rows("roll", "pitch", "yaw")
    cols = {f"j_r{i}{j}": rows[i][j] for i in range(3) for j in range(3)} | {f"j_{t}": F.col(p) for t, p in zip(T, ("px", "py", "pz"), strict=True)}
    return joint.withColumns(cols)


def link_poses(joint: DataFrame, links: DataFrame) -> DataFrame:
    """package_id, link and pose of all links (package_id, link) in the zero configuration.

    Level by level from the roots (links that are no joint's child); of several joints to a
    link the first in order (ord) counts, and what no root reaches, as in a cycle, has the
    identity.  As many rounds as the deepest tree has levels, for all packages at once.
    """
    first = joint.withColumn("k", F.row_number().over(W.partitionBy("package_id", "child").orderBy("ord"))).where("k = 1").drop("k")
    j = durable(joint_poses(first).select("package_id", "parent", F.col("child").alias("link"), *(f"j_{c}" for c in (*R, *T))))
    one = lambda df: df.select("package_id", "link", *(F.lit(IDENTITY[c]).alias(c) for c in (*R, *T)))
    roots = links.join(joint.select("package_id", F.col("child").alias("link")).distinct(), ["package_id", "link"], "left_anti")
    level = durable(one(roots))
    done = [level]
    while True:  # a link has one parent here, so that levels end
        above = level.select("package_id", F.col("link").alias("parent"), *(F.col(c).alias(f"a_{c}") for c in (*R, *T)))
        level = durable(j.join(above, ["package_id", "parent"]).select("package_id", "link", *(v.alias(k) for k, v in compose("a_", "j_").items())))
        if level.isEmpty():
            break
        done.append(level)
    reached = reduce(DataFrame.union, done)
    return reached.union(one(links.join(reached.select("package_id", "link"), ["package_id", "link"], "left_anti")))
