"""Results of runs as JSON, one text for each run, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.functions.scalar import json_flag

FIELDS = "centers array<array<double>>, radii array<double>, masses array<double>, mesh_path string, num_spheres long, per_sphere_mass boolean"


def to_json(spheres: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, result of spheres (run_id, sid, cx, cy, cz, r, m) and runs (run_id, mesh_path, per_sphere_mass, prep: JSON of the preparation, config: JSON).

    Lists are in the order of sid; a run's spheres are bounded by its configuration.
    """
    s = F.sort_array(F.collect_list(F.struct("sid", "cx", "cy", "cz", "r", "m")))
    lists = spheres.groupBy("run_id").agg(s.alias("s"), F.count("*").alias("num_spheres"))
    at = runs.join(lists, "run_id")
    of = lambda f: F.transform("s", f)
    parts = F.struct(of(lambda x: F.array(x["cx"], x["cy"], x["cz"])).alias("centers"), of(lambda x: x["r"]).alias("radii"), of(lambda x: x["m"]).alias("masses"), "mesh_path", "num_spheres", "per_sphere_mass")
    body = F.regexp_replace(F.to_json(parts), r"\}$", "")
    return at.select("run_id", F.concat(body, F.lit(',"mesh_prep":'), F.coalesce("prep", F.lit("null")), F.lit(',"config":'), F.col("config"), F.lit("}")).alias("result"))


def spheres_of(results: DataFrame) -> DataFrame:
    """run_id, sid, cx, cy, cz, r, m of results (run_id, result); lists of different lengths raise."""
    at = results.select("run_id", F.from_json("result", FIELDS).alias("j"))
    same = F.size("j.centers") == F.size("j.radii")
    zipped = F.when(same, F.arrays_zip("j.centers", "j.radii", "j.masses")).otherwise(F.raise_error(F.concat(F.lit("centers and radii differ in length: run "), F.col("run_id").cast("string"))))
    s = at.select("run_id", F.posexplode(zipped).alias("sid", "s"))
    return s.select("run_id", "sid", *(F.get("s.centers", F.lit(k)).alias(f"c{x}") for k, x in enumerate("xyz")), F.col("s.radii").alias("r"), F.col("s.masses").alias("m"))


def preparation_flags(results: DataFrame) -> DataFrame:
    """run_id, union, hull: how the run's mesh was prepared, by its configuration; true and false where it doesn't say."""
    return results.select("run_id", json_flag("result", "$.config.model.union_overlapping_bodies", True).alias("union"), json_flag("result", "$.config.model.convex_hull", False).alias("hull"))


def file_name(link: str = "link_name", index: str = "collision_index"):
    """The name of a collision's result file, as a column."""
    return F.concat(F.col(link), F.lit("_"), F.col(index).cast("string"), F.lit(".json"))


def missing(collisions: DataFrame, spheres: DataFrame) -> DataFrame:
    """The collisions to be packed (package_id, link_name, collision_index, action) that have no spheres."""
    keys = ["package_id", "link_name", "collision_index"]
    return collisions.where("action = 'pack'").join(spheres.select(*keys).distinct(), keys, "left_anti")
