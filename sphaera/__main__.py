"""Command line: presets, info, prepare, pack, metrics and export.

pack and info take any number of mesh files or folders, which Spark reads; each mesh is a run.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.operators import mesh, quality
from sphaera.operators.losses import LOSSES, PRESETS
from sphaera.plans import fitting, prepare
from sphaera.plans.config import Config
from sphaera.robot import describe
from sphaera.sources import files, results


def parse_set(text: str) -> tuple[str, object]:
    """section.key=value, the value as JSON or else as text."""
    key, sep, value = text.partition("=")
    if not sep:
        raise argparse.ArgumentTypeError(f"{text!r} isn't key=value")
    try:
        return key, json.loads(value)
    except ValueError:
        return key, value


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sphaera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("presets")
    for name in ("info", "prepare", "pack"):
        c = sub.add_parser(name)
        c.add_argument("path")
    sub.choices["prepare"].add_argument("--hull", action="store_true")
    c = sub.choices["pack"]
    c.add_argument("--preset", default="B", choices=list(PRESETS))
    c.add_argument("--config", help="JSON file of settings, applied after the preset")
    c.add_argument("--spheres", type=int)
    c.add_argument("--iterations", type=int)
    c.add_argument("--seed", type=int)
    c.add_argument("--set", action="append", type=parse_set, default=[], metavar="KEY=VALUE")
    c.add_argument("--out", required=True, help="folder of the results, a JSON line for each mesh")
    c = sub.add_parser("metrics")
    c.add_argument("path")
    c.add_argument("result")
    c = sub.add_parser("export")
    c.add_argument("result")
    c.add_argument("--format", choices=("urdf", "mjcf"), default="urdf")
    c.add_argument("--anchored", action="store_true")
    return p.parse_args(argv)


def settings(a: argparse.Namespace) -> Config:
    """Preset, then file, then flags, then --set."""
    c = Config.preset(a.preset)
    if a.config:
        with open(a.config) as f:
            for section, values in json.load(f).items():
                c.update({f"{section}.{k}": v for k, v in values.items()} if isinstance(values, dict) else {section: values})
    flags = {"model.num_spheres": a.spheres, "training.iterations": a.iterations, "random_seed": a.seed}
    c.update({k: v for k, v in flags.items() if v is not None} | dict(a.set))
    return c.validate()


def pack(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """run_id (the mesh's path) and result, JSON."""
    vertex, face, _ = files.read_meshes(spark, path)
    runs = vertex.select(F.col("mesh_id").alias("run_id"), "mesh_id").distinct().withColumn("config", F.lit(config.to_json()))
    spheres = fitting.fit(runs, vertex, face).where("kind = 'sphere'").select("run_id", "sid", "cx", "cy", "cz", "r", "m")
    about = runs.select("run_id", F.col("mesh_id").alias("mesh_path"), F.lit(config.get("model.per_sphere_mass")).alias("per_sphere_mass"), F.lit(None).cast("string").alias("prep"), "config")
    return results.to_json(spheres, about)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.command == "presets":
        for name, w in PRESETS.items():
            print(name, json.dumps({k: v for k, v in zip(LOSSES, w, strict=True) if v}))
        return 0
    spark = SparkSession.builder.appName("sphaera").getOrCreate()
    show = lambda df: [print(line.value) for line in df.select(F.to_json(F.struct("*")).alias("value")).toLocalIterator()]
    if a.command == "pack":
        pack(spark, a.path, settings(a)).select("result").write.text(a.out)
    elif a.command == "export":
        rows = spark.read.text(a.result).select(F.monotonically_increasing_id().alias("run_id"), F.col("value").alias("result"))
        write = {"urdf": describe.object_urdf, "mjcf": describe.object_mjcf}[a.format]
        for r in rows.toLocalIterator():
            j = json.loads(r.result)
            print(write(j["centers"], j["radii"], describe.ObjectOptions(anchored=a.anchored)))
    else:
        vertex, face, errors = files.read_meshes(spark, a.path)
        tri = mesh.with_normals(mesh.triangles(vertex, face))
        p = mesh.mass_properties(tri)
        if a.command == "info":
            show(p)
            show(errors)
        elif a.command == "prepare":
            show(prepare.prepare_meshes(prepare.flat_meshes(vertex, face), convex_hull=a.hull).select("mesh_id", "report"))
        else:
            done = spark.read.text(a.result).select(F.get_json_object("value", "$.mesh_path").alias("run_id"), F.col("value").alias("result"))
            spheres = results.spheres_of(done).withColumnRenamed("run_id", "mesh_id")
            show(quality.evaluate(p, tri, spheres))
    return 0


if __name__ == "__main__":
    sys.exit(main())
