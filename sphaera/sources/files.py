"""Mesh files and packages as DataFrames.  Bytes come through Spark's binaryFile source, so any store that Spark reads will do."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sphaera.functions.scalar import normalize_path
from sphaera.sources import formats

ROWS = "mesh_id string, kind string, id int, x double, y double, z double, a int, b int, c int"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def parse_meshes(files: DataFrame) -> DataFrame:
    """path, content -> rows of kind vertex, face or error (its text in mesh_id's place beside the path: mesh_id | message)."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = list(formats.rows_of(path, formats.parse(bytes(content), path.rpartition(".")[2])))
                except formats.MeshError as e:
                    rows = [(f"{path}|{e}", "error", 0, *[None] * 6)]
                yield pd.DataFrame(rows, columns=_NAMES).astype({"id": "Int32", "a": "Int32", "b": "Int32", "c": "Int32"})

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_meshes(spark: SparkSession, path: str, glob: str = "*") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertex, face, error) of the mesh files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return split_rows(parse_meshes(files.where(F.lower("path").rlike(r"\.(obj|stl|ply|dae)$"))))


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    vertex = rows.where("kind = 'vertex'").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z")
    face = rows.where("kind = 'face'").select("mesh_id", F.col("id").alias("fid"), "a", "b", "c")
    error = rows.where("kind = 'error'").select(F.substring_index("mesh_id", "|", 1).alias("mesh_id"), F.expr("substring(mesh_id, locate('|', mesh_id) + 1)").alias("message"))
    return vertex, face, error


def obj_texts(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """mesh_id, content of OBJ files, by DataFrame functions; a mesh's lines meet in one row."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    v = vertex.select("mesh_id", F.struct(F.lit(0).alias("k"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), *(number(c) for c in "xyz")).alias("line")).alias("r"))
    f = face.select("mesh_id", F.struct(F.lit(1).alias("k"), F.col("fid").alias("n"), F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in "abc")).alias("line")).alias("r"))
    lines = F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"])
    return v.union(f).groupBy("mesh_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


def package_from_files(files: DataFrame, root: str) -> DataFrame:
    """package path -> content of binaryFile rows, keys relative to the root."""
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.rstrip("/") + "/", "")
    return files.select(normalize_path(rel).alias("path"), "content").where("path IS NOT NULL")


def package_from_zip(archives: DataFrame) -> DataFrame:
    """package_id, path, content of zip archives (package_id, content): no folders, nothing of __MACOSX, no path that leaves the package."""

    def run(frames):
        for pdf in frames:
            for package, content in zip(pdf["package_id"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows = [(package, n, z.read(n)) for n in z.namelist() if not n.endswith("/") and not n.startswith("__MACOSX/")]
                yield pd.DataFrame(rows, columns=["package_id", "path", "content"])

    raw = archives.select("package_id", "content").mapInPandas(run, "package_id string, path string, content binary")
    checked = raw.withColumn("key", normalize_path("path"))
    return checked.select("package_id", F.when(F.col("key").isNull(), F.raise_error(F.concat(F.lit("path leaves the package: "), "path"))).otherwise(F.col("key")).alias("path"), "content")


def upserted(files: DataFrame, order: str) -> DataFrame:
    """The last arrival (by order) of each package's normalised path."""
    w = W.partitionBy("package_id", "path").orderBy(F.desc(order))
    keyed = files.withColumn("path", normalize_path("path")).where("path IS NOT NULL")
    return keyed.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def directories(files: DataFrame) -> DataFrame:
    """package_id, path of all folders above the files."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.where(F.col("path").contains("/")).select("package_id", F.explode(above).alias("path")).distinct()


def urdfs(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".urdf")).select("package_id", "path")


def select_urdf(files: DataFrame, name: str | None = None) -> DataFrame:
    """package_id, path, error: the URDF of that base name, or the only one; else what there is to choose from."""
    found = urdfs(files)
    if name:
        found = found.where(F.substring_index("path", "/", -1) == name)
    grouped = found.groupBy("package_id").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("all"))
    out = files.select("package_id").distinct().join(grouped, "package_id", "left")
    error = F.when(F.col("n").isNull(), F.lit(f"no URDF named {name}" if name else "no URDF in the package")).when(F.col("n") > 1, F.concat(F.lit("several URDFs, name one: "), "all"))
    return out.select("package_id", F.when(F.col("n") == 1, F.col("path")).alias("path"), error.alias("error"))


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (package_id, urdf, filename) with resolved: the package's path of a mesh reference, or null.

    package://name/rel is name/rel, rel, or the only file of that base name; file:// stands as
    it is; an absolute path counts from the package, any other from the URDF's folder.  Each
    way is an equality join.
    """
    from sphaera.functions.scalar import join_path

    known = files.select("package_id", F.col("path").alias("key"))
    rest = F.regexp_extract("filename", "^package://(.*)$", 1)
    name, rel = F.substring_index(rest, "/", 1), F.expr("substring(substring(filename, 11), locate('/', substring(filename, 11)) + 1)")
    is_pkg, is_file = F.col("filename").startswith("package://"), F.col("filename").startswith("file://")
    folder = F.when(F.col("urdf").contains("/"), F.regexp_replace("urdf", "/[^/]*$", "")).otherwise("")
    tries = refs.withColumns({
        "t1": F.when(is_pkg, join_path(name, rel)).when(~is_file & F.col("filename").startswith("/"), normalize_path(F.regexp_replace("filename", "^/+", ""))).when(~is_file, join_path(folder, F.col("filename"))),
        "t2": F.when(is_pkg, normalize_path(rel)),
        "t3": F.when(is_pkg & (F.substring_index(rel, "/", -1) != ""), F.substring_index(rel, "/", -1)),
    })
    for k in ("t1", "t2"):
        tries = tries.join(known.withColumnRenamed("key", k).withColumn(f"ok_{k}", F.lit(True)), ["package_id", k], "left")
    base = known.groupBy("package_id", F.substring_index("key", "/", -1).alias("t3")).agg(F.count("*").alias("n"), F.first("key").alias("only")).where("n = 1").drop("n")
    tries = tries.join(base, ["package_id", "t3"], "left")
    found = F.when(is_file, F.expr("substring(filename, 8)")).otherwise(F.coalesce(F.when(F.col("ok_t1"), F.col("t1")), F.when(F.col("ok_t2"), F.col("t2")), F.when(is_pkg, F.col("only"))))
    return tries.select(*refs.columns, found.alias("resolved"))


class MeshDataSource(DataSource):
    """spark.read.format("mesh").load(folder): rows of vertices and faces of local mesh files, a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return MeshReader(self.options["path"])


class MeshReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import os

        found = [os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in sorted(found) if p.lower().endswith(tuple("." + e for e in formats.EXTENSIONS))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from formats.rows_of(partition.value, formats.parse(f.read(), partition.value.rpartition(".")[2]))
