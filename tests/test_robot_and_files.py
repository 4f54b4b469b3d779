import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from sphaera.functions import scalar
from sphaera.operators import history, mesh, topology
from sphaera.robot import describe
from sphaera.sources import files, formats
from sphaera.streaming import live

V, T = np.array(mesh.TETRAHEDRON), np.array(mesh.TETRAHEDRON_FACES)

URDF = """<?xml version="1.0"?>
<!-- a gripper on a post -->
<robot name="gripper">
  <material name="steel"><color rgba="0.4 0.4 0.45 1"/></material>
  <link name="post">
    <visual><geometry><cylinder radius="0.02" length="0.5"/></geometry></visual>
    <collision name="shaft"><geometry><cylinder radius="0.02" length="0.5"/></geometry></collision>
  </link>
  <joint name="turn" type="revolute"><parent link="post"/><child link="palm"/><origin xyz="0 0 0.5"/></joint>
  <link name="palm">
    <visual><geometry><mesh filename="shapes/palm.obj"/></geometry></visual>
    <collision><origin rpy="0 3.141592653589793 0"/><geometry><mesh filename="shapes/palm.obj"/></geometry></collision>
    <collision><geometry><mesh filename="shapes/finger.OBJ" scale="1 2 0.5"/></geometry></collision>
    <collision><geometry><capsule radius="0.1"/></geometry></collision>
    <collision><geometry><sphere radius="0.01"/></geometry></collision>
  </link>
  <link name="tip"><collision><origin xyz="x y z"/><geometry><mesh filename="file:///models/tip.step"/></geometry></collision></link>
</robot>
"""


def ply(order):
    head = f"ply\nformat {order} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar q\nelement face 4\nproperty list uchar int vertex_indices\nend_header\n".encode()
    if order == "ascii":
        return head + "\n".join(["{} {} {} 7".format(*v) for v in V] + ["3 {} {} {}".format(*t) for t in T]).encode()
    e = "<" if "little" in order else ">"
    v = np.zeros(4, np.dtype([("p", e + "f4", 3), ("q", "u1")]))
    v["p"] = V
    f = np.zeros(4, np.dtype([("n", "u1"), ("i", e + "i4", 3)]))
    f["n"], f["i"] = 3, T
    return head + v.tobytes() + f.tobytes()


DAE = """<COLLADA xmlns="x"><library_geometries><geometry id="g"><mesh><source id="p"><float_array id="f">0 0 0 1 0 0 0 1 0 0 0 1</float_array><technique_common><accessor source="#f" count="4" stride="3"/></technique_common></source>
<vertices id="v"><input semantic="POSITION" source="#p"/></vertices><triangles count="4"><input semantic="VERTEX" source="#v" offset="0"/><p>0 2 1 0 1 3 0 3 2 1 2 3</p></triangles></mesh></geometry></library_geometries>
<library_visual_scenes><visual_scene id="s"><node><translate>0 0 5</translate><scale>2 2 2</scale><instance_geometry url="#g"/></node></visual_scene></library_visual_scenes><scene><instance_visual_scene url="#s"/></scene></COLLADA>"""


@pytest.mark.parametrize("data,ext", [(formats.write_obj(V, T).encode(), "OBJ"), (formats.write_stl(V, T), ".stl"), (ply("ascii"), "ply"), (ply("binary_little_endian"), "ply"), (ply("binary_big_endian"), "ply")])
def test_formats_round_trip(data, ext):
    v, f = formats.parse(data, ext)
    assert np.allclose(v[f], V[T])


def test_more_formats():
    v, f = formats.parse(DAE.encode(), "dae")
    assert np.allclose(v[f], V[T] * 2 + [0, 0, 5])
    v, f = formats.parse(b"v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/2/3 2//1 3 -1\nl 1 2\n", "obj")
    assert f.tolist() == [[0, 1, 2], [0, 2, 3]]
    text = "solid s\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in V[t]) + "endloop\nendfacet\n" for t in T) + "endsolid"
    v, f = formats.parse(text.encode(), "stl")
    assert len(v) == 4 and np.allclose(v[f], V[T])
    for data, ext, error in ((b"x", "step", formats.UnknownFormat), (b"nothing", "stl", formats.MeshError), (b"ply\n", "ply", formats.MeshError)):
        with pytest.raises(error):
            formats.parse(data, ext)


def test_readers(spark, tmp_path):
    (tmp_path / "a.obj").write_text(formats.write_obj(V, T))
    (tmp_path / "b.STL").write_bytes(formats.write_stl(V, T))
    (tmp_path / "c.ply").write_bytes(b"ply\nbroken")
    vertex, face, error = files.read_meshes(spark, str(tmp_path))
    p = mesh.mass_properties(mesh.triangles(vertex, face)).collect()
    assert len(p) == 2 and all(abs(r.volume - 1 / 6) < 1e-9 for r in p) and error.count() == 1
    spark.dataSource.register(files.MeshDataSource)
    rows = spark.read.format("mesh").load(str(tmp_path / "a.obj"))
    assert rows.where("kind = 'face'").count() == 4
    v, f = mesh.from_rows(spark, "t", V, T)
    assert files.obj_texts(v, f).first().content == formats.write_obj(V, T)


def test_packages(spark, tmp_path):
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        for n in ("r/a.urdf", "r/m/a.stl", "__MACOSX/x", "r/m/deep/c.obj"):
            z.writestr(n, "x")
    archives = spark.createDataFrame([("p", path.read_bytes())], "package_id string, content binary")
    got = files.package_from_zip(archives).cache()
    assert sorted(r.path for r in got.collect()) == ["r/a.urdf", "r/m/a.stl", "r/m/deep/c.obj"]
    assert sorted(r.path for r in files.directories(got).collect()) == ["r", "r/m", "r/m/deep"]
    assert files.select_urdf(got).first().path == "r/a.urdf" and files.select_urdf(got, "b.urdf").first().error
    refs = spark.createDataFrame([("p", "r/a.urdf", f) for f in ("package://r/m/a.stl", "package://other/c.obj", "m/a.stl", "../../x", "/r/m/a.stl", "file:///k.stl", "gone.stl")], "package_id string, urdf string, filename string")
    found = {r.filename: r.resolved for r in files.resolve(refs, got).collect()}
    assert list(found[f] for f in ("package://r/m/a.stl", "package://other/c.obj", "m/a.stl", "../../x", "/r/m/a.stl", "file:///k.stl", "gone.stl")) == ["r/m/a.stl", "r/m/deep/c.obj", "r/m/a.stl", None, "r/m/a.stl", "/k.stl", None]
    twice = spark.createDataFrame([("p", "a/./b", 1, "old"), ("p", "a/b", 2, "new")], "package_id string, path string, n int, content string")
    assert [r.content for r in files.upserted(twice, "n").collect()] == ["new"]


def test_paths(spark):
    texts = ["a/./b//c", "a/../b", "../x", "/abs", "C:/x", "a\\b"]
    df = spark.createDataFrame([(t,) for t in texts], "p string").select(scalar.normalize_path("p").alias("q"))
    assert [r.q for r in df.collect()] == ["a/b/c", "b", None, None, None, "a/b"]
    s = spark.createDataFrame([("1 2 3",), ("2",), ("x 1 1",), (None,)], "s string").select(scalar.parse_scale("s").alias("q"))
    assert [r.q for r in s.collect()] == [[1, 2, 3], [2, 2, 2], [1, 1, 1], [1, 1, 1]]


PACKAGE = "package_id string, urdf string, content binary, paths array<string>"


def test_inspection(spark):
    texts = spark.createDataFrame([("g", "gripper.urdf", URDF.encode(), ["shapes/palm.obj", "shapes/finger.OBJ"]), ("m", "macro.urdf", b"<robot name='m'><link name='${side}_arm'/></robot>", [])], PACKAGE)
    rows = {(r.link_name, r.collision_index): r for r in describe.inspect_packages(texts).where("package_id = 'g'").collect()}
    actions = {k: r.action for k, r in rows.items()}
    assert actions == {("post", 0): "remove-primitive", ("palm", 0): "pack", ("palm", 1): "pack", ("palm", 2): actions["palm", 2], ("palm", 3): "remove-already-sphere", ("tip", 0): "error"}
    assert rows["palm", 1].mesh_scale == [1, 2, 0.5] and "ignored" in rows["palm", 1].warning and not rows["palm", 0].warning
    assert [r.action for r in describe.inspect_packages(texts).where("package_id = 'm'").collect()] == ["error"]


def test_rewrite(spark):
    found = [("palm", 0, [[0.1, 0.0, 0.0], [0.2, 0.0, 0.0]], [0.05, 0.06])]
    jobs = spark.createDataFrame([("g", "gripper.urdf", URDF.encode(), ["shapes/palm.obj"], found)], PACKAGE + ", spheres array<struct<link:string,index:int,centers:array<array<double>>,radii:array<double>>>")
    r = describe.rewrite_packages(jobs).first()
    assert r.spheres_added == 2 and r.skipped == 0 and r.content.startswith("<?xml")
    after = describe.inspect(r.content, lambda f: None)
    assert sum(c.action == "remove-already-sphere" for c in after.collisions) == 2 and not any(c.kind == "cylinder" for c in after.collisions)
    assert '<origin xyz="-0.100000 0.000000 -0.000000" rpy="0 0 0" />' in r.content or '<origin xyz="-0.100000 0.000000 0.000000" rpy="0 0 0" />' in r.content


def test_macros_and_names(spark):
    """What is a macro, and which files are descriptions: names are taken as they are."""
    texts = ["<xacro:if/>", "${a}", "a ${b", "${}", "$(find x)", "< xacro:if", "${} ${c}", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.q for r in df.select(scalar.looks_like_xacro("t").alias("q")).collect()] == [describe.is_xacro(t) for t in texts] == [True, True, False, False, False, False, True, False]
    many = spark.createDataFrame([("p", f"u{k:03}.urdf") for k in range(80)] + [("p", "B.URDF"), ("q", "x.URDF")], "package_id string, path string")
    got = {r.package_id: r for r in files.select_urdf(many).collect()}
    assert got["p"].error.count(".urdf") == 80 and "URDF," not in got["p"].error and got["q"].path is None


@pytest.mark.parametrize("n, k", [(120, 50), (7, 10), (10, 10), (11, 10), (301, 150), (1000, 7), (5, 1), (64, 2)])
def test_thinned_positions(spark, n, k):
    steps = spark.range(n).selectExpr("'r' AS run_id", "id AS iteration", "1.0 / (id + 3) AS total_loss")
    want = set(range(n)) if n <= k else {int(p) for p in np.linspace(0, n - 1, k)}
    got = {r.iteration: r.total_loss for r in history.thinned(steps, k).collect()}
    assert set(got) == want and all(v == float(f"{1 / (i + 3):.5g}") for i, v in got.items())


def test_object_models():
    c, r = [(0.1, 0.2, 0.3), (0.4, 0.0, -0.3), (1.0, 1.0, 1.0)], [0.1, 0.2]
    centers, radii = describe.object_spheres(describe.object_urdf(c, r, describe.ObjectOptions(anchored=True)))
    assert np.allclose(centers, c, atol=2e-6) and np.allclose(radii, [0.1, 0.2, 0.2])
    assert describe.object_mjcf(c, r).count("<geom ") == 3
    with pytest.raises(ValueError):
        describe.object_urdf([], [])


def test_bodies_and_merge(spark):
    v, f = mesh.boxes(spark.createDataFrame([("m", 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "mesh_id string, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"))
    assert topology.bodies(f).agg(F.max("body")).first()[0] == 0
    assert topology.closedness(f).first().winding


def test_live_frames(spark, tmp_path):
    steps = spark.createDataFrame([(r, i, float(i)) for r in ("a", "b") for i in range(5)], "run_id string, iteration long, total_loss double")
    steps.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in"))
    q = live.latest_frames(stream).writeStream.outputMode("complete").format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.run_id, r.iteration) for r in spark.table("frames").collect()) == [("a", 4), ("b", 4)]
    events = spark.createDataFrame([("a", 3, 1, 1)], "run_id string, iteration long, added long, removed long")
    assert '"total_loss":[0.0,1.0' in history.to_json(steps, events).orderBy("run_id").first().history
    assert os.listdir(tmp_path)
