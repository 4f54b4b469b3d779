import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from sphaera.operators import containment, losses, mesh, quality, sampling
from sphaera.plans import fitting
from sphaera.plans.config import Config, ConfigError
from sphaera.plans.evaluate import evaluate

V = np.array([[x, y, z] for z in (0, 0.8) for y in (0, 1.2) for x in (0, 1)], float)
FACES = np.array(mesh.BOX_FACES)


def toy(preset="B", n=6, samples=60, **updates):
    rng = np.random.default_rng(4)
    c = Config.preset(preset, **{"model.num_spheres": n, "model.num_inside_samples": samples, "model.num_surface_samples": samples, "random_seed": 1} | updates)
    inside, surface, normals, _, _ = fitting.sampled(c, V, FACES)
    return fitting.Fitter(c, V, FACES, inside, surface, normals, rng.uniform(-0.1, 1.1, (n, 3)), rng.uniform(0.08, 0.35, n), rng.uniform(10, 200, n))


def test_box_properties():
    volume, com, inertia = fitting.properties(V, FACES)
    assert np.isclose(volume, 0.96) and np.allclose(com, [0.5, 0.6, 0.4])
    assert np.allclose(inertia, 0.96 / 12 * np.diag([1.44 + 0.64, 1 + 0.64, 1 + 1.44]))


@pytest.mark.parametrize("faces", [mesh.corner_tetrahedron(), mesh.l_prism(2.0)])
def test_closed_forms(faces):
    v, f = map(np.array, faces)
    volume, com, inertia = fitting.properties(v.astype(float), f)
    if len(v) == 4:
        assert np.isclose(volume, 1 / 6) and np.allclose(com, 0.25)
        assert np.allclose(inertia, np.full((3, 3), 1 / 480) + np.eye(3) * (1 / 80 - 1 / 480))
    else:
        assert np.isclose(volume, 6.0)
        p = np.random.default_rng(0).uniform(-0.2, 2.2, (500, 3))
        want = ((p > 0) & (p < 2)).all(1) & ~((p[:, 0] > 1) & (p[:, 1] > 1))
        assert (fitting.contains(p, v.astype(float), f) == want).all()


@pytest.mark.parametrize("preset,learned", [("V", False), ("S", False), ("B", False), ("Obj", False), ("Obj-mass", True)])
def test_gradients_by_finite_differences(preset, learned):
    f = toy(preset, **{"model.per_sphere_mass": learned})
    *_, gc, gr, gm = f.evaluate()
    groups = [(f.centers, gc), (f.raw, gr)] + ([(f.raw_mass, gm)] if learned else [])
    for x, g in groups:
        numeric = np.zeros(x.size)
        flat = x.reshape(-1)
        for k in range(x.size):
            old, h = flat[k], 1e-6
            flat[k] = old + h
            up = f.evaluate()[1]
            flat[k] = old - h
            numeric[k] = (up - f.evaluate()[1]) / (2 * h)
            flat[k] = old
        assert np.allclose(numeric, g.reshape(-1), atol=1e-5 + 2e-5 * np.abs(numeric).max())


def as_tables(spark, f):
    rows = lambda x, n: [(0, k, *map(float, p)) for k, p in enumerate(np.hstack([x, n]))]
    inside = spark.createDataFrame(rows(f.inside, np.zeros_like(f.inside)), "run_id long, pid long, x double, y double, z double, nx double, ny double, nz double")
    surface = spark.createDataFrame(rows(f.surface, f.normals), inside.schema)
    s = spark.createDataFrame([(0, k, *map(float, c), float(r), float(m)) for k, (c, r, m) in enumerate(zip(f.centers, f.radii, f.masses))], "run_id long, sid long, cx double, cy double, cz double, r double, m double")
    i = f.inertia
    t = spark.createDataFrame([(0, float(f.mass), *map(float, f.com), *(float(i[a, b]) for a in range(3) for b in range(a, 3)), float(f.scale))], "run_id long, t_mass double, t_com_x double, t_com_y double, t_com_z double, t_ixx double, t_ixy double, t_ixz double, t_iyy double, t_iyz double, t_izz double, t_scale double")
    return inside, surface, s, t


def test_kernel_and_relational_form_agree_over_steps(spark):
    f = toy(**{"training.density_control_enabled": False})
    f.weights = {k: 0.0 if k == "flatness" else 1.0 for k in losses.LOSSES}
    for _ in range(2):
        row = evaluate(*as_tables(spark, f), f.weights).first()
        raw, total, *_ = f.evaluate()
        assert np.isclose(row.total, total, rtol=1e-9)
        for k in losses.LOSSES[:-1]:
            assert np.isclose(row[k], raw[k], rtol=1e-8, atol=1e-12), k
        inside, surface, s, _ = as_tables(spark, f)
        values = losses.marginal_values(inside, surface, s, 1500.0, 3051.0).orderBy("sid").toPandas()
        assert np.allclose(values.value, f.marginal_values())
        f.step()
        f.weights = {k: 0.0 if k == "flatness" else 1.0 for k in losses.LOSSES}


def test_weights_decide_what_is_planned(spark):
    plan = evaluate(*as_tables(spark, toy()), {"mass": 1.0})._jdf.queryExecution().optimizedPlan().toString()
    assert "pid" not in plan.split("LogicalRDD")[0]


def test_runs_of_a_fleet(spark):
    c = Config.preset("B", **{"model.num_spheres": 8, "model.num_inside_samples": 300, "model.num_surface_samples": 300, "training.iterations": 40, "training.density_control_min_interval": 15, "random_seed": 3})
    v, f = mesh.boxes(spark.createDataFrame([("box", 0.0, 1.0, 0.0, 1.2, 0.0, 0.8), ("flat", 0.0, 1.0, 0.0, 1.0, 0.0, 0.0)], "mesh_id string, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"))
    runs = spark.createDataFrame([("a", "box", c.to_json()), ("b", "box", c.to_json()), ("c", "flat", c.to_json())], "run_id string, mesh_id string, config string")
    out = fitting.fit(runs, v, f).toPandas()
    steps = {r: [json.loads(x) for x in g.record] for r, g in out[out.kind == "step"].groupby("run_id")}
    assert [s["iteration"] for s in steps["a"]] == list(range(40)) and steps["a"] == steps["b"]
    assert steps["a"][-1]["total_loss"] < steps["a"][0]["total_loss"]
    events = [json.loads(x)["iteration"] for x in out[(out.kind == "event") & (out.run_id == "a")].record]
    assert events[0] == 15
    s = out[(out.kind == "sphere") & (out.run_id == "a")]
    assert 1 <= len(s) <= 8 and fitting.contains(s[["cx", "cy", "cz"]].to_numpy(float), V, FACES).all()
    assert not fitting.nested(s[["cx", "cy", "cz"]].to_numpy(float), s.r.to_numpy(float)).any()
    assert (out[out.run_id == "c"].kind == "error").all()


def test_sampling_and_quality(spark):
    v, f = mesh.boxes(spark.createDataFrame([("box", 0.0, 1.0, 0.0, 1.2, 0.0, 0.8)], "mesh_id string, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"))
    tri = mesh.with_normals(mesh.triangles(v, f)).cache()
    p = mesh.mass_properties(tri).cache()
    surf = sampling.surface(tri, 500).toPandas()
    assert len(surf) == 500 and (np.isclose(surf[["x", "y", "z"]], 0) | np.isclose(surf[["x", "y", "z"]], [1, 1.2, 0.8])).any(axis=1).all()
    assert sampling.surface(tri.repartition(7), 500).exceptAll(sampling.surface(tri, 500)).count() == 0
    pts = sampling.inside(p, tri, 200).toPandas()
    assert len(pts) == 200 and fitting.contains(pts[["x", "y", "z"]].to_numpy(), V, FACES).all()
    centers = sampling.voxel_centers(p, tri, 12)
    radii = sampling.lognormal_radii(centers, p)
    rows = radii.toPandas()
    assert len(rows) == 12 and np.isclose((4 / 3 * np.pi * rows.r**3).sum(), 0.96)
    s = radii.select("mesh_id", "sid", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), "r")
    q = quality.evaluate(p, tri, s).first()
    assert q.actual_n == 12 and q.n_out == 0 and 0 < q.r_in < 1 and np.isclose(q.mass_rel, 0, atol=1e-9) and abs(q.r_in + q.r_out - q.r_uni) < 1e-12
    link = quality.link_quality(p, tri, s).first()
    assert link.num_spheres == 12 and abs(link.volume_est - 0.96) < 1e-9 and 0 < link.coverage < 1 and link.finite
    robust = containment.robust(sampling.candidates(p, 300, 5, expand=1.4), tri).toPandas()
    exact = containment.parity(sampling.candidates(p, 300, 5, expand=1.4), tri).toPandas()
    assert (robust.sort_values("pid").inside.to_numpy() == exact.sort_values("pid").inside.to_numpy()).all()


def test_rejections_and_uv_sphere(spark):
    params = spark.createDataFrame([("s", 0.0, 0.0, 0.0, 1.0, 24, 48)], "mesh_id string, cx double, cy double, cz double, r double, stacks int, slices int")
    v, f = mesh.uv_spheres(params)
    p = mesh.mass_properties(mesh.triangles(v, f)).first()
    assert abs(p.volume - 4 / 3 * np.pi) < 0.05 and p.faces == 2 * 48 * 23
    assert mesh.rejected(v, f).count() == 0
    assert [r.reason for r in mesh.rejected(v, f.withColumn("a", F.when(F.col("fid") == 5, 9999).otherwise(F.col("a")))).collect()] == ["face index out of range"]


def test_config():
    c = Config()
    c.update({"model.num_spheres": 4.0, "random_seed": 7.0})
    assert c.get("model.num_spheres") == 4 and c.get("random_seed") == 7
    with pytest.raises(ConfigError):
        c.update({"model.num_spheres": 9, "model.nothing": 1})
    assert c.get("model.num_spheres") == 4 and Config.from_json(c.to_json()).values == c.values
    with pytest.raises(ConfigError):
        Config({"training": {"flatness_weight": 1.0}}).validate()


def test_a_fleet_spreads_over_partitions(spark):
    v, f = mesh.uv_spheres(spark.sql("SELECT 'ball' AS mesh_id, 0D AS cx, 0D AS cy, 0D AS cz, 1D AS r, 4 AS stacks, 5 AS slices"))
    c = Config.preset("B", **{"model.num_spheres": 2, "training.iterations": 1, "model.num_inside_samples": 20, "model.num_surface_samples": 20, "random_seed": 0}).to_json()
    runs = spark.range(16).selectExpr("id AS run_id", "'ball' AS mesh_id").withColumn("config", F.lit(c))
    parts = fitting.fit(runs, v, f).select("run_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in parts}) >= 8 and len({r.run_id for r in parts}) == 16


def test_cells_of_a_cube(spark):
    """The middles of a cube's eight cells lie on the edges of its triangles as seen along z."""
    v, f = (x.toPandas() for x in mesh.boxes(spark.createDataFrame([("m", 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "mesh_id string, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")))
    v, f = v.sort_values("vid")[["x", "y", "z"]].to_numpy(float), f.sort_values("fid")[["a", "b", "c"]].to_numpy(int)
    cells = np.stack(np.meshgrid(*[[0.25, 0.75]] * 3, indexing="ij"), -1).reshape(-1, 3)
    assert fitting.contains_robust(cells, v, f).all() and not fitting.contains_robust(cells + 1, v, f).any()


def test_thin_meshes_are_filled_up(spark):
    flat = spark.createDataFrame([("thin", 0.0, 1.0, 0.0, 1.0, 0.0, 1e-7), ("cube", 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "mesh_id string, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    tri = mesh.with_normals(mesh.triangles(*mesh.boxes(flat)))
    p = mesh.mass_properties(tri)
    got = sampling.voxel_centers(p, tri, 6, tries=2).toPandas()
    assert got.groupby("mesh_id").sid.apply(sorted).to_dict() == {"thin": list(range(6)), "cube": list(range(6))}
    pts = sampling.inside(p, tri, 30).toPandas()
    assert pts.groupby("mesh_id").pid.apply(sorted).to_dict() == {"thin": list(range(30)), "cube": list(range(30))}
    opened = tri.where("mesh_id = 'cube' OR fid > 11")
    left = sampling.inside(p, opened, 5, rounds=2).toPandas()
    assert left[left.mesh_id == "thin"].pid.isna().tolist() == [True] and len(left[left.mesh_id == "cube"]) == 5
