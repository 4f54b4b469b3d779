import json

from sphaera import __main__ as cli
from sphaera.operators import mesh, quality
from sphaera.sources import files, formats


def test_pack_metrics_export(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.obj").write_text(formats.write_obj(*mesh.l_prism(1.0)))
    config = tmp_path / "c.json"
    config.write_text('{"training": {"iterations": 7}}')
    args = ["pack", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--config", str(config), "--spheres", "6", "--seed", "1", "--set", "model.num_inside_samples=80", "--set", "model.num_surface_samples=80"]
    assert cli.settings(cli.arguments(args)).get("training.iterations") == 7
    cli.main(args)
    cli.main(["metrics", str(tmp_path / "in"), str(tmp_path / "out")])
    row = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert 1 <= row["actual_n"] <= 6 and row["n_out"] == 0 and 0 < row["r_in"] <= 1
    cli.main(["export", str(tmp_path / "out"), "--anchored"])
    assert "<robot" in capsys.readouterr().out
    cli.main(["presets"])
    assert capsys.readouterr().out.count("coverage") == 5


def test_mesh_stats(spark, tmp_path):
    (tmp_path / "t.obj").write_text(formats.write_obj(*mesh.l_prism(1.0)))
    (tmp_path / "flat.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    vertex, face, _ = files.read_meshes(spark, str(tmp_path))
    rows = {r.mesh_id.rpartition("/")[2]: r for r in quality.mesh_stats(vertex, face).collect()}
    assert abs(rows["t.obj"].volume_est - 3) < 0.1 and rows["t.obj"].error is None and rows["flat.obj"].error == "no extent"
