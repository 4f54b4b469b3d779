import json

import pytest
from sphaera.plans.config import Config
from sphaera.sources import results


def test_round_trip(spark):
    s = spark.createDataFrame([(1, k, 0.5 * k, 1.0, -2.0, 0.1 + k, 3.0) for k in (2, 0, 1)], "run_id long, sid int, cx double, cy double, cz double, r double, m double")
    runs = spark.createDataFrame([(1, "a.obj", False, '{"action":"unchanged"}', Config().to_json())], "run_id long, mesh_path string, per_sphere_mass boolean, prep string, config string")
    out = results.to_json(s, runs).cache()
    j = json.loads(out.first().result)
    assert j["centers"][2] == [1.0, 1.0, -2.0] and j["num_spheres"] == 3 and j["config"] == Config().values
    assert sorted(map(tuple, results.spheres_of(out).collect())) == sorted(map(tuple, s.collect()))
    flags = results.preparation_flags(out).first()
    assert flags.union and not flags.hull
    bad = spark.createDataFrame([(1, '{"centers":[[0,0,0]],"radii":[]}')], "run_id long, result string")
    with pytest.raises(Exception, match="differ in length"):
        results.spheres_of(bad).collect()
