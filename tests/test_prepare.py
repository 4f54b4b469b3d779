import json

import numpy as np
from sphaera.operators import mesh
from sphaera.plans import prepare as P

F = np.array(mesh.BOX_FACES)


def box(lo, hi):
    return np.array([[(lo, hi)[i][0], (lo, hi)[j][1], (lo, hi)[k][2]] for k in (0, 1) for j in (0, 1) for i in (0, 1)], float)


def both(*boxes):
    return np.vstack(boxes), np.vstack([F + 8 * k for k in range(len(boxes))])


ONE, TWO, OFF = box((0, 0, 0), (1, 1, 1)), box((0.5, 0.4, 0.3), (1.5, 1.4, 1.3)), box((3, 0, 0), (4, 1, 1))


def test_actions():
    action = lambda *a, **k: {x: P.prepare(*a, **k)[2][x] for x in ("action", "n_bodies", "n_closed", "n_open", "overlapping")}
    assert action(ONE, F) == {"action": "unchanged", "n_bodies": 1, "n_closed": 0, "n_open": 0, "overlapping": False}
    assert action(*both(ONE, OFF)) == {"action": "unchanged", "n_bodies": 2, "n_closed": 2, "n_open": 0, "overlapping": False}
    assert action(*both(ONE, TWO)) == {"action": "skipped", "n_bodies": 2, "n_closed": 2, "n_open": 0, "overlapping": True}
    v, f = both(ONE, TWO)
    assert action(v, f[:-1])["n_open"] == 1 and action(v, f, union=False)["action"] == "disabled"
    assert action(np.zeros((0, 3)), np.zeros((0, 3), int))["action"] == "unchanged"


def test_hull_of_a_prism():
    v, f = map(np.array, mesh.l_prism(1.0))
    hv, hf, report = P.prepare(v, f, convex_hull=True)
    assert report["action"] == "hulled" and np.isclose(report["volume_after"], 3.5) and P.closed(hf)
    ball = np.random.default_rng(1).standard_normal((60, 3))
    ball /= np.linalg.norm(ball, axis=1, keepdims=True)
    hv, hf = P.hull(ball)
    assert len(hv) == 60 and len(hf) == 2 * 60 - 4 and P.closed(hf) and P.signed_volume(hv, hf) > 0
    assert len(P.hull(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]]))[1]) == 0


def test_winding_is_mended():
    f = F.copy()
    f[[2, 5, 7]] = f[[2, 5, 7]][:, [0, 2, 1]]
    out = P.rewound(ONE, f)
    assert P.closed(out) and np.isclose(P.signed_volume(ONE, out), 1)
    inward = F[:, [0, 2, 1]]
    assert np.isclose(P.signed_volume(ONE, P.rewound(ONE, inward)), 1)


def test_fleet(spark):
    v, f = mesh.from_rows(spark, "m", *both(ONE, OFF))
    r = P.prepare_meshes(P.flat_meshes(v, f), convex_hull=True).first()
    assert json.loads(r.report)["n_hulled"] == 2 and len(r.f) == 72
