"""Preparing meshes for fitting: bodies, winding, hulls and the decision what to fit."""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.plans.fitting import contains

NO_UNION = "no union kernel is at hand"


def merged(vertices, faces, decimals: int = 8):
    """Vertices that agree to so many decimals (half-even) made one, in the order of first use."""
    used = vertices[faces.reshape(-1)]
    _, first, back = np.unique(np.rint(used * 10.0**decimals) + 0.0, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    return used[np.sort(first)], rank[back.reshape(-1)].reshape(-1, 3)


def edge_table(faces):
    """(edges as sorted pairs, whether a face runs them upwards, their faces), three rows a face."""
    e = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    return np.sort(e, axis=1), e[:, 0] < e[:, 1], np.tile(np.arange(len(faces)), 3)


def neighbours(faces):
    """(f, g, whether they run the shared edge alike) of faces at edges that just two use."""
    pairs, up, owner = edge_table(faces)
    _, back, count = np.unique(pairs, axis=0, return_inverse=True, return_counts=True)
    rows = np.argsort(back.reshape(-1), kind="stable")
    rows = rows[count[back.reshape(-1)[rows]] == 2].reshape(-1, 2)
    return owner[rows[:, 0]], owner[rows[:, 1]], up[rows[:, 0]] == up[rows[:, 1]]


def split(faces) -> list:
    """Indices of the faces of each body, bodies in the order of their lowest face."""
    f, g, _ = neighbours(faces)
    label = np.arange(len(faces))
    while True:
        low = np.minimum(label[f], label[g])
        new = label.copy()
        np.minimum.at(new, f, low)
        np.minimum.at(new, g, low)
        new = new[new]
        if (new == label).all():
            return [np.flatnonzero(label == k) for k in np.unique(label)]
        label = new


def signed_volume(vertices, faces) -> float:
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    return float(np.einsum("ij,ij->", a, np.cross(b, c)) / 6)


def closed(faces) -> bool:
    """Each edge is used once each way."""
    pairs, up, _ = edge_table(faces)
    _, back, count = np.unique(pairs, axis=0, return_inverse=True, return_counts=True)
    ways = np.bincount(back.reshape(-1), np.where(up, 1, -1))
    return bool((count == 2).all() and (ways == 0).all())


def rewound(vertices, faces):
    """Faces turned so that neighbours agree, breadth first from the lowest; a closed body of negative volume is turned as a whole."""
    f, g, alike = neighbours(faces)
    around: dict = {}
    for a, b, same in zip(f.tolist(), g.tolist(), alike.tolist()):
        around.setdefault(a, []).append((b, same))
        around.setdefault(b, []).append((a, same))
    turn: dict = {}
    for start in range(len(faces)):
        if start in turn:
            continue
        turn[start], queue = False, deque([start])
        while queue:
            a = queue.popleft()
            for b, same in around.get(a, ()):
                if b not in turn:
                    turn[b] = turn[a] ^ same
                    queue.append(b)
    flip = np.array([turn[k] for k in range(len(faces))])
    out = np.where(flip[:, None], faces[:, [0, 2, 1]], faces)
    return out[:, [0, 2, 1]] if closed(out) and signed_volume(vertices, out) < 0 else out


def hull(points):
    """(vertices, faces) of the convex hull, faces seen from outside; none for points in a plane.

    Incremental: a point outside replaces the faces that see it by a fan from their horizon.
    """
    p = np.unique(np.asarray(points, float), axis=0)
    size = np.ptp(p, axis=0).max() if len(p) else 0.0
    eps = 1e-10 * max(size, 1e-300)
    none = np.empty((0, 3)), np.empty((0, 3), int)
    if len(p) < 4:
        return none
    a = 0
    b = int(np.linalg.norm(p - p[a], axis=1).argmax())
    off = np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)
    c = int(off.argmax())
    n = np.cross(p[b] - p[a], p[c] - p[a])
    height = (p - p[a]) @ n
    d = int(np.abs(height).argmax())
    if off[c] <= eps * size or abs(height[d]) <= eps * np.linalg.norm(n):
        return none
    if height[d] > 0:
        b, c = c, b
    faces = [(a, b, c), (a, d, b), (b, d, c), (c, d, a)]
    far = np.argsort(-np.linalg.norm(p - p.mean(0), axis=1), kind="stable")
    for k in (int(x) for x in far if x not in (a, b, c, d)):
        t = np.array(faces)
        q = p[t]
        n = np.cross(q[:, 1] - q[:, 0], q[:, 2] - q[:, 0])
        sees = np.einsum("ij,ij->i", n, p[k] - q[:, 0]) > eps * np.linalg.norm(n, axis=1)
        if not sees.any():
            continue
        edges = {(int(x[i]), int(x[(i + 1) % 3])) for x in t[sees] for i in range(3)}
        faces = [tuple(map(int, x)) for x in t[~sees]] + [(u, v, k) for u, v in sorted(edges) if (v, u) not in edges]
    used, ids = np.unique(np.array(faces), return_inverse=True)
    return p[used], ids.reshape(-1, 3)


def overlap(bodies) -> bool:
    """Some body's vertex lies in another body whose box its own meets."""
    box = [(v.min(0), v.max(0)) for v, _ in bodies]
    for i in range(len(bodies)):
        for j in range(i + 1, len(bodies)):
            if (box[i][0] < box[j][1]).all() and (box[j][0] < box[i][1]).all():
                if contains(bodies[i][0], *bodies[j]).any() or contains(bodies[j][0], *bodies[i]).any():
                    return True
    return False


def _plural(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def prepare(vertices, faces, union: bool = True, convex_hull: bool = False):
    """(vertices, faces, report) of what to fit: the mesh itself, or the hulls of its bodies.  Never fails: a failure is reported as skipped.

    The actions: disabled (nothing asked for), unchanged, hulled, skipped.  Overlapping closed
    bodies would be united; without a kernel for that they are skipped, with a warning.
    """
    vertices, faces = np.asarray(vertices, float), np.asarray(faces, int)
    volume = abs(signed_volume(vertices, faces))
    report = {"action": "unchanged", "reason": "", "n_bodies": 0, "n_closed": 0, "n_open": 0, "n_degenerate_dropped": 0, "n_hulled": 0, "overlapping": False, "faces_before": len(faces), "faces_after": len(faces), "volume_before": volume, "volume_after": volume, "warnings": []}
    if not union and not convex_hull:
        return vertices, faces, report | {"action": "disabled"}
    try:
        return _decided(vertices, faces, union, convex_hull, report)
    except Exception as e:
        return vertices, faces, report | {"action": "skipped", "reason": f"preparation failed: {e}", "warnings": [f"preparation failed ({e}); the mesh is fitted as it is"]}


def _decided(vertices, faces, union, convex_hull, report):
    v, f = merged(vertices, faces)
    bodies = [(v, f[k]) for k in split(f)]
    kept = [merged(*b) for b in bodies if len(b[1]) >= 4 and signed_volume(*b) != 0]
    report["n_degenerate_dropped"] = len(bodies) - len(kept)
    if convex_hull and kept:
        hulls = [h for h in (hull(b[0]) for b in kept) if len(h[1]) >= 4]
        report["n_degenerate_dropped"] += len(kept) - len(hulls)
        report["n_hulled"], kept = len(hulls), hulls
    report["n_bodies"] = n = len(kept)

    def unless_hulled(reason: str, hulled: str):
        if not report["n_hulled"]:
            return vertices, faces, report | {"reason": reason}
        base = np.cumsum([0] + [len(b[0]) for b in kept[:-1]])
        hv, hf = np.vstack([b[0] for b in kept]), np.vstack([b[1] + k for b, k in zip(kept, base)])
        return hv, hf, report | {"action": "hulled", "reason": hulled, "faces_after": len(hf), "volume_after": signed_volume(hv, hf)}

    if not union:
        return unless_hulled("", f"{_plural(n, 'body', 'bodies')} replaced by convex hulls")
    if n <= 1:
        return unless_hulled("single body", "single body replaced by its convex hull")
    kept = [(b[0], rewound(*b)) for b in kept]
    report["n_closed"] = sum(closed(b[1]) for b in kept)
    report["n_open"] = n - report["n_closed"]
    report["overlapping"] = overlap(kept)
    if not report["overlapping"]:
        return unless_hulled(f"{n} disjoint bodies", f"{n} disjoint bodies replaced by convex hulls")
    why = f"{report['n_open']} of {n} overlapping bodies are open" if report["n_open"] else NO_UNION
    return vertices, faces, report | {"action": "skipped", "reason": why, "warnings": [f"{n} overlapping bodies stay apart: {why}; what they share counts as outside"]}


def prepare_meshes(meshes: DataFrame, union: bool = True, convex_hull: bool = False) -> DataFrame:
    """mesh_id, v, f (flat arrays) and the report as JSON of rows of mesh_id, v, f; a row is a task's unit."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                v, f, report = prepare(np.asarray(r.v, float).reshape(-1, 3), np.asarray(r.f, int).reshape(-1, 3), union, convex_hull)
                rows.append((r.mesh_id, v.ravel().tolist(), f.ravel().astype(np.int32), json.dumps(report)))
            yield pd.DataFrame(rows, columns=["mesh_id", "v", "f", "report"])

    return meshes.select("mesh_id", "v", "f").mapInPandas(run, "mesh_id string, v array<double>, f array<int>, report string")


def flat_meshes(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """mesh_id, v, f: a row for each mesh, its coordinates and corners as flat arrays in the order of their ids."""
    flat = lambda rows, *names: F.flatten(F.transform(F.sort_array(rows), lambda x: F.array(*(x[n] for n in names))))
    v = vertex.groupBy("mesh_id").agg(flat(F.collect_list(F.struct("vid", "x", "y", "z")), "x", "y", "z").alias("v"))
    f = face.groupBy("mesh_id").agg(flat(F.collect_list(F.struct("fid", "a", "b", "c")), "a", "b", "c").alias("f"))
    return v.join(f, "mesh_id").select(F.col("mesh_id").cast("string"), "v", "f")
