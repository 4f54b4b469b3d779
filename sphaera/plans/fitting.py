"""The fitting loop: one Arrow-fed numpy kernel for each run, many runs at once.

A relational plan for each of some hundred iterations would be hundreds of jobs for a second
of work, so the loop runs within a group: ``fit`` feeds each run's mesh and samples to
``Fitter`` and returns a row for each step and each sphere.  ``Fitter.evaluate`` computes the
same losses as ``plans.evaluate``; tests hold one against the other.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.operators import sampling
from sphaera.operators.containment import rotation
from sphaera.operators.losses import EPS, LOSSES, TOP_SHARE
from sphaera.plans.config import Config

BALL = 4 / 3 * np.pi


def softplus(x):
    return np.where(x > 20, x, np.log1p(np.exp(np.minimum(x, 20))))


def softplus_grad(x):
    return np.where(x > 20, 1.0, 1 / (1 + np.exp(-np.minimum(x, 20))))


def inv_softplus(y):
    return y + np.log(-np.expm1(-y))


def lower_median(v):
    return np.sort(v)[(len(v) - 1) // 2]


def face_vectors(vertices, faces):
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    w = np.cross(b - a, c - a)
    length = np.linalg.norm(w, axis=1)
    return a, b, c, np.divide(w, length[:, None], out=np.zeros_like(w), where=length[:, None] > 0), length / 2


def properties(vertices, faces):
    """(volume, center, inertia about it at density 1)."""
    a, b, c, _, _ = face_vectors(vertices, faces)
    v = np.einsum("ij,ij->i", a, np.cross(b, c)) / 6
    s = a + b + c
    volume = v.sum()
    first = (v[:, None] * s).sum(0) / 4
    second = sum(np.einsum("i,ij,ik->jk", v, p, p) for p in (a, b, c, s)) / 20
    com = first / volume
    central = second - volume * np.outer(com, com)
    return volume, com, np.trace(central) * np.eye(3) - central


def parities(points, vertices, faces, block: int = 1 << 22):
    """Whether the ray upwards along z and the one downwards cross the mesh an odd number of times, edges excluded, for each point; in blocks of bounded memory."""
    a, b, c, n, _ = face_vectors(vertices, faces)
    keep = np.abs(n[:, 2]) > 0
    a, b, c, n = a[keep], b[keep], c[keep], n[keep]
    lo, hi = vertices[np.unique(faces)].min(0), vertices[np.unique(faces)].max(0)
    up, down = np.zeros((2, len(points)), bool)
    some = np.flatnonzero(((points >= lo) & (points <= hi)).all(1))
    step = max(1, block // max(1, len(a)))
    for k in range(0, len(some), step):
        p = points[some[k : k + step], None, :]
        side = [(q[:, 0] - r[:, 0]) * (p[..., 1] - r[:, 1]) - (q[:, 1] - r[:, 1]) * (p[..., 0] - r[:, 0]) for r, q in ((a, b), (b, c), (c, a))]
        hit = ((side[0] > 0) & (side[1] > 0) & (side[2] > 0)) | ((side[0] < 0) & (side[1] < 0) & (side[2] < 0))
        depth = a[:, 2] - (n[:, 0] * (p[..., 0] - a[:, 0]) + n[:, 1] * (p[..., 1] - a[:, 1])) / n[:, 2]
        above = depth >= p[..., 2]
        up[some[k : k + step]] = (hit & above).sum(1) % 2 == 1
        down[some[k : k + step]] = (hit & ~above).sum(1) % 2 == 1
    return up, down


def contains(points, vertices, faces):
    """The exact test: both rays along z."""
    up, down = parities(points, vertices, faces)
    return up & down


def contains_robust(points, vertices, faces):
    """By a tilted ray where its two halves agree, else by the exact test, as ``containment.robust`` does."""
    turn = rotation().T
    up, down = parities(points @ turn, vertices @ turn, faces)
    odd = np.flatnonzero(up != down)
    up[odd] = contains(points[odd], vertices, faces)
    return up


def nested(centers, radii):
    """Which spheres lie within another; of two that hold one another the first stays."""
    d = np.linalg.norm(centers[:, None] - centers[None], axis=2)
    holds = d + radii[None] <= radii[:, None]
    np.fill_diagonal(holds, False)
    mutual = holds & holds.T
    holds &= ~(mutual & (np.arange(len(radii))[:, None] > np.arange(len(radii))[None]))
    return holds.any(0)


class Adam:
    def __init__(self, lr, shape):
        self.lr, self.t, self.m, self.v = lr, 0, np.zeros(shape), np.zeros(shape)

    def step(self, x, g):
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return x - self.lr / (1 - 0.9**self.t) * self.m / (np.sqrt(self.v) / np.sqrt(1 - 0.999**self.t) + 1e-8)


def clipped(g, most):
    return g * min(1.0, most / (np.linalg.norm(g) + 1e-6))


class Fitter:
    """State and loop of one run."""

    def __init__(self, config: Config, vertices, faces, inside, surface, normals, centers, radii, masses=None):
        self.config, self.t, self.m = config, config.values["training"], config.values["model"]
        self.vertices, self.faces = np.asarray(vertices, float), np.asarray(faces, int)
        self.inside, self.surface, self.normals = (np.asarray(x, float).reshape(-1, 3) for x in (inside, surface, normals))
        used = self.vertices[np.unique(self.faces)]
        self.scale = np.linalg.norm(used.max(0) - used.min(0))
        volume, self.com, inertia = properties(self.vertices, self.faces)
        self.density = self.m["density"]
        self.mass, self.inertia = volume * self.density, inertia * self.density
        self.weights = config.weights
        self.centers, self.raw = np.array(centers, float).reshape(-1, 3), inv_softplus(np.asarray(radii, float))
        self.raw_mass = None
        if self.m["per_sphere_mass"]:
            masses = np.full(len(self.raw), self.mass / len(self.raw)) if masses is None else np.asarray(masses, float)
            self.raw_mass = inv_softplus(masses)
        self.iteration, self.steps, self.events, self.last_event, self.temperature, self.state = 0, [], [], 0, 0.4, "running"
        self.reset()

    def reset(self):
        self.opt = Adam(self.t["center_lr"], self.centers.shape), Adam(self.t["radius_lr"], self.raw.shape), Adam(self.t["mass_lr"], self.raw.shape)

    @property
    def radii(self):
        return softplus(self.raw)

    @property
    def masses(self):
        return softplus(self.raw_mass) if self.raw_mass is not None else self.density * BALL * self.radii**3

    def evaluate(self, weights=None):
        """(raw loss by name, total, gradients of centers, raw radii, raw masses); losses of weight 0 are skipped."""
        w = {k: v for k, v in (weights or self.weights).items() if v}
        c, r, n = self.centers, self.radii, len(self.raw)
        gc, gr, gm, raw = np.zeros_like(c), np.zeros(n), np.zeros(n), dict.fromkeys(LOSSES, 0.0)

        def distances(p):
            return np.sqrt(np.maximum(self.squares(p), 0))

        def toward(d):
            return 1 / np.maximum(d, 1e-300) * (d > 0)

        def near(p, d):
            j = (d - r).argmin(1)
            v = p - c[j]
            best = np.sqrt(np.einsum("ij,ij->i", v, v))
            return j, best - r[j], v * toward(best)[:, None]

        def add(into, j, values):
            """Sums of values by j, a column at a time."""
            if into.ndim == 1:
                into += np.bincount(j, values, n)
            else:
                for k in range(3):
                    into[:, k] += np.bincount(j, values[:, k], n)

        def pull(j, unit, slope):
            """d gap / d center is -unit, d gap / d radius -1."""
            add(gc, j, -slope[:, None] * unit)
            add(gr, j, -slope)

        if "coverage" in w:
            j, gap, unit = near(self.inside, distances(self.inside))
            raw["coverage"] = np.maximum(gap, 0).mean()
            pull(j, unit, w["coverage"] * (gap > 0) / len(gap))
        if {"overlap", "containment"} & w.keys():
            off = ~np.eye(n, dtype=bool)
            across = lambda w: w.sum(1)[:, None] * c - w @ c  # noqa: E731  sums of weighted differences to all centers
            d = np.linalg.norm(c[:, None] - c[None], axis=2)
            if "overlap" in w:
                deep = r[:, None] + r[None] - d
                on = (deep > 0) & off
                raw["overlap"] = (deep * on).sum() / n**2
                gr += w["overlap"] * 2 * on.sum(1) / n**2
                gc -= w["overlap"] * 2 / n**2 * across(on * toward(d))
            if "containment" in w:
                e = np.maximum(r[None] - d - r[:, None], 0) * off
                raw["containment"] = (e * e).sum() / n**2
                k = w["containment"] * 2 / n**2
                gr += k * (e.sum(0) - e.sum(1))
                gc -= k * across((e + e.T) * toward(d))
        if {"boundary", "surface", "sqem", "hausdorff"} & w.keys():
            d, s = distances(self.surface), len(self.surface)
            if "boundary" in w:
                on = r - d > 0
                raw["boundary"] = ((r - d) * on).sum() / (s * n)
                k = w["boundary"] / (s * n)
                gr += k * on.sum(0)
                pairs = on * toward(d)
                gc += k * (pairs.T @ self.surface - pairs.sum(0)[:, None] * c)
            j, gap, unit = near(self.surface, d)
            if "surface" in w:
                raw["surface"] = np.abs(gap).mean()
                pull(j, unit, w["surface"] * np.sign(gap) / s)
            if "sqem" in w:
                e = np.einsum("ij,ij->i", self.normals, self.surface - c[j]) - r[j]
                raw["sqem"] = (e * e).mean()
                k = w["sqem"] * 2 * e / s
                add(gc, j, -k[:, None] * self.normals)
                add(gr, j, -k)
            if "hausdorff" in w:
                h = np.maximum(gap, 0)
                top = np.argsort(-h, kind="stable")[: max(1, int(TOP_SHARE * s))]
                raw["hausdorff"] = (h[top] ** 2).mean()
                slope = np.zeros(s)
                slope[top] = w["hausdorff"] * 2 * h[top] / len(top)
                pull(j, unit, slope)
        if "mesh_containment" in w:
            i = self.nearest_samples()
            sd = np.maximum(np.einsum("ij,ij->i", self.normals[i], c - self.surface[i]), 0)
            raw["mesh_containment"] = (sd * sd).mean()
            gc += w["mesh_containment"] * 2 / n * sd[:, None] * self.normals[i]
        if {"mass", "com", "inertia"} & w.keys():
            m = self.masses
            total = m.sum()
            center = m @ c / total
            x = c - center
            if "mass" in w:
                k = self.mass**2 + EPS
                raw["mass"] = (total - self.mass) ** 2 / k
                gm += w["mass"] * 2 * (total - self.mass) / k
            if "com" in w:
                e, k = center - self.com, self.scale**2 + EPS
                raw["com"] = e @ e / k
                gc += w["com"] * 2 / k * np.outer(m / total, e)
                gm += w["com"] * 2 / k * (x @ e) / total
            if "inertia" in w:
                own = np.einsum("i,ij,ik->jk", m, x, x)
                inertia = ((0.4 * m * r * r).sum() + np.trace(own)) * np.eye(3) - own
                e, k = inertia - self.inertia, (self.inertia**2).sum() + EPS
                raw["inertia"] = (e * e).sum() / k
                f, tr = w["inertia"] * 2 / k, np.trace(e)
                gr += f * tr * 0.8 * m * r
                gc += f * 2 * m[:, None] * (tr * x - x @ e)
                gm += f * (tr * 0.4 * r * r + tr * (x * x).sum(1) - np.einsum("ij,jk,ik->i", x, e, x))
        if self.raw_mass is None:
            gr += gm * self.density * 4 * np.pi * r * r
            graw_mass = None
        else:
            graw_mass = gm * softplus_grad(self.raw_mass)
        total = 0.0
        for k in LOSSES:
            if k in w:
                total += w[k] * raw[k]
        return raw, total, gc, gr * softplus_grad(self.raw), graw_mass

    def squares(self, p):
        """Squared distances of points to all centers by one matrix product, about the mesh's center to lose no digits."""
        q, c = p - self.com, self.centers - self.com
        out = q @ (-2 * c.T)
        out += (q * q).sum(1)[:, None]
        out += (c * c).sum(1)[None]
        return out

    def nearest_samples(self):
        q = self.surface - self.com
        return ((q * q).sum(1)[None] - 2 * ((self.centers - self.com) @ q.T)).argmin(1)

    def project(self):
        """Moves centers that are outside along their nearest sample's normal; how many moved."""
        i = self.nearest_samples()
        sd = np.einsum("ij,ij->i", self.normals[i], self.centers - self.surface[i])
        out = sd > 0
        self.centers[out] -= (sd[out] + 1e-4 * self.scale)[:, None] * self.normals[i][out]
        return int(out.sum())

    def step(self):
        """One iteration; its record also goes to ``steps``."""
        t, it, n = self.t, self.iteration, len(self.raw)
        raw, total, gc, gr, gm = self.evaluate()
        pos, rad = float(np.linalg.norm(gc, axis=1).mean()), float(np.linalg.norm(gr))
        self.centers = self.opt[0].step(self.centers, clipped(gc, t["grad_clip_norm"]))
        self.raw = self.opt[1].step(self.raw, clipped(gr, t["grad_clip_norm"] / 2))
        if gm is not None:
            self.raw_mass = self.opt[2].step(self.raw_mass, gm)
        projected, radii = self.project(), self.radii
        self.steps.append({"iteration": it, "total_loss": float(total), "weighted": [float(self.weights[k] * raw[k]) for k in LOSSES], "pos_grad": pos, "rad_grad": rad, "num_spheres": n, "min_r": float(radii.min()), "max_r": float(radii.max()), "mean_r": float(radii.mean()), "projected": projected})
        converged = it % t["verbose_frequency"] == 0 and t["early_stopping"] and it > t["convergence_patience"] and self.converged()
        if converged:
            self.state = "converged"
        elif t["density_control_enabled"] and self.dense_enough():
            added, removed = self.repack()
            self.events.append({"iteration": it, "added": added, "removed": removed})
            self.last_event = it
            if added or removed:
                self.reset()
        self.iteration += 1
        if self.state == "running" and self.iteration >= t["iterations"]:
            self.state = "completed"
        return self.steps[-1]

    def _recent(self, n):
        last = self.steps[-n:]
        first, end = last[0]["total_loss"], last[-1]["total_loss"]
        return abs(first - end) / max(abs(first), 1e-5), last

    def converged(self):
        n = self.t["convergence_patience"]
        if len(self.steps) < n:
            return False
        change, last = self._recent(n)
        return change < self.t["convergence_threshold"] or sum(s["pos_grad"] < 1e-4 and s["rad_grad"] < 1e-4 for s in last) > n // 2

    def dense_enough(self):
        t, since = self.t, max(0, self.iteration - self.last_event)
        if since < t["density_control_min_interval"]:
            return False
        if since > 2 * t["density_control_min_interval"]:
            return True
        n = t["density_control_patience"]
        if len(self.steps) < n:
            return False
        change, last = self._recent(n)
        few = lambda k: sum(s[k] < t["density_control_grad_threshold"] for s in last) > n // 2
        return change < 0.01 or few("pos_grad") and few("rad_grad")

    def marginal_values(self):
        out = np.zeros(len(self.raw))
        for samples, weight in ((self.inside, self.t["coverage_weight"]), (self.surface, self.t["surface_weight"] + self.t["boundary_weight"] + self.t["sqem_weight"])):
            if weight > 0 and len(samples):
                gap = np.sqrt(np.maximum(self.squares(samples), 0)) - self.radii
                j = gap.argmin(1)
                best = gap.min(1)
                second = np.partition(gap, 1, axis=1)[:, 1] if gap.shape[1] > 1 else np.full(len(gap), 1e6)
                np.add.at(out, j, weight * (second - best))
        return out

    def repack(self):
        """Culls spheres of little value, puts as many where the mesh is least covered, warms them up; (added, removed)."""
        n, radii, target = len(self.raw), self.radii, self.m["num_spheres"]
        bad = (radii < self.t["density_control_min_radius_fraction"] * self.scale) | ~contains(self.centers, self.vertices, self.faces)
        k = min(max(int(target * self.temperature), 1, int(bad.sum())), max(target - 1, 0), n - 1)
        if k <= 0:
            return 0, 0
        value = np.where(bad, -np.inf, self.marginal_values())
        keep = np.lexsort((np.arange(n), -value))[: n - k]
        kept_mass = None if self.raw_mass is None else self.masses[keep]
        centers, radii = self.centers[keep], radii[keep]
        gap = (np.linalg.norm(self.inside[:, None] - centers[None], axis=2) - radii).min(1)
        middle, new_c, new_r = lower_median(radii), [], []
        for _ in range(k):
            i = gap.argmax()
            r = min(max(gap[i], middle), 1.5 * middle, 0.3 * self.scale)
            new_c.append(self.inside[i])
            new_r.append(r)
            gap = np.minimum(gap, np.linalg.norm(self.inside - self.inside[i], axis=1) - r)
        self.centers, self.raw = np.vstack([centers, new_c]), inv_softplus(np.concatenate([radii, new_r]))
        if kept_mass is not None:
            self.raw_mass = inv_softplus(np.concatenate([kept_mass, np.full(k, lower_median(kept_mass))]))
        self.warm_up(n - k)
        self.temperature = max(self.temperature * self.t["density_control_cooling_factor"], 0.04)
        return k, k

    def warm_up(self, frozen):
        """Steps of the new spheres only."""
        lr = 5 * self.t["center_lr"]
        opt_c, opt_r = Adam(lr, self.centers.shape), Adam(lr / 2, self.raw.shape)
        saved = self.centers[:frozen].copy(), self.raw[:frozen].copy()
        for _ in range(self.t["density_control_warmup_steps"]):
            _, _, gc, gr, _ = self.evaluate()
            gc[:frozen], gr[:frozen] = 0, 0
            self.centers, self.raw = opt_c.step(self.centers, gc), opt_r.step(self.raw, gr)
        self.centers[:frozen], self.raw[:frozen] = saved

    def run(self, on_step=None):
        """Steps until done, or until on_step returns False."""
        while self.state == "running":
            record = self.step()
            if on_step and on_step(record) is False:
                return "cancelled"
        return self.state

    def finalize(self):
        """Drops spheres whose center is outside, keeping one, then those nested in another; how many went. Only once."""
        if self.state == "finalized":
            return 0
        n, inside = len(self.raw), contains(self.centers, self.vertices, self.faces)
        if not inside.any():
            inside[0] = True
        keep = np.flatnonzero(inside)
        if self.t["prune_contained_spheres"]:
            keep = keep[~nested(self.centers[keep], self.radii[keep])]
        self.centers, self.raw = self.centers[keep], self.raw[keep]
        if self.raw_mass is not None:
            self.raw_mass = self.raw_mass[keep]
        self.state = "finalized"
        return n - len(keep)


def sampled(config: Config, vertices, faces):
    """(inside, surface, normals, centers, radii) of a run, drawn from its seed."""
    rng = np.random.default_rng(config.values["random_seed"])
    m = config.values["model"]
    a, b, c, normal, area = face_vectors(vertices, faces)
    used = vertices[np.unique(faces)]
    lo, hi = used.min(0), used.max(0)
    volume, com, _ = properties(vertices, faces)
    n, scale = m["num_spheres"], np.linalg.norm(hi - lo)

    def on_surface(k):
        f = np.minimum(np.searchsorted(np.cumsum(area), rng.random(k) * area.sum()), len(area) - 1)
        p, q = rng.random((2, k))
        over = p + q > 1
        p, q = np.where(over, 1 - p, p), np.where(over, 1 - q, q)
        return a[f] + p[:, None] * (b - a)[f] + q[:, None] * (c - a)[f], normal[f]

    def in_cells(h):
        """The middles of the cells of edge h that are inside; None where there are too many cells."""
        count = np.maximum(np.ceil((hi - lo) / h - 1e-9), 1)
        if count.prod() > sampling.MOST_CELLS:
            return None
        axes = [lo[x] + (np.arange(int(count[x])) + 0.5) * h for x in range(3)]
        cells = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
        return cells[contains_robust(cells, vertices, faces)]

    def fill(need):
        """So many points of the volume, and where it is too thin for them, of the surface, drawn inwards."""
        p = lo + rng.random((max(sampling.FILL_FACTOR * need, sampling.FILL_LEAST), 3)) * (hi - lo)
        p = p[contains_robust(p, vertices, faces)]
        if len(p) < need:
            s, _ = on_surface(2 * need)
            p = np.vstack([p, s + sampling.FILL_PULL * (com - s)])
        return p[:need]

    cells, edge = np.empty((0, 3)), min(max(np.cbrt(volume / n), sampling.LEAST_EDGE * scale), scale)
    for h in edge * sampling.SHRINK ** np.arange(sampling.TRIES):
        found = in_cells(h)
        cells = cells if found is None else found
        if found is None or len(cells) >= n:
            break
    cells = np.vstack([cells, fill(n - len(cells))]) if len(cells) < n else cells
    centers = cells[rng.choice(len(cells), n, replace=False)]
    g = np.exp(m["initial_radius_variation"] * rng.standard_normal(n))
    radii = g * np.cbrt(3 * volume / (4 * np.pi * (g**3).sum()))
    found, batch = np.empty((0, 3)), min(max(2 * m["num_inside_samples"], 1), 10_000)
    for _ in range(10_000):
        p = lo + rng.random((batch, 3)) * (hi - lo)
        found = np.vstack([found, p[contains(p, vertices, faces)]])
        if len(found) >= m["num_inside_samples"]:
            break
    else:
        raise ValueError(f"found only {len(found)} interior points; is the mesh closed?")
    surface, normals = on_surface(m["num_surface_samples"])
    return found[: m["num_inside_samples"]], surface, normals, centers, radii


#: Tasks of a fleet; beyond, a task has several runs.
MOST_TASKS = 20_000
SCHEMA = "run_id string, kind string, iteration long, sid long, cx double, cy double, cz double, r double, m double, record string"


def pack(config: Config, vertices, faces) -> Fitter:
    """A finished run on one mesh."""
    vertices, faces = np.asarray(vertices, float), np.asarray(faces, int)
    fitter = Fitter(config.validate(), vertices, faces, *sampled(config, vertices, faces))
    fitter.run()
    fitter.finalize()
    return fitter


def fit(runs: DataFrame, vertex: DataFrame, face: DataFrame) -> DataFrame:
    """Rows of kind sphere, step, event and error of each run (run_id, mesh_id, config as JSON).

    Meshes travel as arrays, a row each, joined to their runs; a run is one task's group, so
    a fleet of runs spreads over the cluster, and a lost executor repeats its runs only.
    """
    v = vertex.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("v"))
    f = face.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("fid", "a", "b", "c"))).alias("f"))
    flat = lambda c, *names: F.flatten(F.transform(c, lambda x: F.array(*(x[n] for n in names))))
    meshes = v.join(f, "mesh_id").select("mesh_id", flat("v", "x", "y", "z").alias("v"), flat("f", "a", "b", "c").alias("f"))
    rows = runs.select(F.col("run_id").cast("string"), "mesh_id", "config").join(meshes, "mesh_id")
    # dealt out one by one; a number that is given isn't coalesced, however few bytes the runs have
    rows = rows.repartition(max(1, min(runs.count(), MOST_TASKS)))

    def work(batches):
        for pdf in batches:
            for run in pdf.itertuples():
                out = []
                try:
                    done = pack(Config.from_json(run.config), np.asarray(run.v, float).reshape(-1, 3), np.asarray(run.f, int).reshape(-1, 3))
                    for s in done.steps:
                        out.append((run.run_id, "step", s["iteration"], None, None, None, None, None, None, json.dumps(s)))
                    for e in done.events:
                        out.append((run.run_id, "event", e["iteration"], None, None, None, None, None, None, json.dumps(e)))
                    for k, (c, r, m) in enumerate(zip(done.centers, done.radii, done.masses, strict=True)):
                        out.append((run.run_id, "sphere", None, k, *map(float, c), float(r), float(m), None))
                except Exception as e:  # a run that fails is a row, not the end of the fleet
                    out = [(run.run_id, "error", None, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"iteration": "Int64", "sid": "Int64"})

    return rows.mapInPandas(work, SCHEMA)
