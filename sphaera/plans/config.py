"""Settings of a fitting run: sections of typed values, dotted updates that are all made or none."""

from __future__ import annotations

import copy
import json
import math

from sphaera.operators.losses import LOSSES, PRESETS

#: The settings and their defaults.
DEFAULTS: dict = {
    "model": {
        "num_spheres": 25, "mesh_path": "", "device": "auto", "initial_radius_variation": 0.1, "num_inside_samples": 5000, "num_surface_samples": 5000,
        "max_spheres": 25, "density": 1000.0, "per_sphere_mass": False, "union_overlapping_bodies": True, "convex_hull": False,
    },
    "training": {
        "iterations": 300, "verbose_frequency": 50, "logging_enabled": False, "center_lr": 0.002, "radius_lr": 0.005, "mass_lr": 0.01, "grad_clip_norm": 1.0,
        "coverage_weight": 10.0, "overlap_weight": 0.01, "boundary_weight": 5.0, "surface_weight": 5.0, "containment_weight": 5.0, "sqem_weight": 800.0,
        "mass_weight": 0.0, "com_weight": 0.0, "inertia_weight": 0.0, "flatness_weight": 0.0, "hausdorff_weight": 0.0, "mesh_containment_weight": 0.0,
        "early_stopping": False, "convergence_patience": 50, "convergence_threshold": 0.001, "density_control_enabled": True, "density_control_min_interval": 160,
        "density_control_patience": 1, "density_control_grad_threshold": 1e-4, "density_control_warmup_steps": 10, "density_control_cooling_factor": 0.85,
        "density_control_min_radius_fraction": 0.001, "prune_contained_spheres": True,
    },
    "results_dir": "results/output", "output_filename": "results.json", "random_seed": None,
}
#: The settings that a request may override.
ADVANCED = ("center_lr", "radius_lr", "mass_lr", "grad_clip_norm", "early_stopping", "convergence_patience", "convergence_threshold", "density_control_min_interval", "density_control_patience", "density_control_grad_threshold", "density_control_enabled", "num_inside_samples", "num_surface_samples", "initial_radius_variation")


class ConfigError(ValueError):
    """A setting that is unknown or out of range; ``key`` names it."""

    def __init__(self, key: str, why: str):
        super().__init__(f"{key}: {why}")
        self.key = key


class Config:
    def __init__(self, values: dict | None = None):
        self.values = copy.deepcopy(DEFAULTS)
        for section, rest in (values or {}).items():
            self.update({f"{section}.{k}": v for k, v in rest.items()} if isinstance(rest, dict) else {section: rest})

    @classmethod
    def preset(cls, name: str, **updates) -> Config:
        if name not in PRESETS:
            raise ConfigError("preset", f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
        out = cls()
        out.weights = dict(zip(LOSSES, PRESETS[name], strict=True))
        out.update(updates)
        return out

    def _slot(self, values: dict, key: str) -> tuple[dict, str]:
        section, _, name = key.rpartition(".")
        at = values.get(section) if section else values
        if not isinstance(at, dict):
            raise ConfigError(key, f"unknown section {section!r}")
        if name not in at or isinstance(at[name], dict):
            raise ConfigError(key, "unknown parameter")
        return at, name

    def get(self, key: str):
        at, name = self._slot(self.values, key)
        return at[name]

    def update(self, updates: dict) -> None:
        """All of the dotted updates, or, if one fails, none."""
        values = copy.deepcopy(self.values)
        for key, value in updates.items():
            at, name = self._slot(values, key)
            old = at[name]
            whole = isinstance(old, int) and not isinstance(old, bool) or old is None
            if whole and isinstance(value, float) and value >= 0 and value == int(value):
                value = int(value)
            if isinstance(old, float) and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if old is not None and type(value) is not type(old):
                raise ConfigError(key, f"expects {type(old).__name__}, got {type(value).__name__}")
            at[name] = value
        self.values = values

    @property
    def weights(self) -> dict[str, float]:
        return {x: self.values["training"][f"{x}_weight"] for x in LOSSES}

    @weights.setter
    def weights(self, w: dict[str, float]) -> None:
        self.update({f"training.{k}_weight": float(v) for k, v in w.items()})

    def validate(self) -> Config:
        m, t = self.values["model"], self.values["training"]
        rules = [(f"model.{k}", m[k] >= 1, "must be at least 1") for k in ("num_spheres", "num_inside_samples", "num_surface_samples")]
        rules += [("model.density", math.isfinite(m["density"]) and m["density"] > 0, "must be positive and finite"), ("model.initial_radius_variation", math.isfinite(m["initial_radius_variation"]) and m["initial_radius_variation"] >= 0, "must be at least 0")]
        rules += [(f"training.{k}", t[k] >= 1, "must be at least 1") for k in ("verbose_frequency", "density_control_patience", "convergence_patience")]
        rules += [(f"training.{k}", math.isfinite(t[k]) and t[k] >= 0, "must be finite and at least 0") for k in ("center_lr", "radius_lr", "mass_lr", "grad_clip_norm")]
        rules += [(f"training.{k}_weight", math.isfinite(v), "must be finite") for k, v in self.weights.items()]
        rules += [("training.flatness_weight", t["flatness_weight"] == 0, "flatness isn't implemented; it must be 0"), ("training.density_control_cooling_factor", 0 < t["density_control_cooling_factor"] <= 1, "must be in (0, 1]"), ("model.device", parse_device(m["device"]) is not None, "unknown device")]
        seed = self.values["random_seed"]
        rules.append(("random_seed", seed is None or 0 <= seed < 1 << 64, "must fit 64 bits and be at least 0"))
        for key, ok, why in rules:
            if not ok:
                raise ConfigError(key, why)
        return self

    def to_json(self) -> str:
        return json.dumps(self.values)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(json.loads(text))


def parse_device(text: str) -> str | None:
    """auto, cpu or gpu (cuda and mps count as gpu, a number may follow gpu or cuda); Spark plans alike for all."""
    kind, colon, number = text.strip().lower().partition(":")
    if colon and not (kind in ("gpu", "cuda") and number.isascii() and number.isdigit()):
        return None
    return {"auto": "auto", "cpu": "cpu", "gpu": "gpu", "cuda": "gpu", "mps": "gpu"}.get(kind)


def from_request(variant: str, num_spheres: int, iterations: int, advanced: dict | None = None, **flags) -> Config:
    """Settings of a service request; overrides that aren't allowed are dropped."""
    if not 1 <= num_spheres <= 200:
        raise ConfigError("num_spheres", "must be between 1 and 200")
    if not 1 <= iterations <= 1000:
        raise ConfigError("iterations", "must be between 1 and 1000")
    out = Config.preset(variant, **{"model.num_spheres": num_spheres, "training.iterations": iterations})
    out.update({f"model.{k}": v for k, v in flags.items()})
    section = lambda k: "model" if k in DEFAULTS["model"] else "training"
    out.update({f"{section(k)}.{k}": v for k, v in (advanced or {}).items() if k in ADVANCED})
    return out.validate()
