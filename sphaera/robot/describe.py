"""Robot descriptions: inspection of collisions, rewriting them as spheres, object models.

The functions here work on one text; ``inspect_packages`` and ``rewrite_packages`` apply
them to DataFrames, a row for each description.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from xml.parsers import expat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sphaera.sources.formats import EXTENSIONS

PRIMITIVES = ("sphere", "box", "cylinder", "capsule")
#: What sphere links weigh, and the largest swing of hues.
LINK_MASS, LINK_INERTIA, HUE_SWING = 0.001, 1e-5, 0.5
CENTROID_MARK = "sphaera:centroid"


@dataclass
class Collision:
    link: str
    index: int
    kind: str
    action: str
    xyz: tuple = (0.0, 0.0, 0.0)
    rpy: tuple = (0.0, 0.0, 0.0)
    filename: str | None = None
    scale: tuple = (1.0, 1.0, 1.0)
    path: str | None = None
    warning: str | None = None


@dataclass
class Report:
    collisions: list = field(default_factory=list)
    visuals: int = 0
    errors: list = field(default_factory=list)


def is_xacro(text: str) -> bool:
    return "<xacro:" in text or re.search(r"\$\{[^}]+\}", text) is not None


def triple(text: str | None, default=(0.0, 0.0, 0.0)) -> tuple:
    try:
        v = tuple(float(x) for x in (text or "").split())
    except ValueError:
        return default
    return v if len(v) == 3 else default


def _scale(text: str | None) -> tuple:
    parts = (text or "").split()
    return triple(" ".join(parts * 3 if len(parts) == 1 else parts), (1.0, 1.0, 1.0))


def inspect(text: str, resolve) -> Report:
    """What is to be done with each collision; resolve(filename) gives a path or None."""
    report = Report()
    if is_xacro(text):
        report.errors.append("unresolved xacro: expand the file first")
        return report
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        report.errors.append(f"not valid XML: {e}")
        return report
    if root.tag != "robot":
        report.errors.append(f"the top element is <{root.tag}>, not <robot>")
        return report
    for link in root.iter("link"):
        name = link.get("name", "<unnamed>")
        report.visuals += sum(v.find("geometry/mesh") is not None for v in link.findall("visual"))
        for k, c in enumerate(link.findall("collision")):
            origin, shape = c.find("origin"), c.find("geometry")
            at = {"xyz": triple(origin.get("xyz")), "rpy": triple(origin.get("rpy"))} if origin is not None else {}
            report.collisions.append(_classify(Collision(name, k, "unknown", "error", **at), shape, resolve))
    return report


def _classify(c: Collision, shape, resolve) -> Collision:
    if shape is None:
        c.warning = "the collision has no geometry"
    elif (mesh := shape.find("mesh")) is not None:
        c.kind, c.filename, c.scale = "mesh", mesh.get("filename", ""), _scale(mesh.get("scale"))
        c.path = resolve(c.filename)
        if c.path is None:
            c.warning = f"mesh not found: {c.filename}"
        elif c.path.rpartition(".")[2].lower() not in EXTENSIONS or "." not in c.path:
            c.warning = f"unsupported mesh format: {c.path}"
        else:
            c.action = "pack"
            if c.scale != (1.0, 1.0, 1.0):
                c.warning = "the mesh's scale is ignored"
    elif (kind := next((p for p in PRIMITIVES if shape.find(p) is not None), None)) is not None:
        c.kind = kind
        c.action = "remove-already-sphere" if kind == "sphere" else "remove-primitive"
        c.warning = f"the {kind} collision is removed; spheres of meshes replace it"
    else:
        c.warning = "unknown collision geometry"
    return c


def rotation(rpy) -> np.ndarray:
    (sr, cr), (sp, cp), (sy, cy) = ((np.sin(a), np.cos(a)) for a in rpy)
    return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])


def placed(center, xyz, rpy) -> tuple:
    """A center in its mesh's frame, in the link's frame; summed left to right."""
    return tuple(float(m[0] * center[0] + m[1] * center[1] + m[2] * center[2]) + t for m, t in zip(rotation(rpy), xyz, strict=True))


def hue_varied(rgba, t: float, variation: float) -> tuple:
    import colorsys

    if variation <= 0:
        return tuple(rgba)
    h, light, s = colorsys.rgb_to_hls(*rgba[:3])
    return (*colorsys.hls_to_rgb((h + t * variation * HUE_SWING) % 1.0, light, s), rgba[3])


def color(text: str | None, default=(0.2, 0.6, 1.0, 1.0)) -> tuple:
    """#rrggbb or #rrggbbaa as shares; the default for anything else."""
    m = re.fullmatch(r"#?([0-9a-fA-F]{6})([0-9a-fA-F]{2})?", text or "")
    return tuple(int(x, 16) / 255 for x in re.findall("..", m[1] + (m[2] or "ff"))) if m else default


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def sphere_link(name: str, radius: float, rgba, extra: str | None = None) -> str:
    """A link with one sphere as visual and collision."""
    n, r, i = escape(name), f"{radius:.6f}", f"{LINK_INERTIA:.6f}"
    shape = ['      <origin xyz="0 0 0" rpy="0 0 0" />', "      <geometry>", f'        <sphere radius="{r}" />', "      </geometry>"]
    lines = [f'  <link name="{n}">', "    <inertial>", shape[0], f'      <mass value="{LINK_MASS:.6f}" />', f'      <inertia ixx="{i}" ixy="0" ixz="0" iyy="{i}" iyz="0" izz="{i}" />', "    </inertial>"]
    lines += ["    <visual>", *shape, f'      <material name="color_{n}">', f'        <color rgba="{" ".join(f"{x:.6f}" for x in rgba)}" />', "      </material>", "    </visual>"]
    lines += ["    <collision>", *shape, *([f"      {extra}"] if extra else []), "    </collision>", "  </link>", ""]
    return "\n".join(lines)


def fixed_joint(parent: str, child: str, xyz) -> str:
    p, c = escape(parent), escape(child)
    return "\n".join([f'  <joint name="{p}_to_{c}" type="fixed">', f'    <parent link="{p}" />', f'    <child link="{c}" />', f'    <origin xyz="{" ".join(f"{x:.6f}" for x in xyz)}" rpy="0 0 0" />', "  </joint>", ""])


DRAKE = "http://drake.mit.edu"


class _Spans:
    """Where collisions, their contact properties and the root's end stand in a text's bytes."""

    def __init__(self, data: bytes):
        self.data, self.path, self.found, self.root_end, self.inner = data, [], {}, len(data), {}
        self.link, self.counts = None, {}
        p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, self.parser = self.start, self.end, p
        p.Parse(data, True)

    def start(self, name, attrs):
        at = self.parser.CurrentByteIndex
        self.path.append((name, at))
        if name == "link":
            self.link = attrs.get("name")

    def end(self, name):
        _, start = self.path.pop()
        at = self.parser.CurrentByteIndex
        closing = self.data[at : at + 2] == b"</"
        stop = self.data.index(b">", at) + 1
        above = [n for n, _ in self.path]
        if name == "collision" and above[-1:] == ["link"]:
            k = self.counts.setdefault(self.link, 0)
            self.counts[self.link] += 1
            self.found[self.link, k] = (start, stop)
        elif name.rpartition(":")[2] == "proximity_properties" and above[-1:] == ["collision"]:
            self.inner[self.link, self.counts.get(self.link, 0)] = self.data[start:stop].decode()
        elif not self.path:
            self.root_end, self.self_closing = at, not closing


def _whole_line(data: bytes, start: int, stop: int) -> tuple[int, int]:
    """The span, or its line where nothing else stands on it."""
    a, b = data.rfind(b"\n", 0, start) + 1, data.find(b"\n", stop) + 1 or len(data)
    return (a, b) if not (data[a:start] + data[stop:b]).strip() else (start, stop)


def rewrite(text: str, report: Report, spheres: dict, rgba=(0.2, 0.6, 1.0, 1.0), variation: float = 0.0, continuous: bool = False) -> tuple[str, dict]:
    """(text, statistics): collisions replaced by sphere links with fixed joints before the root's end; the rest of the text stays.

    spheres: (link, index) -> (centers, radii).  Names count from 1 for each collision, or,
    if continuous, for each link.
    """
    stats = {"links_changed": 0, "meshes_replaced": 0, "primitives_removed": 0, "spheres_removed": 0, "spheres_added": 0, "skipped": []}
    data = text.encode()
    spans, cuts, links, joints, changed, made = _Spans(data), [], [], [], set(), {}
    names = list(dict.fromkeys(c.link for c in report.collisions if c.action == "pack"))
    shade = {n: hue_varied(rgba, 2 * k / (len(names) - 1) - 1 if len(names) > 1 else 0.0, variation if len(names) > 1 else 0.0) for k, n in enumerate(names)}
    order = list(dict.fromkeys(c.link for c in report.collisions if c.action != "error"))
    for c in sorted((c for c in report.collisions if c.action != "error"), key=lambda c: (order.index(c.link), -c.index)):
        span = spans.found.get((c.link, c.index))
        if c.action == "pack" and (span is None or (c.link, c.index) not in spheres):
            stats["skipped"].append((c.link, c.index, "not in the description" if span is None else "no spheres for it"))
            continue
        if span is None:
            continue
        cuts.append(_whole_line(data, *span))
        changed.add(c.link)
        stats[{"pack": "meshes_replaced", "remove-primitive": "primitives_removed"}.get(c.action, "spheres_removed")] += 1
        if c.action == "pack":
            extra = spans.inner.get((c.link, c.index))
            if extra and "xmlns:" not in extra and f'="{DRAKE}"' not in data[: data.find(b">", data.find(b"<robot"))].decode():
                prefix = extra[1:].split(":")[0]
                extra = re.sub(r"^(<[^\s/>]+)", rf'\1 xmlns:{prefix}="{DRAKE}"', extra)
            for k, (center, r) in enumerate(zip(*spheres[c.link, c.index], strict=True), 1):
                made[c.link] = made.get(c.link, 0) + 1
                child = f"{c.link}_sphere{made[c.link] if continuous else k}"
                links.append(sphere_link(child, r, shade[c.link], extra))
                joints.append(fixed_joint(c.link, child, placed(center, c.xyz, c.rpy)))
                stats["spheres_added"] += 1
    stats["links_changed"] = len(changed)
    out, at = b"", 0
    for a, b in sorted(cuts):
        out, at = out + data[at:a], b
    added = "".join(links + joints).encode()
    if spans.self_closing:
        end = data.index(b">", spans.root_end)
        slash = data.rindex(b"/", 0, end)
        out += data[at:slash] + b">\n" + added + b"</robot>" + data[end + 1 :]
    else:
        out += data[at : spans.root_end]
        out += (b"\n" if added and not out.endswith(b"\n") else b"") + added + data[spans.root_end :]
    head = "" if text.lstrip().startswith("<?xml") else "<?xml version='1.0' encoding='utf-8'?>\n"
    return head + out.decode(), stats


def object_inputs(centers, radii, total_mass: float, min_radius: float = 1e-6):
    """(centers about their mean, radii, masses by volume, mean); short radii repeat the last, long ones are cut."""
    if not len(centers) or not len(radii):
        raise ValueError("centers and radii must not be empty")
    radii = [max(min_radius, float(r)) for r in ([*radii] + [radii[-1]] * len(centers))[: len(centers)]]
    mean = tuple(sum(p[k] for p in centers) / len(centers) for k in range(3))
    cubes = [r**3.0 for r in radii]
    whole = sum(cubes)
    return [tuple(p[k] - mean[k] for k in range(3)) for p in centers], radii, [total_mass * v / whole for v in cubes], mean


@dataclass
class ObjectOptions:
    name: str = "object"
    total_mass: float = 1.0
    rgba: tuple = (0.2, 0.6, 1.0, 1.0)
    base_mass: float = 0.001
    base_inertia: float = 1e-6
    decimals: int = 6
    anchored: bool = False
    min_radius: float = 1e-6
    mark: str = CENTROID_MARK


def object_urdf(centers, radii, o: ObjectOptions = ObjectOptions()) -> str:
    """A base link with a fixed link for each sphere; anchored to the world if asked; the mean of the centers in a comment."""
    rel, radii, masses, mean = object_inputs(centers, radii, o.total_mass, o.min_radius)
    num = lambda v: f"{v:.{o.decimals}f}"
    nums = lambda v: " ".join(map(num, v))
    inertia = lambda i, pad: f'{pad}<inertia ixx="{i}" ixy="0.0" ixz="0.0" iyy="{i}" iyz="0.0" izz="{i}"/>'
    joint = lambda name, a, b, at: [f'  <joint name="{name}" type="fixed">', f'    <parent link="{a}"/>', f'    <child link="{b}"/>', f'    <origin xyz="{nums(at)}" rpy="0 0 0"/>', "  </joint>"]
    x = ['<?xml version="1.0"?>', f'<robot name="{o.name}">', f"  <!-- {o.mark} {mean[0]:.6f} {mean[1]:.6f} {mean[2]:.6f} -->", '  <material name="default_color">', f'    <color rgba="{nums(o.rgba)}"/>', "  </material>"]
    x += ['  <link name="world"/>'] * o.anchored
    x += ['  <link name="base">', "    <inertial>", f'      <mass value="{num(o.base_mass)}"/>', inertia(num(o.base_inertia), "      "), "    </inertial>", "  </link>"]
    x += joint("world_to_base", "world", "base", mean) if o.anchored else []
    for k, (c, r, m) in enumerate(zip(rel, radii, masses, strict=True)):
        ball = ['      <origin xyz="0 0 0" rpy="0 0 0"/>', f'      <geometry><sphere radius="{num(r)}"/></geometry>']
        x += [f'  <link name="sphere_{k}">', "    <visual>", *ball, '      <material name="default_color"/>', "    </visual>", "    <collision>", *ball, "    </collision>"]
        x += ["    <inertial>", f'      <mass value="{num(m)}"/>', inertia(num(2.0 / 5.0 * m * r**2.0), "      "), "    </inertial>", "  </link>"]
        x += joint(f"sphere_{k}_fixed", "base", f"sphere_{k}", c)
    return "\n".join([*x, "</robot>", ""])


def object_mjcf(centers, radii, o: ObjectOptions = ObjectOptions()) -> str:
    rel, radii, masses, mean = object_inputs(centers, radii, o.total_mass, o.min_radius)
    num = lambda v: f"{v:.{o.decimals}f}"
    nums = lambda v: " ".join(map(num, v))
    x = ['<?xml version="1.0"?>', f'<mujoco model="{o.name}">', '  <option gravity="0 0 -9.8"/>', '  <compiler inertiafromgeom="true"/>', "  <worldbody>", f'    <body name="base" pos="{nums(mean)}">']
    x += ['      <freejoint name="base_free"/>'] * (not o.anchored)
    for k, (c, r, m) in enumerate(zip(rel, radii, masses, strict=True)):
        density = m / (4 / 3 * np.pi * r**3.0)
        x += [f'      <body name="sphere_{k}" pos="{nums(c)}">', f'        <geom name="sphere_{k}_geom" type="sphere" size="{num(r)}" density="{num(density)}" rgba="{nums(o.rgba)}"/>', "      </body>"]
    return "\n".join([*x, "    </body>", "  </worldbody>", "</mujoco>", ""])


_CENTROID = re.compile(r"<!--\s*\w+:centroid((?:\s+-?\d+(?:\.\d+)?){3})\s*-->")


def object_spheres(urdf: str) -> tuple[list, list]:
    """(centers, radii) of an object's URDF, the centers moved back by the mean that its comment holds."""
    found = _CENTROID.search(urdf)
    if not found:
        raise ValueError("no centroid comment in the URDF")
    mean, root = triple(found[1]), ET.fromstring(urdf)
    at = {j.find("child").get("link"): triple(j.find("origin").get("xyz")) for j in root.findall("joint") if j.find("origin") is not None}
    out = [(tuple(p + m for p, m in zip(at[x.get("name")], mean, strict=True)), float(x.find("collision/geometry/sphere").get("radius"))) for x in root.findall("link") if x.find("collision/geometry/sphere") is not None and x.get("name") in at]
    return [c for c, _ in out], [r for _, r in out]


COLLISIONS = "package_id string, urdf string, link_name string, collision_index int, geometry_type string, action string, mesh_path string, mesh_filename string, mesh_scale array<double>, origin_xyz array<double>, origin_rpy array<double>, warning string"


def inspect_packages(texts: DataFrame) -> DataFrame:
    """The collisions of descriptions (package_id, urdf, content, and paths: the package's files), a row each; a description's errors are rows of geometry_type file."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                known, folder = set(r.paths), r.urdf.rpartition("/")[0]
                report = inspect(bytes(r.content).decode("utf-8", "replace"), lambda f: _resolve(f, known, folder))  # noqa: B023
                rows += [(r.package_id, r.urdf, None, None, "file", "error", None, None, None, None, None, e) for e in report.errors]
                rows += [(r.package_id, r.urdf, c.link, c.index, c.kind, c.action, c.path, c.filename, list(c.scale), list(c.xyz), list(c.rpy), c.warning) for c in report.collisions]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COLLISIONS.split(", ")]).astype({"collision_index": "Int32"})

    return texts.select("package_id", "urdf", "content", "paths").mapInPandas(run, COLLISIONS)


def _joined(folder: str, rel: str) -> str | None:
    out: list = []
    for part in f"{folder}/{rel}".replace("\\", "/").split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _resolve(filename: str, known: set, folder: str) -> str | None:
    if filename.startswith("file://"):
        return filename[7:]
    if filename.startswith("package://"):
        name, slash, rel = filename[10:].partition("/")
        tries = [_joined(name, rel), _joined("", rel)] if slash else []
        same = [k for k in known if slash and k.rpartition("/")[2] == rel.rpartition("/")[2]]
        return next((t for t in tries if t in known), same[0] if len(same) == 1 else None)
    key = _joined("" if filename.startswith("/") else folder, filename)
    return key if key in known else None


def rewrite_packages(jobs: DataFrame, rgba=(0.2, 0.6, 1.0, 1.0), variation: float = 0.0) -> DataFrame:
    """package_id, content, spheres_added, skipped of jobs: package_id, urdf, content, paths and spheres, an array of (link, index, centers, radii)."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                text, known, folder = bytes(r.content).decode("utf-8", "replace"), set(r.paths), r.urdf.rpartition("/")[0]
                report = inspect(text, lambda f: _resolve(f, known, folder))  # noqa: B023
                sets = {(s["link"], s["index"]): (s["centers"], s["radii"]) for s in r.spheres}
                out, stats = rewrite(text, report, sets, rgba, variation)
                rows.append((r.package_id, out, stats["spheres_added"], len(stats["skipped"])))
            yield pd.DataFrame(rows, columns=["package_id", "content", "spheres_added", "skipped"])

    return jobs.mapInPandas(run, "package_id string, content string, spheres_added int, skipped int")
