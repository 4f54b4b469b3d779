"""Mesh files: OBJ, STL, PLY and COLLADA read, OBJ and STL written."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np

EXTENSIONS = ("obj", "stl", "ply", "dae")
Soup = tuple[np.ndarray, np.ndarray]


class MeshError(ValueError):
    """A file that is no mesh of its format."""


class UnknownFormat(MeshError):
    pass


def parse(data: bytes, extension: str) -> Soup:
    """(vertices, faces) of a file's bytes; the extension's case and dot don't matter."""
    kind = extension.lower().lstrip(".")
    readers = {"obj": read_obj, "stl": read_stl, "ply": read_ply, "dae": read_dae}
    if kind not in readers:
        raise UnknownFormat(f"unsupported mesh format {extension!r}; supported are {', '.join(EXTENSIONS)}")
    try:
        return readers[kind](data)
    except (ValueError, KeyError, IndexError, ET.ParseError, UnicodeDecodeError) as e:
        raise e if isinstance(e, MeshError) else MeshError(f"not a {kind} mesh: {e}") from e


def fans(polygons) -> np.ndarray:
    """Triangles of polygons, each a fan around its first corner; fewer than three corners give none."""
    out = [(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)]
    return np.array(out, np.int64).reshape(-1, 3)


def read_obj(data: bytes) -> Soup:
    vertices, polygons = [], []
    for line in data.decode("utf-8", "replace").replace("\\\n", " ").splitlines():
        word, *rest = line.split("#")[0].split() or [""]
        if word == "v":
            vertices.append([float(x) for x in rest[:3]])
        elif word == "f":
            refs = [int(x.split("/")[0]) for x in rest]
            polygons.append([r - 1 if r > 0 else len(vertices) + r for r in refs])
    return np.array(vertices, float).reshape(-1, 3), fans(polygons)


def read_stl(data: bytes) -> Soup:
    """Corners that are equal become one vertex, in the order of their first use."""
    count = int.from_bytes(data[80:84], "little") if len(data) >= 84 else -1
    if len(data) == 84 + 50 * count:
        record = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
        corners = np.frombuffer(data, record, count, 84)["corners"].reshape(-1, 3)
    elif data.lstrip()[:5].lower() == b"solid":
        lines = (x.split() for x in data.decode("utf-8", "replace").splitlines())
        corners = np.array([[float(v) for v in x[1:4]] for x in lines if x and x[0] == "vertex"], np.float32)
    else:
        raise MeshError("neither a binary nor a text STL")
    if len(corners) % 3:
        raise MeshError("a facet without three corners")
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault((c + np.float32(0)).tobytes(), len(seen)) for c in corners]
    vertices = np.array([np.frombuffer(k, np.float32) for k in seen], float).reshape(-1, 3)
    return vertices, np.array(ids, np.int64).reshape(-1, 3)


#: PLY's scalar types by either name.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def ply_header(data: bytes) -> tuple[str, list, int]:
    """(format, elements, offset of the body); an element is [name, count, [(name, type, type of the count or None)]]."""
    end = data.find(b"end_header")
    if data[:3] != b"ply" or end < 0:
        raise MeshError("no PLY header")
    body, kind, elements = data.index(b"\n", end) + 1, "", []
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        word, *rest = line.split() or [""]
        if word == "format":
            kind = rest[0]
        elif word == "element":
            elements.append([rest[0], int(rest[1]), []])
        elif word == "property":
            listed = rest[0] == "list"
            elements[-1][2].append((rest[-1], PLY_TYPES[rest[2 if listed else 0]], PLY_TYPES[rest[1]] if listed else None))
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise MeshError(f"unknown PLY format {kind!r}")
    return kind, elements, body


def read_ply(data: bytes) -> Soup:
    kind, elements, at = ply_header(data)
    order = ">" if kind == "binary_big_endian" else "<"
    words = iter(data[at:].split()) if kind == "ascii" else None

    def take(code: str, n: int) -> list:
        nonlocal at
        if words is not None:
            return [float(next(words)) if code[0] == "f" else int(float(next(words))) for _ in range(n)]
        out = np.frombuffer(data, order + code, n, at)
        at += out.nbytes
        return out.tolist()

    vertices, polygons = None, []
    for name, count, props in elements:
        flat = not any(p[2] for p in props)
        if flat and words is None:
            rows = np.frombuffer(data, np.dtype([(p[0], order + p[1]) for p in props]), count, at)
            at += rows.nbytes
            if name == "vertex":
                vertices = np.stack([rows[x].astype(float) for x in "xyz"], axis=1)
            continue
        kept = []
        for _ in range(count):
            row = {p: take(code, take(size, 1)[0] if size else 1) for p, code, size in props}
            if name == "vertex":
                kept.append([row[x][0] for x in "xyz"])
            elif name == "face":
                polygons.append(row.get("vertex_indices") or row.get("vertex_index") or [])
        if name == "vertex":
            vertices = np.array(kept, float)
    if vertices is None:
        raise MeshError("a PLY file without vertices")
    return vertices.reshape(-1, 3), fans(polygons)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class _Collada:
    """Geometry of a COLLADA file, placed by its scene."""

    DEEPEST = 64

    def __init__(self, root):
        self.root, self.cached = root, {}
        self.by_id = {x.get("id"): x for x in root.iter() if x.get("id")}
        self.vertices, self.polygons, self.n = [], [], 0

    def find(self, url: str | None):
        return self.by_id.get((url or "").rpartition("#")[2])

    @staticmethod
    def children(x, *names):
        return [c for c in x if _local(c.tag) in names]

    def matrix(self, node) -> np.ndarray:
        out = np.eye(4)
        for c in node:
            v = [float(x) for x in (c.text or "").split()]
            m = np.eye(4)
            match _local(c.tag):
                case "matrix":
                    m = np.array(v).reshape(4, 4)
                case "translate":
                    m[:3, 3] = v[:3]
                case "scale":
                    m[:3, :3] = np.diag(v[:3])
                case "rotate":
                    axis = np.array(v[:3]) / (np.linalg.norm(v[:3]) or 1.0)
                    a = math.radians(v[3])
                    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
                    m[:3, :3] = np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k
                case _:
                    continue
            out = out @ m
        return out

    def positions(self, mesh, url) -> np.ndarray:
        source = self.find(url)
        if source is not None and _local(source.tag) == "vertices":
            source = self.find(next(i.get("source") for i in self.children(source, "input") if i.get("semantic") == "POSITION"))
        key = source.get("id")
        if key not in self.cached:
            numbers = np.array((next(iter(self.children(source, "float_array"))).text or "").split(), float)
            accessor = next(x for x in source.iter() if _local(x.tag) == "accessor")
            count, stride, offset = (int(accessor.get(k, d)) for k, d in (("count", 0), ("stride", 1), ("offset", 0)))
            self.cached[key] = np.array([numbers[offset + k * stride : offset + k * stride + 3] for k in range(count)], float).reshape(-1, 3)
        return self.cached[key]

    def geometry(self, geometry, matrix) -> None:
        for mesh in self.children(geometry, "mesh"):
            for part in self.children(mesh, "triangles", "polylist", "polygons"):
                inputs = self.children(part, "input")
                vertex = next(i for i in inputs if i.get("semantic") == "VERTEX")
                stride, offset = 1 + max(int(i.get("offset", 0)) for i in inputs), int(vertex.get("offset", 0))
                p = self.positions(mesh, vertex.get("source"))
                lists = [[int(x) for x in (q.text or "").split()][offset::stride] for q in self.children(part, "p")]
                if _local(part.tag) == "triangles":
                    polygons = [x[k : k + 3] for x in lists for k in range(0, len(x) - 2, 3)]
                elif _local(part.tag) == "polylist":
                    sizes = [int(x) for x in (next(iter(self.children(part, "vcount"))).text or "").split()]
                    flat, ends = [i for x in lists for i in x], np.cumsum([0, *sizes])
                    polygons = [flat[a:b] for a, b in zip(ends, ends[1:])]
                else:
                    polygons = lists
                self.vertices.append(p @ matrix[:3, :3].T + matrix[:3, 3])
                self.polygons += [[i + self.n for i in q] for q in polygons]
                self.n += len(p)

    def node(self, node, above, depth: int = 0) -> None:
        if depth > self.DEEPEST:
            raise MeshError("nodes are nested too deep")
        here = above @ self.matrix(node)
        for c in node:
            kind = _local(c.tag)
            if kind == "instance_geometry" and (g := self.find(c.get("url"))) is not None:
                self.geometry(g, here)
            elif kind == "node":
                self.node(c, here, depth + 1)
            elif kind == "instance_node" and (other := self.find(c.get("url"))) is not None:
                self.node(other, here, depth + 1)


def read_dae(data: bytes) -> Soup:
    """Units are left as they are; a file without a scene that places geometry has it unplaced."""
    root = ET.fromstring(data)
    c = _Collada(root)
    chosen = next((x for x in root.iter() if _local(x.tag) == "instance_visual_scene"), None)
    scene = c.find(chosen.get("url")) if chosen is not None else next((x for x in root.iter() if _local(x.tag) == "visual_scene"), None)
    for node in c.children(scene, "node") if scene is not None else []:
        c.node(node, np.eye(4))
    if not c.polygons:
        for g in (x for x in root.iter() if _local(x.tag) == "geometry"):
            c.geometry(g, np.eye(4))
    if not c.polygons:
        raise MeshError("a COLLADA file without polygons")
    return np.vstack(c.vertices), fans(c.polygons)


def write_obj(vertices, faces) -> str:
    """Shortest decimals that read back as the same numbers; faces count from 1."""
    number = lambda x: repr(float(x)).removesuffix(".0")
    lines = [f"v {' '.join(map(number, v))}" for v in vertices] + [f"f {a + 1} {b + 1} {c + 1}" for a, b, c in faces]
    return "\n".join(lines) + "\n"


def write_stl(vertices, faces) -> bytes:
    """Binary, in single precision, with unit normals."""
    p = np.asarray(vertices, float)[np.asarray(faces, int)]
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    length = np.linalg.norm(n, axis=1, keepdims=True)
    rows = np.zeros(len(p), np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")]))
    rows["normal"], rows["corners"] = np.divide(n, length, out=np.zeros_like(n), where=length > 0), p
    return bytes(80) + len(p).to_bytes(4, "little") + rows.tobytes()


def encode(vertices, faces, extension: str) -> bytes:
    kind = extension.lower().lstrip(".")
    if kind == "obj":
        return write_obj(vertices, faces).encode()
    if kind == "stl":
        return write_stl(vertices, faces)
    raise UnknownFormat(f"meshes are written as obj or stl, not {extension!r}")


def rows_of(mesh_id: str, soup: Soup) -> Iterator[tuple]:
    """Rows of kind vertex (x, y, z) and face (a, b, c)."""
    vertices, faces = soup
    yield from ((mesh_id, "vertex", k, *map(float, v), None, None, None) for k, v in enumerate(vertices))
    yield from ((mesh_id, "face", k, None, None, None, *map(int, f)) for k, f in enumerate(faces))
