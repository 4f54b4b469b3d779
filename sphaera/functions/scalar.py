"""Scalar functions as column expressions; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUR_THIRDS_PI = 4.0 / 3.0 * math.pi


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softplus(x) -> Column:
    """ln(1 + e^x); x itself above 20."""
    return F.when(col(x) > 20, col(x)).otherwise(F.log1p(F.exp(F.least(col(x), F.lit(20.0)))))


def softplus_grad(x) -> Column:
    e = F.exp(F.least(col(x), F.lit(20.0)))
    return F.when(col(x) > 20, 1.0).otherwise(e / (e + 1))


def inv_softplus(y) -> Column:
    return col(y) + F.log(-F.expm1(-col(y)))


def relu(x) -> Column:
    """The positive part; 0 for NaN, unlike greatest."""
    return F.when(F.isnan(col(x)), 0.0).otherwise(F.greatest(col(x), F.lit(0.0)))


def dist(a: tuple, b: tuple) -> Column:
    """Euclidean distance of two triples of columns."""
    d = [col(x) - col(y) for x, y in zip(a, b, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def dot(a: tuple, b: tuple) -> Column:
    p = [col(x) * col(y) for x, y in zip(a, b, strict=True)]
    return p[0] + p[1] + p[2]


def minus(a: tuple, b: tuple) -> tuple:
    return tuple(col(x) - col(y) for x, y in zip(a, b, strict=True))


def cross(a: tuple, b: tuple) -> tuple:
    (ax, ay, az), (bx, by, bz) = map(lambda v: tuple(map(col, v)), (a, b))
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def frobenius_sq(entries) -> Column:
    return sum((col(x) * col(x) for x in entries), F.lit(0.0))


def ball_volume(r) -> Column:
    return F.lit(FOUR_THIRDS_PI) * col(r) * col(r) * col(r)


def rpy_rows(r, p, y) -> list[tuple]:
    """The rows of Rz(yaw) Ry(pitch) Rx(roll)."""
    (sr, cr), (sp, cp), (sy, cy) = ((F.sin(col(a)), F.cos(col(a))) for a in (r, p, y))
    return [
        (cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr),
        (sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr),
        (-sp, cp * sr, cp * cr),
    ]


def transformed(point: tuple, xyz: tuple, rpy: tuple) -> tuple:
    """A point after a rotation by rpy and a shift by xyz."""
    return tuple(dot(row, point) + col(t) for row, t in zip(rpy_rows(*rpy), xyz, strict=True))


def hex_rgba(text) -> Column:
    """#rrggbb or #rrggbbaa -> array of four shares; null for any other text."""
    t = F.regexp_extract(col(text), "^#?([0-9a-fA-F]{6}(?:[0-9a-fA-F]{2})?)$", 1)
    full = F.concat(t, F.when(F.length(t) == 6, "ff").otherwise(""))
    part = lambda k: F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("double") / 255
    return F.when(F.length(t) >= 6, F.array(*(part(k) for k in range(4))))


def rgb_to_hls(r, g, b) -> tuple:
    """Hue in [0, 1), lightness, saturation."""
    r, g, b = map(col, (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span, total = high - low, high + low
    light = total / 2
    sat = F.when(span == 0, 0.0).when(light <= 0.5, span / F.nullif(total, F.lit(0.0))).otherwise(span / F.nullif(2 - total, F.lit(0.0)))
    step = F.nullif(span, F.lit(0.0))
    rc, gc, bc = ((high - x) / step for x in (r, g, b))
    hue = F.when(span == 0, 0.0).otherwise(F.pmod(F.when(r == high, bc - gc).when(g == high, 2 + rc - bc).otherwise(4 + gc - rc) / 6, F.lit(1.0)))
    return hue, light, sat


def hls_to_rgb(h, light, s) -> tuple:
    h, light, s = map(col, (h, light, s))
    m2 = F.when(light <= 0.5, light * (1 + s)).otherwise(light + s - light * s)
    m1 = 2 * light - m2

    def channel(shift: float) -> Column:
        k = F.pmod(h + F.lit(shift), F.lit(1.0))
        ramp = F.when(k < 1 / 6, m1 + (m2 - m1) * k * 6).when(k < 0.5, m2).when(k < 2 / 3, m1 + (m2 - m1) * (2 / 3 - k) * 6).otherwise(m1)
        return F.when(s == 0, light).otherwise(ramp)

    return channel(1 / 3), channel(0.0), channel(-1 / 3)


def escape_xml(text) -> Column:
    """The four characters that attribute values can't hold, as entities."""
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def round_sig5(v) -> Column:
    """Five significant digits, by the number's exact value, halves to even."""
    return F.call_function("format_number", col(v), F.lit("0.0000E0")).cast("double")


def floats(text, n: int | None = None) -> Column:
    """White-space separated numbers as an array; null where one isn't a number or, given n, their count differs."""
    parts = F.filter(F.split(col(text), r"\s+"), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    ok = ~F.exists(values, lambda x: x.isNull())
    return F.when(ok if n is None else ok & (F.size(values) == n), values)


def parse_scale(text) -> Column:
    """One or three numbers as three; ones for anything else."""
    v = floats(text)
    one = F.when(F.size(v) == 1, F.array_repeat(F.get(v, F.lit(0)), 3)).when(F.size(v) == 3, v)
    return F.coalesce(one, F.array(*(F.lit(1.0),) * 3))


def looks_like_xacro(text) -> Column:
    """Unresolved macros: a closed substitution that isn't empty, or an element of the xacro namespace."""
    return F.coalesce(col(text).rlike(r"\$\{[^}]+\}|<xacro:"), F.lit(False))


def json_flag(json, path: str, default: bool) -> Column:
    """A boolean of a JSON text, or the default where it is absent."""
    return F.coalesce(F.get_json_object(col(json), path).try_cast("boolean"), F.lit(default))


def normalize_path(path) -> Column:
    """A relative path without . and empty parts; null where .. would leave the root or the path is absolute."""
    parts = F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/")
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc, x):
        return F.when((x == "") | (x == "."), acc).when(x == "..", F.struct(F.slice(acc["p"], 1, F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["ok"] & (F.size(acc["p"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(acc["p"], F.array(x)).alias("p"), acc["ok"].alias("ok")))

    folded = F.aggregate(parts, start, step)
    fine = ~col(path).startswith("/") & folded["ok"] & ~col(path).rlike("^[A-Za-z]:")
    return F.when(fine, F.array_join(folded["p"], "/"))


def join_path(folder, rel) -> Column:
    return normalize_path(F.when((col(folder) == "") | col(folder).isNull(), col(rel)).otherwise(F.concat_ws("/", col(folder), col(rel))))
