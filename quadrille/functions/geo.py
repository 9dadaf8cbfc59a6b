"""GeoSPARQL functions over WKT and GeoJSON literals, in Arrow batches.

Geometries are points, lines and polygons, and collections of them, in the plane. Relations come from the DE-9IM matrix,
computed by cutting the segments of each geometry at the other and locating what lies between the cuts. Distances between
positions in degrees are great-circle metres, unless the unit is the degree. An argument that is no geometry gives an error.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from . import terms as t

#: Names and patterns of the standards.
GEO, GEOF, UOM = "http://www.opengis.net/ont/geosparql#", "http://www.opengis.net/def/function/geosparql/", "http://www.opengis.net/def/uom/OGC/1.0/"
WKT, GEOJSON, CRS84 = GEO + "wktLiteral", GEO + "geoJSONLiteral", "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
RELATIONS = {
    "sfEquals": ("T*F**FFF*",), "sfDisjoint": ("FF*FF****",), "sfIntersects": ("T********", "*T*******", "***T*****", "****T****"),
    "sfTouches": ("FT*******", "F**T*****", "F***T****"), "sfWithin": ("T*F**F***",), "sfContains": ("T*****FF*",),
    "ehEquals": ("TFFFTFFFT",), "ehDisjoint": ("FF*FF****",), "ehMeet": ("FT*******", "F**T*****", "F***T****"), "ehOverlap": ("T*T***T**",),
    "ehCovers": ("T*TFT*FF*",), "ehCoveredBy": ("TFF*TFT**",), "ehInside": ("TFF*FFT**",), "ehContains": ("T*TFF*FF*",),
    "rcc8eq": ("TFFFTFFFT",), "rcc8dc": ("FFTFFTTTT",), "rcc8ec": ("FFTFTTTTT",), "rcc8po": ("TTTTTTTTT",),
    "rcc8tppi": ("TTTFTTFFT",), "rcc8tpp": ("TFFTTFTTT",), "rcc8ntpp": ("TFFTFFTTT",), "rcc8ntppi": ("TTTFFTFFT",),
}
EARTH = 6371008.8
EPS = 1e-9

Point = tuple[float, float]


@dataclass
class Geometry:
    kind: str
    points: list[Point] = field(default_factory=list)
    lines: list[list[Point]] = field(default_factory=list)
    polygons: list[list[list[Point]]] = field(default_factory=list)
    crs: str = CRS84

    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0

    def vertices(self) -> list[Point]:
        return [*self.points, *(p for x in self.lines for p in x), *(p for poly in self.polygons for ring in poly for p in ring)]

    def add(self, other: Geometry) -> None:
        self.points += other.points
        self.lines += other.lines
        self.polygons += other.polygons


# -- reading and writing

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def _wkt(text: str) -> Geometry:
    m = re.match(r"\s*<([^>]*)>", text)
    crs, text = (m[1], text[m.end() :]) if m else (CRS84, text)
    toks: list[str] = []
    at = 0
    while at < len(text.rstrip()):
        if not (m := _TOKEN.match(text, at)):
            raise ValueError("no WKT")
        toks.append(m[1])
        at = m.end()
    toks.reverse()

    def need(x: str) -> None:
        if not toks or toks.pop() != x:
            raise ValueError(f"{x} expected")

    def many(one) -> list:
        if toks and toks[-1].upper() == "EMPTY":
            toks.pop()
            return []
        need("(")
        out = [one()]
        while toks and toks[-1] == ",":
            toks.pop()
            out.append(one())
        need(")")
        return out

    def point() -> Point:
        found = []
        while toks and toks[-1] not in "(),":
            found.append(float(toks.pop()))
        return (found[0], found[1])

    def maybe_bracketed() -> Point:
        if toks and toks[-1] == "(":
            return many(point)[0]
        return point()

    def shape() -> Geometry:
        kind = toks.pop().upper()
        if toks and toks[-1].upper() in ("Z", "M", "ZM"):
            toks.pop()
        g = Geometry(kind, crs=crs)
        if kind == "POINT":
            g.points = many(point)
        elif kind == "MULTIPOINT":
            g.points = many(maybe_bracketed)
        elif kind == "LINESTRING":
            g.lines = [x for x in [many(point)] if x]
        elif kind == "MULTILINESTRING":
            g.lines = many(lambda: many(point))
        elif kind == "POLYGON":
            g.polygons = [x for x in [many(lambda: many(point))] if x]
        elif kind == "MULTIPOLYGON":
            g.polygons = many(lambda: many(lambda: many(point)))
        elif kind == "GEOMETRYCOLLECTION":
            for part in many(shape):
                g.add(part)
        else:
            raise ValueError(f"unknown shape {kind}")
        return g

    out = shape()
    if toks:
        raise ValueError("text after the shape")
    return out


def _geojson(text: str) -> Geometry:
    def shape(x: dict) -> Geometry:
        kind, c = x["type"].upper(), x.get("coordinates")
        p = lambda q: (float(q[0]), float(q[1]))
        ring = lambda r: [p(q) for q in r]
        g = Geometry(kind)
        match kind:
            case "POINT":
                g.points = [p(c)] if c else []
            case "MULTIPOINT":
                g.points = ring(c)
            case "LINESTRING":
                g.lines = [ring(c)]
            case "MULTILINESTRING":
                g.lines = [ring(r) for r in c]
            case "POLYGON":
                g.polygons = [[ring(r) for r in c]]
            case "MULTIPOLYGON":
                g.polygons = [[ring(r) for r in y] for y in c]
            case "GEOMETRYCOLLECTION":
                for part in x["geometries"]:
                    g.add(shape(part))
            case _:
                raise ValueError(kind)
        return g

    return shape(json.loads(text))


def parse(lex: str | None, dt: str | None) -> Geometry | None:
    try:
        return None if lex is None else _geojson(lex) if dt == GEOJSON else _wkt(lex) if dt == WKT else None
    except (ValueError, KeyError, IndexError, TypeError):
        return None


def _n(x: float) -> str:
    return repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def to_wkt(g: Geometry) -> str:
    p = lambda q: f"{_n(q[0])} {_n(q[1])}"
    ring = lambda r: "(" + ", ".join(map(p, r)) + ")"
    poly = lambda y: "(" + ", ".join(map(ring, y)) + ")"
    kinds = [(g.points, "POINT", lambda x: f"({p(x)})"), (g.lines, "LINESTRING", ring), (g.polygons, "POLYGON", poly)]
    shown = [(name, [show(x) for x in items]) for items, name, show in kinds if items]
    head = "" if g.crs == CRS84 else f"<{g.crs}> "
    if not shown:
        return f"{head}{g.kind} EMPTY"
    if len(shown) > 1:
        return f"{head}GEOMETRYCOLLECTION (" + ", ".join(f"{n} {x}" for n, xs in shown for x in xs) + ")"
    name, items = shown[0]
    return f"{head}{name} {items[0]}" if len(items) == 1 and not g.kind.startswith("MULTI") else f"{head}MULTI{name} (" + ", ".join(items) + ")"


def to_geojson(g: Geometry) -> str:
    parts = [{"type": n, "coordinates": x} for n, xs in (("Point", g.points), ("LineString", g.lines), ("Polygon", g.polygons)) for x in xs]
    return json.dumps(parts[0] if len(parts) == 1 else {"type": "GeometryCollection", "geometries": parts})


# -- relations


def _near(a: Point, b: Point) -> bool:
    return abs(a[0] - b[0]) <= EPS and abs(a[1] - b[1]) <= EPS


def _segments(g: Geometry) -> list[tuple[Point, Point]]:
    paths = [*g.lines, *(ring if _near(ring[0], ring[-1]) else [*ring, ring[0]] for y in g.polygons for ring in y)]
    return [(a, b) for x in paths for a, b in zip(x, x[1:], strict=False) if not _near(a, b)]


def _on(p: Point, a: Point, b: Point) -> bool:
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = math.hypot(dx, dy)
    if size <= EPS:
        return _near(p, a)
    along = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size
    return abs((p[0] - a[0]) * dy - (p[1] - a[1]) * dx) / size <= EPS and -EPS <= along <= size + EPS


def _in_ring(p: Point, ring: list[Point]) -> str:
    inside = False
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        if _on(p, a, b):
            return "B"
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return "I" if inside else "E"


def locate(p: Point, g: Geometry) -> str:
    """I, B or E: the interior, the boundary or the exterior."""
    found = "E"
    for poly in g.polygons:
        at = _in_ring(p, poly[0])
        for hole in poly[1:]:
            if at == "I" and (inner := _in_ring(p, hole)) != "E":
                at = "B" if inner == "B" else "E"
        if at == "I":
            return "I"
        found = at if at == "B" else found
    ends = 0
    for line in g.lines:
        closed = _near(line[0], line[-1])
        at_end = 0 if closed else _near(p, line[0]) + _near(p, line[-1])
        if not at_end and any(_on(p, a, b) for a, b in zip(line, line[1:], strict=False)):
            return "I"
        ends += at_end
    if ends:
        return "B" if ends % 2 else "I"
    return "I" if any(_near(p, q) for q in g.points) else found


def _cuts(a: Point, b: Point, others: list[tuple[Point, Point]], points: list[Point]) -> list[float]:
    dx, dy = b[0] - a[0], b[1] - a[1]
    out = [0.0, 1.0]
    for c, d in others:
        ex, ey = d[0] - c[0], d[1] - c[1]
        cross = dx * ey - dy * ex
        if abs(cross) > EPS * EPS:
            u = ((c[0] - a[0]) * ey - (c[1] - a[1]) * ex) / cross
            v = ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / cross
            if -EPS <= u <= 1 + EPS and -EPS <= v <= 1 + EPS:
                out.append(min(1.0, max(0.0, u)))
    for p in [*points, *(q for s in others for q in s)]:
        if _on(p, a, b):
            out.append(min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))))
    return sorted(set(out))


def relate(a: Geometry, b: Geometry) -> str:
    """The DE-9IM matrix by rows: interior, boundary and exterior of a against those of b."""
    m = {(x, y): -1 for x in "IBE" for y in "IBE"}
    m["E", "E"] = 2

    def see(p: Point, dim: int) -> None:
        k = (locate(p, a), locate(p, b))
        m[k] = max(m[k], dim)

    for g, other in ((a, b), (b, a)):
        rest = [*_segments(other), *_segments(g)]
        for p in g.vertices():
            see(p, 0)
        area = bool(g.polygons)
        for s, e in _segments(g):
            cuts = _cuts(s, e, rest, [*other.points, *g.points])
            at = lambda u, s=s, e=e: (s[0] + u * (e[0] - s[0]), s[1] + u * (e[1] - s[1]))
            for u in cuts:
                see(at(u), 0)
            for u, v in zip(cuts, cuts[1:], strict=False):
                mid, size = at((u + v) / 2), math.hypot(e[0] - s[0], e[1] - s[1])
                if (v - u) * size <= 4 * EPS:
                    continue
                see(mid, 1)
                if area:
                    # The faces on both sides of a border.
                    step = min(1e-6, (v - u) * size / 4)
                    nx, ny = -(e[1] - s[1]) / size * step, (e[0] - s[0]) / size * step
                    for p in ((mid[0] + nx, mid[1] + ny), (mid[0] - nx, mid[1] - ny)):
                        k = (locate(p, a), locate(p, b))
                        if "B" not in k and all(z == "E" or h.polygons for z, h in zip(k, (a, b), strict=True)):
                            m[k] = max(m[k], 2)
    return "".join("F" if m[x, y] < 0 else str(m[x, y]) for x in "IBE" for y in "IBE")


def fits(matrix: str, pattern: str) -> bool:
    return all(w == "*" or (w == "T" and h != "F") or w == h for h, w in zip(matrix, pattern, strict=True))


def related(name: str, a: Geometry, b: Geometry) -> bool:
    matrix, x, y = relate(a, b), a.dimension(), b.dimension()
    if name == "sfCrosses":
        return fits(matrix, "T*T******" if x < y else "T*****T**" if x > y else "0********") and (x != y or x == 1)
    if name == "sfOverlaps":
        return x == y and fits(matrix, "1*T***T**" if x == 1 else "T*T***T**")
    return any(fits(matrix, p) for p in RELATIONS[name])


# -- measures


def _metres(a: Point, b: Point) -> float:
    (x, y), (u, v) = ((math.radians(c) for c in p) for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * EARTH * math.asin(min(1.0, math.sqrt(h)))


def _foot(p: Point, a: Point, b: Point) -> Point:
    dx, dy = b[0] - a[0], b[1] - a[1]
    u = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return (a[0] + u * dx, a[1] + u * dy)


def distance(a: Geometry, b: Geometry, unit: str | None) -> float | None:
    if not a.vertices() or not b.vertices():
        return None
    if not fits(relate(a, b), "FF*FF****"):
        return 0.0
    pairs = [(p, q) for p in a.vertices() for q in b.vertices()]
    pairs += [(p, _foot(p, *s)) for p in a.vertices() for s in _segments(b)] + [(_foot(q, *s), q) for q in b.vertices() for s in _segments(a)]
    p, q = min(pairs, key=lambda x: math.dist(*x))
    if unit and "degree" in unit.lower():
        return math.dist(p, q)
    if unit and "radian" in unit.lower():
        return math.radians(math.dist(p, q))
    return _metres(p, q)


def _ring_area(r: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2


def area(g: Geometry) -> float:
    return sum(abs(_ring_area(y[0])) - sum(abs(_ring_area(h)) for h in y[1:]) for y in g.polygons)


def metric_area(g: Geometry) -> float:
    """Square metres, with degrees of longitude shortened at each ring's mean latitude."""
    total = 0.0
    for y in g.polygons:
        for i, r in enumerate(y):
            k = math.radians(1) * EARTH
            part = abs(_ring_area(r)) * k * k * math.cos(math.radians(sum(p[1] for p in r) / len(r)))
            total += part if i == 0 else -part
    return total


def length(g: Geometry, metric: bool) -> float:
    return sum(_metres(a, b) if metric else math.dist(a, b) for a, b in _segments(g))


def centroid(g: Geometry) -> Geometry:
    x = y = weight = 0.0
    if g.polygons and area(g) > 0:
        for poly in g.polygons:
            for i, r in enumerate(poly):
                sign = (1 if i == 0 else -1) * (1 if _ring_area(r) >= 0 else -1)
                for a, b in zip(r, [*r[1:], r[0]], strict=True):
                    w = sign * (a[0] * b[1] - b[0] * a[1]) / 2
                    x, y, weight = x + w * (a[0] + b[0]) / 3, y + w * (a[1] + b[1]) / 3, weight + w
    elif segments := _segments(g):
        for a, b in segments:
            w = math.dist(a, b)
            x, y, weight = x + w * (a[0] + b[0]) / 2, y + w * (a[1] + b[1]) / 2, weight + w
    else:
        for p in g.vertices():
            x, y, weight = x + p[0], y + p[1], weight + 1
    return Geometry("POINT", [(x / weight, y / weight)] if weight else [], crs=g.crs)


def hull(g: Geometry) -> Geometry:
    points = sorted(set(g.vertices()))
    if len(points) < 3:
        return Geometry("POINT", points, crs=g.crs) if len(points) < 2 else Geometry("LINESTRING", lines=[points], crs=g.crs)

    def half(ps: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    return Geometry("POLYGON", polygons=[[[*ring, ring[0]]]], crs=g.crs) if len(ring) > 2 else Geometry("LINESTRING", lines=[ring], crs=g.crs)


def envelope(g: Geometry) -> Geometry:
    if not (v := g.vertices()):
        return g
    a, b, c, d = min(p[0] for p in v), min(p[1] for p in v), max(p[0] for p in v), max(p[1] for p in v)
    return Geometry("POLYGON", polygons=[[[(a, b), (c, b), (c, d), (a, d), (a, b)]]], crs=g.crs)


def boundary(g: Geometry) -> Geometry:
    if g.polygons:
        return Geometry("MULTILINESTRING" if sum(map(len, g.polygons)) > 1 else "LINESTRING", lines=[r for y in g.polygons for r in y], crs=g.crs)
    ends = [p for x in g.lines if not _near(x[0], x[-1]) for p in (x[0], x[-1])]
    return Geometry("MULTIPOINT", [p for p in dict.fromkeys(ends) if ends.count(p) % 2], crs=g.crs)


def parts(g: Geometry) -> list[Geometry]:
    return [*(Geometry("POINT", [p], crs=g.crs) for p in g.points), *(Geometry("LINESTRING", lines=[x], crs=g.crs) for x in g.lines), *(Geometry("POLYGON", polygons=[y], crs=g.crs) for y in g.polygons)]


def _side(pick, i: int):
    return lambda g: pick(p[i] for p in g.vertices()) if g.vertices() else None


_NUMBERS = {
    "area": area, "metricArea": metric_area, "length": lambda g: length(g, False), "metricLength": lambda g: length(g, True), "perimeter": lambda g: length(g, False), "metricPerimeter": lambda g: length(g, True),
    "minX": _side(min, 0), "minY": _side(min, 1), "maxX": _side(max, 0), "maxY": _side(max, 1),
}
_COUNTS = {"dimension": Geometry.dimension, "coordinateDimension": lambda g: 2, "spatialDimension": lambda g: 2, "numGeometries": lambda g: len(parts(g))}
_FLAGS = {"isEmpty": lambda g: not g.vertices(), "is3D": lambda g: False, "isMeasured": lambda g: False, "isSimple": lambda g: all(len(set(x)) >= len(x) - 1 for x in g.lines)}
_SHAPES = {"centroid": centroid, "convexHull": hull, "envelope": envelope, "boundary": boundary}
_IRIS = {"getSRID": lambda g: g.crs, "geometryType": lambda g: "http://www.opengis.net/ont/sf#" + {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}.get(g.kind, "Multi" + g.kind[5:].capitalize() if g.kind.startswith("MULTI") else "GeometryCollection")}


def _run(function, result: str, args: list):
    """A column of function(geometry, ..., last argument as it is if no geometry is wanted)."""

    def over(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            gs = [parse(row[i], row[i + 1]) for i in range(0, len(row), 2)]
            try:
                out.append(function(gs, row))
            except (ValueError, ZeroDivisionError, IndexError, TypeError, AttributeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(over, result, F.PandasUDFType.SCALAR)
    return udf(*(c for a in args for c in (a["lex"], a["dt"])))


def call(name: str, values: list):
    """A function of the geof: namespace; an unknown one gives an error, that is, no value."""
    from .expressions import Value, integer

    local = name.rsplit("/", 1)[-1]
    args = [v.term() for v in values]

    def double(c):
        return Value(rank=F.when(c.isNotNull(), 4), dec=F.lit(None).cast("decimal(38,18)"), dbl=c)

    def first(f):
        return lambda gs, row: None if gs[0] is None else f(gs[0])

    if not args:
        return Value(as_term=t.null_term())
    if (local in RELATIONS or local in ("sfCrosses", "sfOverlaps")) and len(args) == 2:
        return Value(as_bool=_run(lambda gs, row: None if None in gs else related(local, *gs), "boolean", args))
    if local == "relate" and len(args) >= 2:
        if len(args) == 3:
            return Value(as_bool=_run(lambda gs, row: None if None in gs[:2] else fits(relate(*gs[:2]), row[4]), "boolean", args))
        return Value(as_text=_run(lambda gs, row: None if None in gs else relate(*gs), "string", args))
    if local in ("distance", "metricDistance") and len(args) >= 2:
        return double(_run(lambda gs, row: None if None in gs[:2] else distance(gs[0], gs[1], row[4] if len(row) > 4 else None), "double", args))
    if local in _NUMBERS:
        return double(_run(first(lambda g: None if (x := _NUMBERS[local](g)) is None else float(x)), "double", args[:1]))
    if local in _COUNTS:
        return integer(_run(first(_COUNTS[local]), "bigint", args))
    if local in _FLAGS:
        return Value(as_bool=_run(first(_FLAGS[local]), "boolean", args))
    if local in _SHAPES:
        lex = _run(first(lambda g: to_wkt(_SHAPES[local](g))), "string", args)
        return Value(as_term=F.when(lex.isNotNull(), t.literal(lex, WKT)))
    if local == "geometryN" and len(args) == 2:
        lex = _run(lambda gs, row: None if gs[0] is None else to_wkt(parts(gs[0])[int(row[2]) - 1]) if int(row[2]) > 0 else None, "string", args)
        return Value(as_term=F.when(lex.isNotNull(), t.literal(lex, WKT)))
    if local in ("asWKT", "asGeoJSON"):
        lex = _run(first(to_wkt if local == "asWKT" else to_geojson), "string", args)
        return Value(as_term=F.when(lex.isNotNull(), t.literal(lex, WKT if local == "asWKT" else GEOJSON)))
    if local in _IRIS:
        lex = _run(first(_IRIS[local]), "string", args)
        return Value(as_term=F.when(lex.isNotNull(), t.iri(lex)))
    return Value(as_term=t.null_term())
