"""Geometry functions."""

import pytest

from quadrille.functions import geo

SQUARE, INNER, BESIDE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))"
SHIFTED, FAR, LINE, DOT = "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", "POLYGON ((20 20, 21 20, 21 21, 20 20))", "LINESTRING (-1 1, 5 1)", "POINT (1 1)"


def g(text):
    return geo.parse(text, geo.WKT)


@pytest.mark.parametrize("a, b, yes", [
    (SQUARE, SQUARE, {"sfEquals", "sfIntersects", "sfWithin", "sfContains", "ehEquals", "rcc8eq"}),
    (SQUARE, INNER, {"sfIntersects", "sfContains", "ehContains", "rcc8ntppi"}),
    (INNER, SQUARE, {"sfIntersects", "sfWithin", "ehInside", "rcc8ntpp"}),
    (SQUARE, BESIDE, {"sfIntersects", "sfTouches", "ehMeet", "rcc8ec"}),
    (SQUARE, SHIFTED, {"sfIntersects", "sfOverlaps", "ehOverlap", "rcc8po"}),
    (SQUARE, FAR, {"sfDisjoint", "ehDisjoint", "rcc8dc"}),
    (LINE, SQUARE, {"sfIntersects", "sfCrosses", "ehOverlap"}),
    (DOT, SQUARE, {"sfIntersects", "sfWithin", "ehInside"}),
    (DOT, LINE, {"sfIntersects", "sfWithin", "ehInside"}),
    ("POINT (0 0)", SQUARE, {"sfIntersects", "sfTouches", "ehMeet"}),
    ("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", {"sfIntersects", "sfCrosses", "ehOverlap"}),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "POINT (1.5 1.5)", {"sfDisjoint", "ehDisjoint"}),
])
def test_relations(a, b, yes):
    names = [*geo.RELATIONS, "sfCrosses", "sfOverlaps"]
    areas = all(x.startswith("POLYGON") for x in (a, b))
    found = {n for n in names if geo.related(n, g(a), g(b)) and (areas or not n.startswith("rcc8"))}
    assert found == yes


def test_measures():
    assert geo.area(g(SQUARE)) == 16 and geo.length(g(SQUARE), False) == 16
    assert geo.to_wkt(geo.centroid(g(SQUARE))) == "POINT (2 2)"
    assert geo.to_wkt(geo.envelope(g(LINE))) == "POLYGON ((-1 1, 5 1, 5 1, -1 1, -1 1))"
    assert geo.to_wkt(geo.hull(g("MULTIPOINT (0 0, (4 0), 2 1, 4 4, 0 4)"))) == SQUARE
    assert geo.distance(g("POINT (0 0)"), g("POINT (0 1)"), None) == pytest.approx(111195, rel=1e-4)
    assert geo.distance(g(SQUARE), g("POINT (7 8)"), geo.UOM + "degree") == 5 and geo.distance(g(SQUARE), g(DOT), None) == 0
    assert g("POINT (1") is None and g("CIRCLE (1 2)") is None and geo.parse("{", geo.GEOJSON) is None
    again = geo.parse(geo.to_geojson(g(SQUARE)), geo.GEOJSON)
    assert geo.to_wkt(again) == SQUARE and geo.to_wkt(g("POINT EMPTY")) == "POINT EMPTY"


def test_functions_in_queries(spark):
    from quadrille.store import Store

    s = Store(spark)
    s.update("PREFIX : <http://ex/> PREFIX geo: <http://www.opengis.net/ont/geosparql#> INSERT DATA { :a :at 'POINT (0 0)'^^geo:wktLiteral . :b :at 'POINT (0 1)'^^geo:wktLiteral . :c :at 'nowhere'^^geo:wktLiteral }")
    q = "PREFIX : <http://ex/> PREFIX geof: <http://www.opengis.net/def/function/geosparql/> SELECT ?x (geof:distance(?g, ?h) AS ?d) (geof:noSuch(?g) AS ?n) { ?x :at ?g . :b :at ?h FILTER(geof:sfDisjoint(?g, ?h)) }"
    rows = [tuple(r) for r in s.query(q).decode({"d": "double"}).collect()]
    assert [(x, round(d), n) for x, d, n in rows] == [("http://ex/a", 111195, None)]
