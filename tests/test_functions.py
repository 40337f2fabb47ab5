"""Expressions and array functions on literal rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import calibration, geometry, numeric, parsing, text
from tesserae.operators import graph, stats


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("n", [0, 1, 80, 420, 500, 501, 920, 921, 1000])
def test_chunks_cover_the_text(spark, n):
    whole = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, whole, text.chunks)
    assert len(got) == (0 if n == 0 else max(0, math.ceil((n - 500) / 420)) + 1)
    assert "".join([c if i == 0 else c[80:] for i, c in enumerate(got)]) == whole


def test_tokens(spark):
    assert one(spark, "The Growth of CNT-forests 温度高 a b2", text.tokens) == ["growth", "cnt", "forests", "温度高"]
    assert one(spark, None, text.tokens) == []


def test_sentences_and_direction(spark):
    assert one(spark, " One. Two!\n Three; ", text.sentences) == ["One", "Two", "Three"]
    for said, want in (("Higher heat", "increase"), ("it drops lower", "decrease"), ("improve but reduce", "nonlinear_or_tradeoff"), ("same", None)):
        assert one(spark, said, lambda c: text.direction(c, graph.INCREASE, graph.DECREASE)) == want


def test_relations_of_a_statement(spark):
    said = "Increasing temperature improves alignment and conductivity in forests. Higher Fe thickness increases diameter and can reduce conductivity."
    rows = graph.valid_facts(graph.relations(spark.createDataFrame([(1, said)], "id long, t string"), "id", "t")).collect()
    seen = {(r.relation, r.source, r.target, r.direction) for r in rows}
    assert ("process_morphology", "process:growth_temp", "morphology:alignment", "increase") in seen
    assert ("process_performance", "process:fe_thickness", "performance:conductivity", "nonlinear_or_tradeoff") in seen
    assert all(0 < r.confidence <= 0.98 for r in rows)


def test_inverse_relations(spark):
    rows = graph.relations(spark.createDataFrame([(1, "Higher temperature lowers nothing; higher temperature means larger resistivity")], "id long, t string"), "id", "t").collect()
    assert {(r.target, r.direction) for r in rows if r.relation == "process_performance"} >= {("performance:resistivity", "increase"), ("performance:conductivity", "decrease")}


def test_conditions(spark):
    got = one(spark, "temperature above 750 and 750-800°C, 10-20 min, flow between 5 and 7", text.conditions)
    assert {(c.parameter, c.op, c.lo, c.hi) for c in got} == {("temperature", ">", 750.0, None), ("temperature", "in_range", 750.0, 800.0), ("time", "in_range", 10.0, 20.0), ("flow", "in_range", 5.0, 7.0)}


@pytest.mark.parametrize("url,want", [("https://www.sciencedirect.com/a", "sciencedirect.com"), ("http://u@x.org:80/", "x.org"), ("/tmp/a.pdf", "local_pdf"), (None, "local_pdf")])
def test_domain(spark, url, want):
    assert one(spark, url, lambda c: text.domain(c, F.lit("pdf"))) == want


def test_keys(spark):
    assert one(spark, " https://doi.org/10.1/AbC ", text.doi_key) == "10.1/abc"
    assert one(spark, "HTTP://A.org/P?q=1#f", text.url_key) == "http://a.org/P?q=1"
    assert one(spark, " A  Title: Now! ", text.title_key) == "atitlenow"
    assert one(spark, "Ünder the Séa!", text.slug) == "nder-the-sa" and one(spark, "", text.slug) == "paper"


@pytest.mark.parametrize("raw,want", [("1.5", 1.5), (" NaN ", None), ("n/a", None), ("", None), ("x", None), (None, None), ("-2e3", -2000.0)])
def test_tolerant_numbers(spark, raw, want):
    assert one(spark, raw, numeric.number) == want


@pytest.mark.parametrize("raw,want", [("15min", 0.25), ("3h", 3.0), ("2", 2.0), ("x", 0.0)])
def test_hours(spark, raw, want):
    assert one(spark, raw, numeric.hours) == want


def test_long_names(spark):
    got = one(spark, "No7 200w 40nm 30w 1.2nm 500 100 60 700 750 15min 3h Middle 50000-3.tif", parsing.long_name)
    assert (got.sample_id, got.fe_thickness, got.growth_temp, got.position_label, got.magnification) == ("No7-50000-3", 1.2, 750.0, "mid", 50000)
    assert one(spark, "other.tif", parsing.long_name) is None


@pytest.mark.parametrize("place,mag,want", [("mid", 9000, True), ("midA", 10000, True), ("mid10", 50000, True), ("Position-Mid", 9000, True), ("top", 50000, False), ("mid", 8999, False), (None, 50000, False)])
def test_import_rule(spark, place, mag, want):
    df = spark.createDataFrame([(place, mag)], "p string, m long")
    assert df.select(parsing.importable(F.col("p"), F.col("m"))).first()[0] is want


def test_short_names(spark):
    df = spark.createDataFrame([("C4A1.tiff", "250524 T850 3H L300 1.5g"), ("C10b2.tif", None), ("x.tif", "T1")], "n string, f string")
    got = [r[0] for r in df.select(parsing.short_name(F.col("n"), F.col("f"))).collect()]
    assert (got[0].sample_id, got[0].growth_temp, got[0].ar_flow, got[0].catalyst_weight) == ("C4-A1", 850.0, 300.0, 1.5)
    assert (got[1].sample_id, got[1].growth_temp, got[1].catalyst_weight, got[2]) == ("C10-B2", 800.0, 1.0, None)


def test_splines_meet_their_points(spark):
    for set_temp, (xs, ys) in calibration.PROFILES.items():
        df = spark.createDataFrame([(float(set_temp), float(x)) for x in xs], "s double, x double")
        assert np.allclose([r[0] for r in df.select(calibration.actual_temp(F.col("s"), F.col("x"))).collect()], ys)
    x = np.linspace(0, 5, 6)
    for x0, c0, c1, c2, c3 in calibration.spline(list(x), list(x**3 - 2 * x)):
        assert np.allclose([c0, c1, c2, c3], [x0**3 - 2 * x0, 3 * x0**2 - 2, 3 * x0, 1])
    mid = spark.range(1).select(calibration.actual_temp(F.lit(775.0), F.lit(14.0)), calibration.actual_temp(F.lit(750.0), F.lit(14.0)), calibration.actual_temp(F.lit(800.0), F.lit(14.0))).first()
    assert math.isclose(mid[0], (mid[1] + mid[2]) / 2)


def test_quality_bands(spark):
    df = spark.createDataFrame([(50.0, 0.5, 30.0, 5.0, 1.2, 0.3, 50000), (None, None, None, None, None, None, None), (0.0, 2.0, 300.0, 200.0, 9.0, 9.0, 1000)], "a double, b double, c double, d double, e double, f double, g long")
    score = numeric.quality_score(*[F.col(c) for c in "abcdefg"])
    assert [(r[0], r[1]) for r in df.select(score, numeric.quality_band(score)).collect()] == [(100, "high"), (0, "low"), (0, "low")]


def test_skeleton_figures():
    cross = np.zeros((21, 21), int)
    cross[10, :] = cross[:, 10] = 1
    j, e, n = geometry.junctions(cross)
    assert (e, n) == (4, 41) and j >= 1
    assert len(geometry.components(cross)) == 1 and len(geometry.ordered(np.argwhere(cross))) == 21
    flat = [np.column_stack([np.zeros(30), np.arange(30)])]
    up = [np.column_stack([np.arange(30), np.zeros(30)])]
    assert geometry.orientation(flat)[0] == pytest.approx(-0.5, abs=1e-6) or geometry.orientation(flat)[0] == pytest.approx(1, abs=1e-6)
    assert geometry.orientation(flat)[0] == pytest.approx(geometry.orientation(up, True)[0])
    band = np.zeros((20, 60), int)
    band[6:13] = 1
    middle = np.zeros_like(band)
    middle[9, 10:50] = 1
    assert geometry.diameter(geometry.widths(band, middle)) == pytest.approx(8, abs=1.5)
    spur = np.zeros((20, 40), int)
    spur[10, :] = 1
    spur[8:10, 20] = 1
    assert geometry.prune(spur, 4).sum() >= 39 and geometry.prune(spur, 4)[8, 20] == 0
    assert geometry.patches(100, 64, 64, 32) == [(0, 0), (32, 0), (36, 0)]
    image = np.full((300, 10), 100.0)
    image[200:] = 0
    assert geometry.roi(image).shape[0] == 210  # ten rows of the bar stay
    image[200:] = 90
    assert geometry.roi(image).shape[0] == 235  # no bar to see: its usual height
    image[260:] = 200
    assert geometry.roi(image).shape[0] == 276  # brighter rows at the end, of which some go anyway
    assert len(geometry.roi(np.zeros((3, 3)))) == 1
    stripes = np.tile(np.sin(np.arange(60) / 3)[:, None] * 100, (1, 60))
    assert geometry.structure_tensor(stripes)[1] > 0.9 and geometry.rose(stripes).argmax() in (0, 17)


def test_correlation_p_values():
    # Student's t with 8 degrees of freedom: t = 2.306 leaves 5 % on both sides
    r = 2.306 / math.sqrt(8 + 2.306**2)
    assert stats.correlation_p(np.array([r, 0.0, 1.0]), np.array([10, 10, 10])) == pytest.approx([0.05, 1.0, 0.0], abs=1e-4)
