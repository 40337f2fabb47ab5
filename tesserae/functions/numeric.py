"""Numeric expressions: tolerant casts, guarded arithmetic, bands, domain features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ["", "none", "nan", "null", "na", "n/a"]
MAGNIFICATIONS = [1000, 2000, 5000, 10000, 20000, 30000, 50000, 100000, 200000]


def number(text: Column) -> Column:
    """A double, or null for null tokens and what is no number."""
    t = F.lower(F.trim(text.cast("string")))
    value = F.when(~t.isin(NULL_TOKENS), t.try_cast("double"))
    return F.when(~F.isnan(value), value)


def hours(text: Column) -> Column:
    """`15min`, `3h` or a bare number as hours; 0 for anything else."""
    t = F.lower(text)
    return F.coalesce(F.when(t.contains("min"), F.replace(t, F.lit("min"), F.lit("")).try_cast("double") / 60).when(t.contains("h"), F.replace(t, F.lit("h"), F.lit("")).try_cast("double")).otherwise(t.try_cast("double")), F.lit(0.0))


def per_um(per_nm: Column) -> Column:
    """1/nm to 1/um."""
    return per_nm * 1000


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """P20: null where a side is null or the divisor 0."""
    return F.when(b != 0, a / b * scale)


def band(value: Column, edges: list[tuple[float, str]], rest: str, low: bool = False) -> Column:
    """Half-open bands: the first label whose edge the value reaches (or, if `low`, stays up to)."""
    out = None
    for edge, label in edges:
        hit = value <= edge if low else value >= edge
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.when(value.isNotNull(), rest))


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def nearest_magnification(value: Column, standard: list[int] = MAGNIFICATIONS) -> Column:
    """the standard magnification of least difference."""
    known = F.array(*[F.lit(m) for m in standard])
    return F.array_min(F.transform(known, lambda m: F.struct(F.abs(m - value).alias("d"), m.alias("m"))))["m"]


def violations(temp: Column, fe: Column, ar: Column, c2h4: Column) -> Column:
    """Names of the physical limits that parameters break."""
    flow = ratio(ar, c2h4)
    return F.filter(
        F.array(
            F.when(temp < 600, "temperature_low"), F.when(temp > 900, "temperature_high"),
            F.when(fe < 0.5, "fe_thin"), F.when(fe > 3.0, "fe_thick"),
            F.when(flow < 5, "gas_ratio_low"), F.when(flow > 50, "gas_ratio_high"),
        ),
        lambda x: x.isNotNull(),
    )


def enhanced_features(temp: Column, ar: Column, h2: Column, c2h4: Column, catalyst: Column, position: Column) -> list[Column]:
    """Process features with defaults for what is missing and guards against division by 0."""
    t, a, h, c = (F.coalesce(x, F.lit(d)) for x, d in ((temp, 750.0), (ar, 500.0), (h2, 100.0), (c2h4, 50.0)))
    w, p = F.coalesce(catalyst, F.lit(1.0)), F.coalesce(position, F.lit(18.0))
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return [
        (t / 750).alias("temp_normalized"), (a + h + c).alias("gas_total"), safe(c, a).alias("carbon_supply"), safe(h, a).alias("reduction_ratio"),
        safe(a, c).alias("ar_to_c2h4_ratio"), (p / 36).alias("position_normalized"), (t * w).alias("temp_x_catalyst"), (a * (t / 800)).alias("flow_temp_interaction"), (a / F.greatest(w, F.lit(0.1))).alias("flow_per_catalyst"),
    ]


def quality_score(density: Column, alignment: Column, diameter: Column, curvature: Column, tortuosity: Column, waviness: Column, magnification: Column) -> Column:
    """100 less a penalty for each missing or implausible value; not below 0."""

    def pen(*cases: tuple[Column, int]) -> Column:
        out = F.when(cases[0][0], cases[0][1])
        for hit, cost in cases[1:]:
            out = out.when(hit, cost)
        return out.otherwise(0)

    costs = [
        pen((density.isNull(), 35), ((density <= 0) | (density > 95), 40), ((density < 5) | (density > 85), 18)),
        pen((alignment.isNull(), 20), ((alignment < -0.5) | (alignment > 1.0), 30), (alignment < 0, 12)),
        pen((diameter.isNull(), 15), ((diameter < 5) | (diameter > 200), 30), (diameter > 120, 12)),
        pen((curvature.isNull(), 18), ((curvature < 0) | (curvature > 100), 28), (curvature > 30, 10)),
        pen((tortuosity.isNull(), 10), ((tortuosity < 1) | (tortuosity > 3), 25), (tortuosity > 2.2, 10)),
        pen((waviness.isNull(), 8), ((waviness < 0) | (waviness > 5), 20), (waviness > 2, 10)),
        pen((magnification < 20000, 14)),
    ]
    return F.greatest(F.lit(0), F.lit(100) - reduce(lambda a, b: a + b, costs))


def quality_band(score: Column) -> Column:
    return F.when(score < 55, "low").when(score < 80, "medium").otherwise("high")


def confidence(similar: Column, evidence: Column, r2: Column, violated: Column) -> Column:
    """how far a prediction can be trusted."""
    c = 0.35 + F.least(similar * 0.07, F.lit(0.28)) + F.least(evidence * 0.04, F.lit(0.12)) + F.coalesce(F.greatest(F.least(r2, F.lit(0.20)), F.lit(-0.05)), F.lit(0.0))
    return clamp(F.when(violated > 0, F.least(c, F.lit(0.35))).otherwise(c), 0.1, 0.98)
