"""File and folder names of experiments as typed columns. The name formats are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A fixed value: the fields of a long name, in their order.
LONG_NAME = (
    r"(?i)No(\d+)\s+"  # sample
    r"([\d.]+)w?\s+"  # al2o3_power
    r"([\d.]+)nm?\s+"  # al2o3_thickness
    r"([\d.]+)w?\s+"  # fe_power
    r"([\d.]+)(?:nm)?(?:-\d+)?\s+"  # fe_thickness
    r"([\d.]+)\s+"  # ar_flow
    r"([\d.]+)\s+"  # h2_flow
    r"([\d.]+)\s+"  # c2h4_flow
    r"([\d.]+)\s+"  # anneal_temp
    r"([\d.]+)\s+"  # growth_temp
    r"([\d.min]+)\s+"  # anneal_time
    r"([\d.minh]+)\s+"  # growth_time
    r"(top|mid|bottom|Middle|Top|Bottom|Position-\w+|all|bpttom)?\s*"  # position
    r"(\d+)[\s-]+"  # magnification
    r"(\d+)(?:-.*)?"  # repeat_id
)
LONG_FIELDS = ["sample", "al2o3_power", "al2o3_thickness", "fe_power", "fe_thickness", "ar_flow", "h2_flow", "c2h4_flow", "anneal_temp", "growth_temp", "anneal_time", "growth_time", "position", "magnification", "repeat_id"]
ALIASES = {"bpttom": "bottom", "middle": "mid"}


def stem(path: Column) -> Column:
    """file name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, r"[\\/]"), -1), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    parts = F.split(path, r"[\\/]")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def is_mid(position: Column) -> Column:
    return F.coalesce(F.lower(F.trim(position)).rlike("^(mid|position-mid)"), F.lit(False))


def long_name(name: Column) -> Column:
    """A struct of the fifteen fields, or null where the name has another form."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    raw = [F.regexp_extract(base, LONG_NAME, i) for i in range(1, 16)]
    text = F.lower(raw[12])
    place = F.when(text == "", "Unknown").when(text.isin(list(ALIASES)), F.element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), text)).otherwise(raw[12])
    place = F.when(is_mid(place), "mid").otherwise(place)
    fields = [F.concat(F.lit("No"), raw[0], F.lit("-"), raw[13], F.lit("-"), raw[14].cast("string").try_cast("int").cast("string")).alias("sample_id")]
    fields += [raw[i].try_cast("double").alias(LONG_FIELDS[i]) for i in range(1, 10)]
    fields += [raw[10].alias("anneal_time"), raw[11].alias("growth_time"), place.alias("position_label"), raw[13].try_cast("long").alias("magnification"), raw[14].try_cast("long").alias("repeat_id")]
    return F.when(base.rlike(LONG_NAME), F.struct(*fields))


def short_name(name: Column, parent: Column) -> Column:
    """`C<n><A|B|C><n>` with process values from the folder over defaults."""
    form = r"(?i)C(\d+)([ABC])(\d+)"
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    part = lambda re, i=1: F.regexp_extract(F.coalesce(parent, F.lit("")), re, i).try_cast("double")
    place = F.upper(F.regexp_extract(base, form, 2))
    number = [F.regexp_extract(base, form, i).try_cast("long") for i in (1, 3)]
    label = F.concat(F.lit("C"), number[0].cast("string"), F.lit("-"), place, number[1].cast("string"))
    return F.when(
        base.rlike(form),
        F.struct(
            label.alias("sample_id"), number[0].alias("membrane_id"), place.alias("horizontal_pos"), number[1].alias("vertical_pos"),
            F.coalesce(part(r"[tT]\s*(\d+)"), F.lit(800.0)).alias("growth_temp"), F.lit(3.0).alias("growth_time"),
            F.coalesce(part(r"[lL]\s*(\d+)"), F.lit(250.0)).alias("ar_flow"), F.coalesce(part(r"(?i)(\d+(?:\.\d+)?)\s*g\b"), F.lit(1.0)).alias("catalyst_weight"),
        ),
    )


def folder_name(name: Column) -> Column:
    """Date, temperature, time, flow and weight of an experiment folder; null where absent."""
    part = lambda re: F.nullif(F.regexp_extract(name, re, 1), F.lit(""))
    return F.struct(
        part(r"^(\d{6})").alias("date"), part(r"[tT](\d+)").try_cast("long").alias("temp_c"), part(r"(?i)(\d+)h").try_cast("long").alias("time_h"),
        part(r"[lL](\d+)").try_cast("long").alias("flow_l"), part(r"(\d+\.?\d*)g").try_cast("double").alias("weight_g"),
    )


def experiment_date(name: Column) -> Column:
    """`YYMMDD` in front of a folder name as a date."""
    digits = F.regexp_extract(name, r"^(\d{6})", 1)
    return F.when(digits != "", F.try_to_timestamp(F.concat(F.lit("20"), digits), F.lit("yyyyMMdd")).cast("date"))


def importable(position: Column, magnification: Column, least: int = 9000) -> Column:
    """From the middle and magnified enough."""
    return F.coalesce(is_mid(position) & (magnification >= least), F.lit(False))


def group_key(path: Column) -> Column:
    """a file name without magnification, repeat and position."""
    out = F.lower(stem(path))
    out = F.regexp_replace(out, r"\s+\d+[\s-]+\d+$", "")
    out = F.regexp_replace(out, r"\b(top|mid|middle|bottom)\b", "")
    out = F.regexp_replace(out, r"[_\s]+", " ")
    return F.trim(out)
