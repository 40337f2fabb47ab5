"""Text expressions: tokens, chunks, sentences, factor matching, normalisation. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for ranking.
STOP_WORDS = "the and for with from into that this of to in on is are by or a an 的 了 和 与 及 在 对 中 为 是".split()
CHUNK, OVERLAP = 500, 80


def squeeze(text: Column) -> Column:
    """white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """overlapping pieces of fixed size; the last ends with the text; none for empty text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """lower-case runs of Latin or CJK letters, without stop words and single letters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+|[\\u4e00-\\u9fff]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stop_words))


def sentences(text: Column, pattern: str = "[。！？.!?;\\n]+") -> Column:
    """trimmed, non-empty pieces between sentence ends."""
    return F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(F.regexp_replace(s, "^\\s+|\\s+$", ""))), lambda s: s != "")


def factors(text: Column, patterns: dict[str, list[str]]) -> Column:
    """labels, in the dictionary's order, one of whose patterns occurs in the lower-cased text."""
    low = F.lower(text)
    hits = F.array(*[F.when(low.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(label)) for label, ps in patterns.items()])
    return F.filter(hits, lambda x: x.isNotNull())


def direction(text: Column, up: list[str], down: list[str]) -> Column:
    """increase, decrease, both, or null."""
    low = F.lower(text)
    inc, dec = low.rlike("|".join(up)), low.rlike("|".join(down))
    return F.when(inc & dec, "nonlinear_or_tradeoff").when(inc, "increase").when(dec, "decrease")


def domain(url: Column, kind: Column) -> Column:
    """host of a URL without `www.`; local files by their type."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", "")).otherwise(F.concat(F.lit("local_"), F.coalesce(kind, F.lit("unknown"))))


def doi_key(value: Column) -> Column:
    """a DOI without resolver and in lower case."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"^https?://(dx\.)?doi\.org/", "")


def url_key(value: Column) -> Column:
    """scheme, host, path and query; https where no scheme is given."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    scheme, host = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""), r"#.*$", "")
    return F.when(raw == "", "").otherwise(F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, rest))


def title_key(value: Column) -> Column:
    """letters, digits and underscores of a title in lower case."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[^\w一-鿿]+", "")


def slug(value: Column, longest: int = 80) -> Column:
    """ASCII letters and digits joined by hyphens."""
    ascii_only = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[^\x00-\x7f]", "")
    out = F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = F.regexp_replace(F.substring(out, 1, longest), "^-+|-+$", "")
    return F.when(out == "", "paper").otherwise(out)


def fingerprint(value: Column) -> Column:
    """the first ten hex digits of SHA-1."""
    return F.substring(F.sha1(value), 1, 10)


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def clean_scan(text: Column, words: dict[str, str] | None = None) -> Column:
    """F16: text of scanned pages: hyphenated line ends joined, spacing around punctuation, known
    misreadings replaced as whole words, doubled words and control characters removed."""
    out = F.regexp_replace(text, r"(\w)-\s*\n\s*(\w)", "$1$2")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"\s+([.,;:!?])", "$1")
    out = F.regexp_replace(out, r"([.,;:!?])(?=[A-Za-z])", "$1 ")
    for wrong, right in (words or {}).items():
        out = F.regexp_replace(out, rf"\b{wrong}\b", right)
    out = camel_split(out)
    out = F.regexp_replace(out, r"\b(\w+)(?:\s+\1\b)+", "$1")
    return F.trim(F.regexp_replace(out, r"[\x00-\x08\x0b-\x1f\x7f]", ""))


def problems(text: Column, misread: list[str]) -> Column:
    """names of what looks wrong with a piece of text."""
    return F.filter(
        F.array(
            F.when(F.length(text) < 50, "too_short"),
            F.when(F.length(text) > 2000, "too_long"),
            F.when(text.rlike("[a-z][A-Z]"), "camel_case"),
            F.when(text.rlike(r"\b(\w+)\s+\1\b"), "repeated_word"),
            F.when(F.lower(text).rlike("|".join(rf"\b{w}\b" for w in misread)), "misread_word") if misread else F.lit(None).cast("string"),
        ),
        lambda x: x.isNotNull(),
    )


def category(node: Column) -> Column:
    """What stands before the colon of `category:label`."""
    return F.when(F.instr(node, ":") > 0, F.substring_index(node, ":", 1)).otherwise(F.lit(""))


def suffix(node: Column) -> Column:
    return F.regexp_replace(node, "^[^:]*:", "")


# Conditions of a statement: kind, pattern of the number(s), operator, unit. Fixed patterns.
CONDITIONS = [
    ("temperature", r"(?i)temperature\s*(?:above|>)\s*(\d+\.?\d*)", ">", "°C"),
    ("temperature", r"(?i)temperature\s*(?:below|<)\s*(\d+\.?\d*)", "<", "°C"),
    ("temperature", r"(?i)temperature\s*=\s*(\d+\.?\d*)", "=", "°C"),
    ("time", r"(?i)(?:time|duration)\s*(?:above|>)\s*(\d+\.?\d*)", ">", "min"),
    ("flow", r"(?i)flow\s*(?:above|>)\s*(\d+\.?\d*)", ">", "sccm"),
    ("thickness", r"(?i)thickness\s*(?:above|>)\s*(\d+\.?\d*)", ">", "nm"),
    ("pressure", r"(?i)pressure\s*(?:above|>)\s*(\d+\.?\d*)", ">", "Pa"),
]
RANGES = [
    ("temperature", r"(?i)temperature\s*between\s*(\d+\.?\d*)\s*(?:and|-|~)\s*(\d+\.?\d*)", "°C"),
    ("temperature", r"(\d+\.?\d*)\s*-\s*(\d+\.?\d*)\s*(?:°C|℃)", "°C"),
    ("time", r"(\d+\.?\d*)\s*-\s*(\d+\.?\d*)\s*min\b", "min"),
    ("flow", r"(?i)flow\s*between\s*(\d+\.?\d*)\s*(?:and|-|~|to)\s*(\d+\.?\d*)", "sccm"),
    ("thickness", r"(?i)thickness\s*between\s*(\d+\.?\d*)\s*(?:and|-|~|to)\s*(\d+\.?\d*)", "nm"),
]


def conditions(text: Column) -> Column:
    """array of (parameter, op, lo, hi, unit) of a statement's numeric conditions."""
    def make(parameter: str, op: str, unit: str):
        return lambda lo, hi: F.struct(F.lit(parameter).alias("parameter"), F.lit(op).alias("op"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.lit(unit).alias("unit"))

    def one(parameter: str, pattern: str, op: str, unit: str) -> Column:
        built = make(parameter, op, unit)
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: built(v, F.lit(None)))

    found = [one(*c) for c in CONDITIONS]
    found += [F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2)), make(n, "in_range", u)) for n, p, u in RANGES]
    return F.concat(*found)


def condition_holds(op: Column, lo: Column, hi: Column, value: Column) -> Column:
    """whether a value meets a condition; equality within 0.01."""
    return F.when(op == ">", value > lo).when(op == "<", value < lo).when(op == "=", F.abs(value - lo) < 0.01).when(op == "in_range", (value >= lo) & (value <= hi)).otherwise(F.lit(False))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def event_stream(pieces: Column, error: Column, session: Column) -> Column:
    """A server-sent event for each piece of an answer; an error's event and an end where there
    is one, and the session's end in any case. No piece is lost to an error after it."""
    event = lambda *parts: F.concat(F.lit("data: {"), *parts, F.lit("}\n\n"))
    told = F.transform(F.filter(pieces, lambda p: p.isNotNull()), lambda p: event(F.lit('"type": "content", "text": '), _quoted(p)))
    broken = F.when(error.isNotNull(), F.array(event(F.lit('"type": "error", "detail": '), _quoted(F.when(error == "", "unknown stream error").otherwise(error))), event(F.lit('"type": "done"'))))
    done = F.array(event(F.lit('"type": "done", "session_id": '), _quoted(session)))
    return F.concat(F.coalesce(told, F.array().cast("array<string>")), F.coalesce(broken, F.array().cast("array<string>")), done)
