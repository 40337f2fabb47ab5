"""Statements of one thing acting on another, read from sentences by patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a statement, its relation and direction, and its pattern with the groups
# src, tgt and, where a statement has two targets, tgt2. All match whatever the case.
PATTERNS = [
    ("original", "increases", "positive", r"(?P<src>.+?)\s*(?:增加|提高|enhance|increase|improve)\s*(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("original", "increases", "positive", r"(?P<tgt>.+?)\s*(?:随着|with)\s*(?P<src>.+?)\s*(?:增加|提高|increase)"),
    ("original", "decreases", "negative", r"(?P<src>.+?)\s*(?:减少|降低|decrease|reduce)\s*(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("original", "decreases", "negative", r"(?P<tgt>.+?)\s*(?:随着|with)\s*(?P<src>.+?)\s*(?:减少|降低|decrease)"),
    ("nominalization", "increases", "positive", r"(?:increase|increase of|increase in)\s+(?P<src>.+?)\s+(?:leads to|results in|improves|enhances)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("nominalization", "increases", "positive", r"(?:the\s+)?(?:increase|elevation|enhancement)\s+(?:of|in)\s+(?P<src>.+?)\s+(?:enhances|improves)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("nominalization", "increases", "positive", r"(?P<src>.+?)\s+(?:increase|elevation)\s+(?:leads to|results in)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("nominalization", "decreases", "negative", r"(?:decrease|decrease of|decrease in)\s+(?P<src>.+?)\s+(?:leads to|results in|reduces)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("nominalization", "decreases", "negative", r"(?:the\s+)?(?:decrease|reduction)\s+(?:of|in)\s+(?P<src>.+?)\s+(?:reduces)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("composite", "increases", "positive", r"(?P<src>.+?)\s*(?:enhances|improves|increases)\s+(?P<tgt1>.+?)\s+(?:and|while|but)\s+(?:reduces|decreases)\s+(?P<tgt2>.+?)(?:$|[。.!?;；])"),
    ("composite", "decreases", "negative", r"(?P<src>.+?)\s*(?:reduces|decreases)\s+(?P<tgt>.+?)\s+and\s+(?P<tgt2>.+?)(?:$|[。.!?;；])"),
    ("passive", "increases", "positive", r"(?P<tgt>.+?)\s+(?:is|was|are|were)\s+(?:improved|enhanced|increased)\s+by\s+(?P<src>.+?)(?:$|[。.!?;；])"),
    ("passive", "increases", "positive", r"(?P<tgt>.+?)\s+can\s+be\s+(?:improved|enhanced)\s+by\s+(?P<src>.+?)(?:$|[。.!?;；])"),
    ("passive", "increases", "positive", r"(?P<tgt>.+?)(?:被|由)\s+(?P<src>.+?)(?:提高|增加|增强)(?:$|[。.!?;；])"),
    ("comparison", "increases", "positive", r"(?:higher|greater|increased)\s+(?P<src>.+?)\s+(?:leads to|results in)\s+(?:higher|greater|better|improved)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("comparison", "increases", "positive", r"(?P<src>.+?)\s+(?:increases|improves)\s+(?:compared to|relative to|vs\.?)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("negation", "does_not_affect", "neutral", r"(?P<src>.+?)\s+(?:does not|doesn't|does\s+not)\s+(?:affect|influence|impact)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("negation", "does_not_affect", "neutral", r"(?P<src>.+?)\s+(?:has no effect|has little effect)\s+on\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("negation", "does_not_affect", "neutral", r"(?P<src>.+?)\s+(?:没有|不|未)\s*(?:影响|affect)\s+(?P<tgt>.+?)(?:$|[。.!?;；])"),
    ("conditional", "increases", "positive", r"(?:when|while|at)\s+(?P<src>.+?)\s*[>≥]\s*(?P<value>\d+\.?\d*)\s*(?:,|;)\s*(?P<tgt>.+?)\s+(?:improves|enhances|increases)"),
    ("conditional", "increases", "positive", r"(?:in the presence of|with)\s+(?P<src>.+?)\s*,\s*(?P<tgt>.+?)\s+(?:is improved|improves|enhances)"),
]


def places(pattern: str) -> dict[str, int]:
    """Numbers of a pattern's named groups."""
    return dict(re.compile(pattern).groupindex)


def statements(sentence: Column) -> Column:
    """What a sentence states, as structs of form, source, target, relation, direction and whether
    it is denied: the first match of each pattern, a fact for each target, each source, target and
    relation once, in the patterns' order. Facts that lack an end are left out."""
    found = []
    for form, relation, direction, pattern in PATTERNS:
        groups, java = places(pattern), "(?i)" + pattern.replace("(?P<", "(?<")
        for target in ("tgt", "tgt2"):
            if target in groups:
                ends = [F.trim(F.regexp_extract(sentence, java, groups[g])).alias(n) for g, n in (("src", "source"), (target, "target"))]
                found.append(F.when(sentence.rlike(java), F.struct(F.lit(form).alias("form"), *ends, F.lit(relation).alias("relation"), F.lit(direction).alias("direction"), F.lit(form == "negation").alias("negated"))))
    whole = F.filter(F.array(*found), lambda x: x.isNotNull() & (x["source"] != "") & (x["target"] != ""))
    same = lambda a, b: (a["source"] == b["source"]) & (a["target"] == b["target"]) & (a["relation"] == b["relation"])
    return F.aggregate(whole, F.slice(whole, 1, 0), lambda out, x: F.when(F.exists(out, lambda y: same(x, y)), out).otherwise(F.concat(out, F.array(x))))


def facts(sentences: DataFrame, key: str, column: str) -> DataFrame:
    """One row a fact, with its place among the sentence's facts."""
    return sentences.select(key, F.posexplode(statements(F.col(column))).alias("place", "f")).select(key, "place", "f.*")
