"""Evidence graphs: typed links, chains grown by joins, path scores and classes.

Links are rows (id, relation, source, target, direction, confidence). Growth is a fixed number
of joins; each tail takes a bounded number of links by rank, which is the feature's own limit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which relation may follow which.
TRANSITIONS = [
    ("process_morphology", "morphology_performance"), ("process_morphology", "mechanism_morphology"),
    ("process_mechanism", "mechanism_morphology"), ("process_mechanism", "mechanism_evidence"),
    ("mechanism_morphology", "morphology_performance"), ("mechanism_morphology", "process_morphology"),
]


def degrees(links: DataFrame) -> DataFrame:
    """Links at each node, each link at both its ends."""
    return links.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def expand(links: DataFrame, seeds: DataFrame, hops: int, allowed: list[str] | None = None) -> DataFrame:
    """Nodes within `hops` links of the seeds, with the least number of links."""
    edges = links if allowed is None else links.where(F.col("relation").isin(allowed))
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct()
    seen = seeds.select(F.col("node"), F.lit(0).alias("hop")).distinct()
    frontier = seen
    for k in range(1, hops + 1):
        reached = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def grow(links: DataFrame, seeds: DataFrame, hops: int, per_tail: int = 20, least: float = 0.0, transitions: DataFrame | None = None) -> DataFrame:
    """Paths of up to `hops` further links from each seed link, target to source, without a
    link twice; each tail's best `per_tail` links by confidence, then id."""
    usable = links.where(F.col("confidence") >= least)
    follow = usable.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "id"))).where(F.col("_n") <= per_tail)
    follow = follow.select(F.col("source").alias("_s"), F.struct("id", "relation", "source", "target", "direction", "confidence").alias("_next"))
    step = F.struct("id", "relation", "source", "target", "direction", "confidence")
    paths = seeds.select(F.array(step).alias("path"))
    out = paths
    for _ in range(hops):
        tail = F.element_at("path", -1)
        nxt = paths.join(follow, tail["target"] == F.col("_s")).where(~F.array_contains(F.transform("path", lambda p: p["id"]), F.col("_next.id")))
        if transitions is not None:
            nxt = nxt.join(F.broadcast(transitions), (F.element_at("path", -1)["relation"] == F.col("first")) & (F.col("_next.relation") == F.col("then")), "left_semi")
        paths = nxt.select(F.concat("path", F.array("_next")).alias("path"))
        out = out.unionByName(paths)
    return out


def chains(links: DataFrame, first: str, second: str, support: str, least: float) -> DataFrame:
    """Links of one relation joined to the next on the middle node, and the best link
    that supports the ends directly, where there is one."""
    good = links.where(F.col("confidence") >= least)
    a = good.where(F.col("relation") == first).select(F.col("id").alias("a_id"), F.col("source").alias("head"), F.col("target").alias("mid"), F.col("confidence").alias("a_conf"))
    b = good.where(F.col("relation") == second).select(F.col("id").alias("b_id"), F.col("source").alias("mid"), F.col("target").alias("tail"), F.col("confidence").alias("b_conf"))
    s = good.where(F.col("relation") == support).groupBy(F.col("source").alias("head"), F.col("target").alias("tail")).agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("s_id"), F.max("confidence").alias("s_conf"))
    joined = a.join(b, "mid").join(s, ["head", "tail"], "left")
    return joined.withColumn("score", (F.col("a_conf") + F.col("b_conf")) / 2 + F.coalesce(0.1 * F.col("s_conf"), F.lit(0.0)))


def path_scores(path: Column, entities: list[str], wanted: str | None) -> list[Column]:
    """constraint .3, evidence .3, coherence .2, coverage .2."""
    n = F.size(path)
    total = lambda f: F.aggregate(path, F.lit(0.0), lambda s, p: s + f(p))
    constraint = total(lambda p: F.when(p["direction"] == wanted, 1.0).otherwise(0.0)) / n if wanted else F.lit(1.0)
    evidence = total(lambda p: p["confidence"]) / n
    pairs = F.zip_with(F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["target"] == b["source"], 1.0).otherwise(0.0))
    coherence = F.when(n < 2, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (n - 1))
    nodes = F.concat(F.transform(path, lambda p: p["source"]), F.transform(path, lambda p: p["target"]))

    def names(entity: str):
        return lambda x: x.contains(entity) | F.lit(entity).contains(x)

    covered = [F.when(F.exists(nodes, names(e)), 1.0).otherwise(0.0) for e in entities]
    coverage = sum(covered[1:], covered[0]) / len(entities) if entities else F.lit(1.0)
    score = constraint * 0.3 + evidence * 0.3 + coherence * 0.2 + coverage * 0.2
    return [constraint.alias("constraint_satisfaction"), evidence.alias("evidence_strength"), coherence.alias("semantic_coherence"), coverage.alias("entity_coverage"), score.alias("score")]


def classify(scored: DataFrame, share: float = 0.7) -> DataFrame:
    """Primary, supporting or conflicting, by the commonest first direction (ties by
    name) and the best score. Two aggregated rows stand beside all paths."""
    first = F.element_at("path", 1)["direction"]
    mode = scored.groupBy(first.alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("d", F.struct((-F.col("n")).alias("n"), "d")).alias("mode"))
    top = scored.agg(F.max("score").alias("top"))
    rows = scored.crossJoin(F.broadcast(mode)).crossJoin(F.broadcast(top))
    kind = F.when(first != F.col("mode"), "conflicting").when((F.col("score") >= F.col("top") * share) & (F.size("path") >= 2), "primary").otherwise("supporting")
    return rows.withColumn("chain_type", kind).drop("mode", "top")


def quota(scored: DataFrame, limits: dict[str, int], tie: Column) -> DataFrame:
    """The best of each class up to its quota."""
    rn = F.row_number().over(Window.partitionBy("chain_type").orderBy(F.desc("score"), tie))
    most = F.element_at(F.create_map(*[F.lit(x) for p in limits.items() for x in p]), F.col("chain_type"))
    return scored.withColumn("rank", rn).where(F.col("rank") <= most)


def greedy_paths(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """From each seed (node) one path of up to `depth` nodes: each step goes to the best
    neighbour (by confidence, then name) that the path hasn't visited, and ends where there is none.

    A path has visited fewer than `depth` other nodes, so the `depth` best neighbours of a node
    hold the one to take; no hub's neighbours are gathered beyond these."""
    ways = links.select(F.col("source").alias("a"), F.col("target").alias("b"), "confidence").union(links.select("target", "source", "confidence")).where("a <> b")
    best = ways.groupBy("a", "b").agg(F.max("confidence").alias("c"))
    near = best.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("_n") <= depth)
    near = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("_n", "b"))).alias("near"))
    paths = seeds.select("node", F.array("node").alias("path"))
    for _ in range(1, depth):
        met = paths.join(near, F.element_at("path", -1) == F.col("a"), "left")
        step = F.filter(F.transform("near", lambda x: x["b"]), lambda x: ~F.array_contains("path", x))
        paths = met.select("node", F.concat("path", F.coalesce(F.slice(step, 1, 1), F.slice("path", 1, 0))).alias("path"))
    return paths


def suppress(scored: DataFrame, group: str, members: str, score: str, k: int, overlap: float = 0.6, of_smaller: bool = False, reached: bool = False) -> DataFrame:
    """Greedily the best `k` rows of a group that don't share too many members with one
    taken before: more than a share of `overlap` of their own members, or of the smaller set's if
    `of_smaller`; or as many, if `reached`. All candidates of a group pass in order of score until
    `k` are taken; only the taken ones' members are held."""
    rows = scored.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col("id"), F.array_sort(F.array_distinct(members)).alias("m"))
    ordered = rows.repartition("g").sortWithinPartitions("g", F.desc("s"), F.desc("id"), F.desc("m"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered.mapInArrow(_greedy(k, overlap, of_smaller, reached), f"g {kinds['g']}, rank int, id {kinds['id']}, s {kinds['s']}").toDF(group, "rank", "id", "score")


def _greedy(k: int, overlap: float, of_smaller: bool, reached: bool):
    def repeats(own: frozenset, other: frozenset) -> bool:
        if not own or not other:
            return False
        share = len(own & other) / (min(len(own), len(other)) if of_smaller else len(own))
        return share >= overlap if reached else share > overlap

    def run(it):
        now, taken = None, None
        for b in it:
            groups, sets, at, ranks = b.column("g").to_pylist(), b.column("m"), [], []
            for i, g in enumerate(groups):
                if taken is None or g != now:
                    now, taken = g, []
                if len(taken) == k:
                    continue
                own = frozenset(sets[i].as_py() or ())
                if not any(repeats(own, y) for y in taken):
                    taken.append(own)
                    at.append(i)
                    ranks.append(len(taken))
            best = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([best.column("g"), pa.array(ranks, pa.int32()), best.column("id"), best.column("s")], names=["g", "rank", "id", "s"])

    return run


# ---- links from text -------------------------------------------------------------------------

# Patterns that name a factor, by kind, under their English keys.
PROCESS = {
    "growth_temp": [r"\btemperature\b", "温度", r"\d+\s*°c"],
    "growth_time": [r"\bgrowth.{0,5}(?:time|duration)\b", r"\btime\b", "生长时间"],
    "anneal_time": [r"\banneal", "退火"],
    "ar_flow": [r"\bar\b", "氩"],
    "h2_flow": [r"\bh2\b", "氢"],
    "c2h4_flow": [r"\bc2h4\b", "乙烯", r"\bethylene\b"],
    "fe_thickness": [r"\bfe\b", "铁", r"\bcatalyst\b", r"\biron\b"],
    "al2o3_thickness": ["al2o3", "氧化铝", "支撑层"],
}
MORPHOLOGY = {
    "alignment": [r"\balign", "取向", "对齐", "oriented"],
    "density": [r"\bdens", "密度", "覆盖率"],
    "diameter": [r"\bdiamet", "管径", "直径"],
    "curvature": [r"\bcurvat", "弯曲", "波曲", r"\bwav"],
    "tortuosity": [r"\btortuos", "曲折度"],
    "height": [r"\bheight\b", "高度", "mm-scale"],
}
PERFORMANCE = {
    "conductivity": [r"\bconductiv", r"\belectrical conductivity\b", r"\bspecific conductivity\b", r"\bconductance\b", "电导", "导电"],
    "resistivity": [r"\bresistiv", r"\belectrical resist", "电阻率"],
    "sheet_resistance": [r"\bsheet resistance\b", "方阻"],
    "tensile_strength": [r"\btensile\b", r"\bmechanical strength\b", r"\bultimate strength\b", r"\bstrength\b", "抗拉", "强度"],
    "modulus": [r"\bmodulus\b", r"\byoung'?s modulus\b", r"\belastic modulus\b", r"\bstiffness\b", "模量"],
}
MECHANISM = {
    "diffusion": [r"\bdiffusion\b", "扩散"],
    "catalyst_deactivation": [r"\bdeactivation\b", r"\bpoison", "失活", "中毒"],
    "catalyst_agglomeration": [r"\bripening\b", r"\bagglomer", r"\bsinter", "烧结", "团聚"],
    "growth_kinetics": [r"\bkinetic", r"\bactivation energy\b", "动力学"],
    "boundary_layer_effect": [r"\bboundary layer\b", "边界层"],
}
# Words that state a direction.
INCREASE = [
    "increase", "improve", "enhance", "rise", "提高", "增大", "增加", "改善",
    "promot", "stimulat", "boost", "facilitate", "favor", "促进",
    "higher", "greater", "longer", "larger", "better",
    "upscal", "elongat",
    "促进", "提高", "增强", "改善", "优化", "增加", "增大", "上升",
]
DECREASE = [
    "decrease", "reduce", "drop", "decline", "降低", "减小", "下降", "恶化",
    "inhibit", "suppress", "degrade", "deterior", "suppress", "抑制",
    "lower", "shorter", "smaller", "weaker",
    "deactiv", "poison", "失活", "中毒",
    "降低", "减小", "抑制", "下降", "减弱", "恶化", "退化", "抑制",
]
INVERSE = {"resistivity": "conductivity", "sheet_resistance": "conductivity"}
_KINDS = [("process_morphology", "process", "morphology", 0.0), ("process_mechanism", "process", "mechanism", 0.08), ("mechanism_morphology", "mechanism", "morphology", 0.08), ("morphology_performance", "morphology", "performance", 0.05), ("process_performance", "process", "performance", 0.03)]


def relations(pieces: DataFrame, key: str, column: str, lexicon: dict[str, dict[str, list[str]]] | None = None, up: list[str] = INCREASE, down: list[str] = DECREASE, mechanism_words: list[str] | None = None) -> DataFrame:
    """Links of every sentence that states a direction: all pairs of the factors it
    names, by kind; a link to the literature where it names a mechanism; and for links to an
    inverse property the same about its counterpart, turned round. Built-in functions only."""
    from tesserae.functions import text

    words = lexicon or {"process": PROCESS, "morphology": MORPHOLOGY, "performance": PERFORMANCE, "mechanism": MECHANISM}
    says = mechanism_words if mechanism_words is not None else ["mechanism", "机理"]
    s = pieces.select(key, F.posexplode(text.sentences(F.col(column))).alias("sentence", "s"))
    s = s.withColumn("direction", text.direction(F.col("s"), up, down)).where("direction IS NOT NULL")
    for kind, patterns in words.items():
        s = s.withColumn(kind, text.factors(F.col("s"), patterns))
    known = (F.size("mechanism") > 0) | (F.lower("s").rlike("|".join(says)) if says else F.lit(False))
    s = s.withColumn("known", known).withColumn("base", F.when(F.col("known"), 0.65).otherwise(0.55))

    def pairs(relation: str, a: str, b: str, more: float) -> Column:
        return F.flatten(F.transform(F.col(a), lambda x: F.transform(F.col(b), lambda y: F.struct(F.lit(relation).alias("relation"), F.concat(F.lit(f"{a}:"), x).alias("source"), F.concat(F.lit(f"{b}:"), y).alias("target"), F.least(F.col("base") + more, F.lit(0.95)).alias("confidence")))))

    first = F.coalesce(*[F.concat(F.lit(f"{k}:"), F.get(F.col(k), 0)) for k in ("mechanism", "process", "morphology", "performance")])
    told = F.when(F.col("known") & (F.size("process") + F.size("morphology") + F.size("performance") > 0), F.array(F.struct(F.lit("mechanism_evidence").alias("relation"), first.alias("source"), F.lit("evidence:literature").alias("target"), F.least(F.col("base") + 0.1, F.lit(0.98)).alias("confidence"))))
    found = F.concat(*[pairs(*k) for k in _KINDS], F.coalesce(told, F.slice(pairs(*_KINDS[0]), 1, 0)))
    links = s.select(key, "sentence", "direction", F.substring("s", 1, 320).alias("evidence"), F.explode(found).alias("l")).select(key, "sentence", "direction", "evidence", "l.*")
    turn = F.element_at(F.create_map(*[F.lit(x) for p in INVERSE.items() for x in p]), F.regexp_replace("target", "^[^:]*:", ""))
    inverse = F.when(F.col("relation").isin("morphology_performance", "process_performance"), turn)
    turned = F.when(F.col("direction") == "increase", "decrease").when(F.col("direction") == "decrease", "increase").otherwise(F.col("direction"))
    # A link and what follows from it leave together; one shuffle by signature finds those that are stated anyway.
    stated = F.struct("direction", "target", "confidence", F.lit(0).alias("derived"))
    derived = F.struct(turned.alias("direction"), F.concat(F.lit("performance:"), inverse).alias("target"), F.least(F.col("confidence") + 0.04, F.lit(0.9)).alias("confidence"), F.lit(1).alias("derived"))
    both = links.select(key, "sentence", "evidence", "relation", "source", F.explode(F.when(inverse.isNotNull(), F.array(stated, derived)).otherwise(F.array(stated))).alias("l")).select(key, "sentence", "evidence", "relation", "source", "l.*")
    signature = Window.partitionBy(key, "relation", "source", "target", "direction")
    first = F.row_number().over(signature.orderBy("derived", "sentence"))
    known = both.withColumn("_first", first).where("derived = 0 OR _first = 1")  # derived links come after all stated ones
    return known.select(key, "sentence", "direction", "evidence", "relation", "source", "target", "confidence")


def valid_facts(links: DataFrame) -> DataFrame:
    """Both ends named, not the same, well formed, of an allowed relation."""
    kinds = [k[0] for k in _KINDS] + ["mechanism_evidence"]
    form = "^(process|morphology|performance|mechanism|evidence):.{2,100}$"
    return links.where((F.col("source") != F.col("target")) & F.col("source").rlike(form) & F.col("target").rlike(form) & F.col("relation").isin(kinds))


def fact_to_link(source: Column, target: Column, direction: Column) -> list[Column]:
    """The relation two categories imply, and the canonical direction."""
    from tesserae.functions import text

    pair = F.concat_ws("_", text.category(source), text.category(target))
    allowed = [k[0] for k in _KINDS]
    way = F.when(direction.isin("positive", "promote", "enlarge", "increase"), "increase").when(direction.isin("negative", "inhibit", "reduce", "decrease"), "decrease").otherwise("nonlinear_or_tradeoff")
    return [F.when(pair.isin(allowed), pair).otherwise("mechanism_evidence").alias("relation"), way.alias("direction")]


def confidence_of(sentence: Column, source_bonus: Column, has_condition: Column, well_formed: Column, negated: Column) -> Column:
    """base, source, number, unit, condition and form, clamped to 0-1."""
    c = 0.5 + source_bonus + F.when(sentence.rlike(r"\d+\.?\d*"), 0.1).otherwise(0.0) + F.when(sentence.rlike("°C|℃|nm|min|h|sccm|Pa"), 0.1).otherwise(0.0)
    c = c + F.when(has_condition, 0.15).otherwise(0.0) + F.when(well_formed, 0.1).otherwise(0.0) - F.when(negated, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
