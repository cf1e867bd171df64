"""Conjunction and union rules over a predicate bank, mined on the cell histogram.

A rule is a bit mask over at most 62 predicates. Candidate rules are a small table; every metric is a sum over cells that
contain the rule's mask, so nothing is joined with samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..storage import stored
from . import cells as cell_ops
from . import planes
from .cells import HalfSpace


def candidates(spaces: DataFrame, per_pair: int = 4, order: tuple[str, ...] = ("precision", "lift")) -> DataFrame:
    """Per class at most `per_pair` half-spaces of one axis, best first; `spaces` has y, feature, hs_id and metrics."""
    w = Window.partitionBy("y", "feature").orderBy(*[F.round(c, 9).desc() for c in order], "hs_id")
    return spaces.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= per_pair).drop("rk")


def conjunctions(cand: DataFrame, most: int = 3, limit: int = 5000) -> DataFrame:
    """(target, ks, mask): combinations of 1..most candidates of a class in lexicographic order, `limit` per size.

    A combination has one predicate per (feature, side), as a second one would be implied or empty.
    """
    base = cand.select(F.col("y").alias("target"), F.col("hs_id").alias("k"), "feature", "side")
    level = base.select("target", F.array("k").alias("ks"), F.array(F.concat_ws(":", "feature", "side")).alias("used"))
    out = level
    for _ in range(most - 1):
        nxt = base.select(F.col("target").alias("t"), "k", F.concat_ws(":", "feature", "side").alias("u"))
        level = level.join(nxt, (F.col("t") == F.col("target")) & (F.col("k") > F.element_at("ks", -1))).filter(~F.array_contains("used", F.col("u"))).select("target", F.concat("ks", F.array("k")).alias("ks"), F.concat("used", F.array("u")).alias("used"))
        out = out.unionByName(level)
    w = Window.partitionBy("target", F.size("ks")).orderBy("ks")
    mask = F.aggregate("ks", F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).select("target", "ks", mask.alias("mask"))


def holds(mask: Column, cell: Column) -> Column:
    return cell.bitwiseAND(mask) == mask


def evaluate(rules: DataFrame, cells: DataFrame, condition: Column | None = None) -> DataFrame:
    """Adds size, tp, positives, n and the metrics of every rule; `condition` tells membership (default: mask in m0)."""
    totals = cells.groupBy("y").agg(F.sum("cnt").alias("positives")).withColumn("n", F.sum("positives").over(Window.partitionBy()))
    per = cells.select("m0", "y", "cnt")
    keys = [c for c in rules.columns]
    hit = condition if condition is not None else holds(F.col("mask"), F.col("m0"))
    sums = F.broadcast(rules).join(per, hit).groupBy(*keys).agg(F.sum("cnt").alias("size"), F.sum(F.when(F.col("y") == F.col("target"), F.col("cnt")).otherwise(0)).alias("tp"))
    out = sums.join(F.broadcast(totals), F.col("target") == F.col("y")).drop("y")
    m = metrics.rule(F.col("size"), F.col("tp"), F.col("positives"), F.col("n"))
    return out.select("*", *[v.alias(k) for k, v in m.items()])


def supported(rules: DataFrame, min_support: int = 8) -> DataFrame:
    """Rules that are large enough and no worse than the class share."""
    return rules.filter((F.col("size") >= min_support) & (F.col("lift_precision") >= 1))


def accepted(rules: DataFrame, min_rel_f1: float = 0.01, min_abs_f1: float = 0.05, min_lift: float = 1.05, min_abs_precision: float = 0.05) -> DataFrame:
    base = F.col("baseline")
    return rules.filter((F.col("f1") >= F.greatest(base * (1 + min_rel_f1), base + min_abs_f1)) | (F.col("precision") >= F.greatest(base * min_lift, base + min_abs_precision)))


def order_key(digits: int = 9) -> list[Column]:
    return [F.round("f1", digits).desc(), F.round("lift_precision", digits).desc(), F.col("size").desc(), F.col("cost"), F.col("rule_key")]


def described(rules: DataFrame, features: DataFrame) -> DataFrame:
    """Adds num_planes, num_dims, cost and rule_key; `features` maps k to its feature."""
    each = rules.select("target", "ks", F.explode("ks").alias("k")).join(F.broadcast(features), "k").groupBy("target", "ks").agg(F.array_sort(F.collect_set("feature")).alias("dims"))
    out = rules.join(each, ["target", "ks"]).withColumn("num_planes", F.size("ks")).withColumn("num_dims", F.size("dims"))
    return out.withColumn("cost", F.col("num_dims") + 0.5 * F.col("num_planes")).withColumn("rule_key", F.concat_ws(",", F.transform("ks", lambda k: F.format_string("%03d", k))))


def with_floor(pool: DataFrame, kept: DataFrame, k: int = 3) -> DataFrame:
    """Kept rules, and for a class and dimensionality without any the k best of the pool, flagged is_floor."""
    have = kept.select("target", "num_dims").distinct()
    w = Window.partitionBy("target", "num_dims").orderBy(*order_key())
    floor = pool.join(have, ["target", "num_dims"], "left_anti").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")
    return kept.withColumn("is_floor", F.lit(False)).unionByName(floor.withColumn("is_floor", F.lit(True)))


def signatures(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """(target, ks, signature): digest of the sorted masks of the cells that a rule covers; equal regions are equal."""
    masks = cells.select("m0").distinct()
    hit = rules.select("target", "ks", "mask").join(masks, holds(F.col("mask"), F.col("m0")))
    return hit.groupBy("target", "ks").agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_list("m0")).cast("array<string>"))).alias("signature"))


def deduplicated(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """One rule per class and region: the cheapest, then the order of rules."""
    rows = rules.join(signatures(rules, cells), ["target", "ks"])
    w = Window.partitionBy("target", "signature").orderBy("cost", F.round("f1", 9).desc(), F.round("lift_precision", 9).desc(), F.col("size").desc(), "rule_key")
    return rows.withColumn("rk", F.row_number().over(w)).filter("rk = 1").drop("rk")


def truncated(rules: DataFrame, k: int = 50) -> DataFrame:
    w = Window.partitionBy("num_dims").orderBy(*order_key(), "target")
    return rules.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")


def pareto(rules: DataFrame) -> DataFrame:
    """Adds is_pareto: no rule of the class and dims is as good in cost, f1, precision and recall and better in one."""
    keys = ["target", "dims"]
    cols = ["cost", "f1", "precision", "recall"]
    a = rules.select(*keys, "rule_key", *[F.round(c, 9).alias(c) for c in cols]).alias("a")
    b = a.alias("b")
    as_good = (F.col("b.cost") <= F.col("a.cost")) & (F.col("b.f1") >= F.col("a.f1")) & (F.col("b.precision") >= F.col("a.precision")) & (F.col("b.recall") >= F.col("a.recall"))
    better = (F.col("b.cost") < F.col("a.cost")) | (F.col("b.f1") > F.col("a.f1")) | (F.col("b.precision") > F.col("a.precision")) | (F.col("b.recall") > F.col("a.recall"))
    free = a.join(b, (F.col("a.target") == F.col("b.target")) & (F.col("a.dims") == F.col("b.dims")) & as_good & better, "left_anti").select("target", "rule_key", F.lit(True).alias("is_pareto"))
    return rules.join(free, ["target", "rule_key"], "left").na.fill(False, ["is_pareto"])


def inclusion(rules: DataFrame, cells: DataFrame, condition: Column | None = None) -> DataFrame:
    """(target, general, special): regions that hold another's region, by cells; equal regions are not listed."""
    masks = cells.select("m0").distinct()
    own = rules.join(masks, condition if condition is not None else holds(F.col("mask"), F.col("m0"))).select("target", "rule_key", "m0")
    sizes = own.groupBy("target", "rule_key").agg(F.count("*").alias("n"))
    a, b = own.alias("a"), own.alias("b")
    both = a.join(b, (F.col("a.target") == F.col("b.target")) & (F.col("a.m0") == F.col("b.m0")) & (F.col("a.rule_key") != F.col("b.rule_key"))).groupBy(F.col("a.target").alias("target"), F.col("a.rule_key").alias("general"), F.col("b.rule_key").alias("special")).agg(F.count("*").alias("shared"))
    n = lambda name, alias: sizes.select("target", F.col("rule_key").alias(name), F.col("n").alias(alias))
    return both.join(n("special", "ns"), ["target", "special"]).join(n("general", "ng"), ["target", "general"]).filter("shared = ns and ng > ns").select("target", "general", "special")


def parents(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, rule_key, parent, d_f1, d_precision, d_recall): the cheapest more general rule, and the gains over it; null
    without one."""
    gains = ("f1", "precision", "recall")
    g = rules.select("target", F.col("rule_key").alias("general"), F.col("cost").alias("gc"), *[F.col(c).alias(f"g_{c}") for c in gains])
    best = edges.join(g, ["target", "general"]).groupBy("target", F.col("special").alias("rule_key")).agg(F.min(F.struct("gc", "general", *[f"g_{c}" for c in gains])).alias("p"))
    return rules.select("target", "rule_key", *gains).join(best, ["target", "rule_key"], "left").select("target", "rule_key", F.col("p.general").alias("parent"), *[(F.col(c) - F.col(f"p.g_{c}")).alias(f"d_{c}") for c in gains])


def unions(rules: DataFrame, cells: DataFrame, top: int = 10, limit: int = 2000, max_iou: float = 0.25, min_support: int = 8, min_f1_gain: float = 0.01, min_recall_gain: float = 0.03) -> DataFrame:
    """OR of two rules of a class and dims that overlap little and gain over the better one."""
    w = Window.partitionBy("target", "dims").orderBy(*order_key())
    best = rules.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top).select("target", "dims", "rule_key", "mask", "f1", "recall", "rk")
    a, b = best.alias("a"), best.alias("b")
    pw = Window.partitionBy("target", "dims").orderBy("ra", "rb")
    pairs = a.join(b, (F.col("a.target") == F.col("b.target")) & (F.col("a.dims") == F.col("b.dims")) & (F.col("a.rk") < F.col("b.rk"))).select(
        F.col("a.target").alias("target"), F.col("a.dims").alias("dims"), F.col("a.rule_key").alias("key_a"), F.col("b.rule_key").alias("key_b"), F.col("a.mask").alias("mask_a"), F.col("b.mask").alias("mask_b"), F.col("a.rk").alias("ra"), F.col("b.rk").alias("rb"), F.greatest("a.f1", "b.f1").alias("best_f1"), F.greatest("a.recall", "b.recall").alias("best_recall")
    )
    pairs = pairs.withColumn("rn", F.row_number().over(pw)).filter(F.col("rn") <= limit).drop("ra", "rb", "rn")
    in_a, in_b = holds(F.col("mask_a"), F.col("m0")), holds(F.col("mask_b"), F.col("m0"))
    both = F.broadcast(pairs).join(cells, in_a & in_b).groupBy("target", "key_a", "key_b").agg(F.sum("cnt").alias("both"))
    out = evaluate(pairs, cells, in_a | in_b).join(both, ["target", "key_a", "key_b"], "left").na.fill(0, ["both"])
    out = out.withColumn("iou", F.col("both") / F.greatest("size", F.lit(1)))
    gain = (F.col("f1") >= F.col("best_f1") + min_f1_gain) | ((F.col("recall") >= F.col("best_recall") + min_recall_gain) & (F.col("precision") >= F.col("baseline")))
    return out.filter((F.col("iou") <= max_iou) & (F.col("size") >= min_support) & gain & (F.col("lift_precision") >= 1))


def rule_text(rules: DataFrame, spaces: DataFrame, cells: DataFrame, digits: int = 2) -> DataFrame:
    """(target, rule_key, rule_text): the cuts of a rule by feature, those from below and above merged to an interval;
    cuts that hold for every row say nothing and are left out. `spaces` has k, feature, side and threshold."""
    n = cells.agg(F.sum("cnt").alias("n"))
    k = F.explode("ks").alias("k")
    inside = rules.select(F.explode("ks").alias("k")).distinct().join(cells.select("m0", "cnt"), cells["m0"].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))) != 0).groupBy("k").agg(F.sum("cnt").alias("size"))
    telling = spaces.join(inside, "k").join(n, F.col("size") < F.col("n")).select("k", "feature", "side", "threshold")
    each = rules.select("target", "rule_key", k).join(F.broadcast(telling), "k")
    cut = lambda side, best: best(F.when(F.col("side") == side, F.col("threshold")))
    per = each.groupBy("target", "rule_key", "feature").agg(cut(-1, F.max).alias("low"), cut(1, F.min).alias("up"))
    show = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    name = F.concat(F.lit("x"), F.col("feature").cast("string"))
    piece = F.when(F.col("low").isNull(), F.concat(name, F.lit(" ≤ "), show("up"))).when(F.col("up").isNull(), F.concat(name, F.lit(" ≥ "), show("low"))).otherwise(F.concat(show("low"), F.lit(" ≤ "), name, F.lit(" ≤ "), show("up")))
    text = per.groupBy("target", "rule_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature", piece.alias("t")))), lambda x: x["t"]), "  AND  ").alias("rule_text"))
    return rules.select("target", "rule_key").join(text, ["target", "rule_key"], "left").na.fill("everything", ["rule_text"])


def mine(cand: DataFrame, cells: DataFrame, features: DataFrame, most: int = 3, keep: int = 50, min_support: int = 8, limit: int = 5000, with_unions: bool = True, relations: bool = True, **accept) -> DataFrame:
    """Rules from candidates to their final order: conjunctions of up to `most` predicates, support, acceptance, floor,
    dedup, unions, the `keep` best of each dimensionality, Pareto flags, and each rule's parent with the gains over it.

    kind is "and" or "or"; the key of a union joins those of its two rules by " | ". Few thousand rules at most: steps
    that several others read are written once.
    """
    pool = stored(described(supported(evaluate(conjunctions(cand, most, limit), cells), min_support), features), "pool")
    rules = stored(deduplicated(with_floor(pool, accepted(pool, **accept)), cells).withColumn("kind", F.lit("and")), "rules")
    columns = ["target", "kind", "rule_key", "dims", "num_dims", "num_planes", "cost", "is_floor", "size", "tp", "precision", "recall", "f1", "baseline", "lift_precision", "mask"]
    out = rules.select(*columns, F.lit(None).cast("long").alias("mask_b"))
    if with_unions:
        sizes = lambda side: rules.select("target", F.col("rule_key").alias(f"key_{side}"), F.col("num_planes").alias(f"n_{side}"), "num_dims")
        both = unions(rules, cells).join(sizes("a"), ["target", "key_a"]).join(sizes("b").drop("num_dims"), ["target", "key_b"])
        both = both.withColumn("num_planes", F.col("n_a") + F.col("n_b")).withColumn("cost", F.col("num_dims") + 0.5 * F.col("num_planes"))
        both = both.select("*", F.lit("or").alias("kind"), F.concat_ws(" | ", "key_a", "key_b").alias("rule_key"), F.lit(False).alias("is_floor"), F.col("mask_a").alias("mask"))
        out = out.unionByName(both.select(out.columns))
    out = stored(pareto(truncated(out, keep)), "rules")
    if not relations:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("parent", "string"), ("d_f1", "double"), ("d_precision", "double"), ("d_recall", "double"))]
        return ordered(out).select("*", *none)
    inside = holds(F.col("mask"), F.col("m0")) | F.coalesce(holds(F.col("mask_b"), F.col("m0")), F.lit(False))
    return ordered(out.join(parents(out, inclusion(out, cells, inside)), ["target", "rule_key"]))


def ordered(rules: DataFrame) -> DataFrame:
    """Adds place: the final order within a dimensionality."""
    w = Window.partitionBy("num_dims").orderBy(F.col("is_pareto").desc(), *order_key(), "target")
    return rules.withColumn("place", F.row_number().over(w))


PRESETS = {
    "default": {},
    "deterministic": {"with_unions": False, "relations": False},
    "support_first": {"most": 2, "min_support": 20, "min_rel_f1": 0.1, "min_abs_precision": 0.02, "limit": 2000},
    "precision_boost": {"min_abs_precision": 0.1, "min_lift": 1.5, "min_rel_f1": 0.1, "with_unions": False},
}


def search(samples: DataFrame, bank: list[HalfSpace], features: list[str], label: str = "y", preset: str = "default", per_pair: int = 4, **options) -> DataFrame:
    """Mined rules straight from samples and a bank of at most 62 half-spaces: one scan, then the histogram alone."""
    if preset not in PRESETS:
        raise ValueError(f"preset: {preset}")
    if len(bank) > cell_ops.BITS:
        raise ValueError(f"a bank of {len(bank)} half-spaces; a rule's mask holds {cell_ops.BITS}")
    cells = stored(cell_ops.histogram(samples, [h.column(features) for h in bank], label), "cells")
    spaces = planes.half_space_table(samples.sparkSession, bank).select("hs_id", "feature", "side")
    guarded = planes.guardrails(planes.with_metrics(planes.confusion(cells, len(bank)))).join(spaces, "hs_id")
    cand = stored(candidates(guarded, per_pair), "candidates")
    return mine(cand, cells, spaces.select(F.col("hs_id").alias("k"), "feature"), **(PRESETS[preset] | options))


def beam(cand: DataFrame, cells: DataFrame, depth: int = 7, width: int = 16, min_size: int = 5, metric: str = "precision", lift_min: float = 1.0) -> DataFrame:
    """Beam search: per class the `width` best rules of each depth up to `depth`, extended only by predicates of later rank.

    Ranked by (metric, weighted relative accuracy, region share, lift), ties by the rule's places. Singles of lift over
    lift_min seed the beam if there are any, else all do. One join with the cells per depth; nothing is collected.
    """
    if metric not in ("precision", "recall", "f1", "lift"):
        raise ValueError(f"metric: {metric}")
    singles = cand.select(F.col("y").alias("target"), F.col("hs_id").alias("k"), F.col("pos"))
    totals = cells.groupBy("y").agg(F.sum("cnt").alias("positives")).withColumn("n", F.sum("positives").over(Window.partitionBy()))

    def measured(level: DataFrame) -> DataFrame:
        sums = F.broadcast(level).join(cells.select("m0", "y", "cnt"), holds(F.col("mask"), F.col("m0"))).groupBy("target", "places", "ks", "mask").agg(F.sum("cnt").alias("size"), F.sum(F.when(F.col("y") == F.col("target"), F.col("cnt")).otherwise(0)).alias("tp"))
        out = sums.filter(F.col("size") >= min_size).join(F.broadcast(totals), F.col("target") == F.col("y")).drop("y")
        m = metrics.beam(F.col("size"), F.col("tp"), F.col("positives"), F.col("n"))
        return out.select("*", *[v.alias(c) for c, v in m.items()])

    def best(level: DataFrame) -> DataFrame:
        w = Window.partitionBy("target").orderBy(F.round(metric, 9).desc(), F.round("wracc", 9).desc(), F.round("region_frac", 9).desc(), F.round("lift", 9).desc(), "places")
        return level.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= width)

    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    first = measured(singles.select("target", F.array("pos").alias("places"), F.array("k").alias("ks"), bit(F.col("k")).alias("mask")))
    good = F.max(F.when(F.round("lift", 9) > lift_min, 1).otherwise(0)).over(Window.partitionBy("target"))
    level = best(first.withColumn("any", good).filter((F.col("any") == 0) | (F.round("lift", 9) > lift_min)).drop("any"))
    # each depth is written: a few rules for each class, read by the next depth and the result, with a plan that stays short
    level = stored(level, "beam")
    out = level.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        nxt = singles.select(F.col("target").alias("t"), F.col("k"), F.col("pos"))
        wider = level.join(nxt, (F.col("t") == F.col("target")) & (F.col("pos") > F.element_at("places", -1))).select("target", F.concat("places", F.array("pos")).alias("places"), F.concat("ks", F.array("k")).alias("ks"), F.col("mask").bitwiseOR(bit(F.col("k"))).alias("mask"))
        level = stored(best(measured(wider)), "beam")
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out


def one_per_region(rules: DataFrame, cells: DataFrame, metric: str = "precision") -> DataFrame:
    """Of a class's rules that cover the same cells the best ranked one."""
    rows = rules.join(signatures(rules, cells), ["target", "ks"])
    w = Window.partitionBy("target", "signature").orderBy(F.round(metric, 9).desc(), F.round("wracc", 9).desc(), F.round("region_frac", 9).desc(), F.round("lift", 9).desc(), "places")
    return rows.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk", "signature")


def assembled(rules: DataFrame, features: DataFrame, floor: int = 12, metric: str = "precision") -> DataFrame:
    """Adds num_dims (columns that a rule's planes use together) and is_floor: the best of each class and num_dims."""
    each = rules.select("target", "ks", F.explode("ks").alias("k")).join(F.broadcast(features), "k").groupBy("target", "ks").agg(F.count_distinct("feature").cast("int").alias("num_dims"))
    w = Window.partitionBy("target", "num_dims").orderBy(F.round(metric, 9).desc(), F.round("wracc", 9).desc(), F.round("region_frac", 9).desc(), F.round("lift", 9).desc(), "places")
    return rules.join(each, ["target", "ks"]).withColumn("is_floor", F.row_number().over(w) <= floor)


def found_by_beam(cand: DataFrame, cells: DataFrame, features: DataFrame, depth: int = 7, metric: str = "precision", width: int = 16, min_size: int = 5, lift_min: float = 1.0, most_candidates: int = 150, most_rules: int = 60, floor: int = 12) -> DataFrame:
    """The beam's rules to their final table: ranked candidates, beam, skyline flags, one rule for each region, the `most_rules`
    best of a class, dimensionality and floors, and each rule's parent in the lattice of predicate sets."""
    w = Window.partitionBy("y").orderBy(F.round("precision", 9).desc(), F.round("lift", 9).desc(), "hs_id")
    ranked = cand.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most_candidates)
    rules = stored(beam(ranked, cells, depth, width, min_size, metric, lift_min), "rules")
    flagged = rules.join(skyline(rules).select("target", "ks", F.lit(True).alias("is_skyline")), ["target", "ks"], "left").na.fill(False, ["is_skyline"])
    best = Window.partitionBy("target").orderBy(F.round(metric, 9).desc(), F.round("wracc", 9).desc(), F.round("region_frac", 9).desc(), F.round("lift", 9).desc(), "places")
    own = one_per_region(flagged, cells, metric).withColumn("_rk", F.row_number().over(best)).filter(F.col("_rk") <= most_rules).drop("_rk")
    own = stored(own, "own")
    return assembled(own, features, floor, metric).join(plane_set_parents(own), ["target", "ks"])


def found_by_beams(cand: DataFrame, cells: DataFrame, features: DataFrame, by: tuple[str, ...] = ("precision", "recall", "f1", "lift"), **options) -> DataFrame:
    """The beam once for each ranking metric; of a rule found twice the first metric's row stays, named in found_by."""
    out = None
    for place, metric in enumerate(by):
        one = found_by_beam(cand, cells, features, metric=metric, **options).withColumn("found_by", F.lit(metric)).withColumn("_turn", F.lit(place))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("target", "ks").orderBy("_turn")
    return out.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk", "_turn")


def skyline(rules: DataFrame) -> DataFrame:
    """Rules that no other of the class dominates in precision, recall and size."""
    a = rules.select("target", "ks", F.round("precision", 9).alias("p"), F.round("recall", 9).alias("r"), "size").alias("a")
    b = a.alias("b")
    dominated = (F.col("a.target") == F.col("b.target")) & (F.col("b.p") >= F.col("a.p")) & (F.col("b.r") >= F.col("a.r")) & (F.col("b.size") >= F.col("a.size")) & ((F.col("b.p") > F.col("a.p")) | (F.col("b.r") > F.col("a.r")) | (F.col("b.size") > F.col("a.size")))
    return rules.join(a.join(b, dominated, "left_anti").select("target", "ks"), ["target", "ks"], "left_semi")


def plane_set_parents(rules: DataFrame) -> DataFrame:
    """(target, ks, parent): the largest proper subset of a rule's predicates among the rules, ties by its places."""
    a, b = rules.select("target", "ks", "mask", "places").alias("a"), rules.select("target", "ks", "mask", "places").alias("b")
    sub = (F.col("a.target") == F.col("b.target")) & (F.col("a.mask") != F.col("b.mask")) & (F.col("a.mask").bitwiseAND(F.col("b.mask")) == F.col("b.mask"))
    best = a.join(b, sub).groupBy(F.col("a.target").alias("target"), F.col("a.ks").alias("ks")).agg(F.min(F.struct((-F.size("b.ks")).alias("s"), F.col("b.places").alias("o"), F.col("b.ks").alias("parent"))).alias("p"))
    return rules.select("target", "ks").join(best, ["target", "ks"], "left").select("target", "ks", F.col("p.parent").alias("parent"))


def ruleset(rules: list[dict], budget: int = 7, metric: str = "precision") -> list[dict]:
    """Greedy union of rules (metric, lift, size) within a budget of predicates; rules that do not fit are passed over."""
    out, used = [], 0
    for r in sorted(rules, key=lambda r: (-round(r[metric], 9), -round(r["lift"], 9), -r["size"], r["ks"])):
        if used + len(r["ks"]) <= budget:
            out.append(r)
            used += len(r["ks"])
    return out
