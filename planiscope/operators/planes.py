"""Half-space evaluation, orientation, families and selection."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from . import cells as cell_ops
from .cells import HalfSpace
from .graph import components
from .quantiles import percentiles

#: Half-spaces up to which families are joined up on the driver.
DRIVER_BANK = 4096

HALF_SPACES = "hs_id int, plane_id string, oriented_id string, feature int, threshold double, side int, n array<double>, b double"


def quantile_cuts(samples: DataFrame, features: list[str], count: int = 15, low: float = 0.2, high: float = 0.8, digits: int = 6) -> list[list[float]]:
    """Exact quantiles of every feature at `count` even steps, rounded; two scans."""
    row = percentiles(samples, features, [low + (high - low) * i / (count - 1) for i in range(count)]).first()
    return [[round(x, digits) for x in row[f]] for f in features]


def axis_half_spaces(cuts: list[list[float]]) -> list[HalfSpace]:
    """Both sides of every axis-aligned cut; planes are numbered feature by feature."""
    out, d = [], len(cuts)
    for f, own in enumerate(cuts):
        for t in own:
            plane = f"pl{len(out) // 2:04d}"
            n = tuple(1.0 if j == f else 0.0 for j in range(d))
            out += [HalfSpace(len(out), plane, n, -t, 1), HalfSpace(len(out) + 1, plane, n, -t, -1)]
    return out


def half_space_table(spark: SparkSession, bank: list[HalfSpace]) -> DataFrame:
    """The bank as a dimension table; a few hundred rows that exist on the driver anyway."""
    rows = []
    for h in bank:
        axis = [j for j, w in enumerate(h.n) if w]
        cut = -h.b / h.n[axis[0]] if len(axis) == 1 else None
        rows.append((h.hs_id, h.plane_id, h.oriented_id, axis[0] if len(axis) == 1 else None, cut, h.side, list(h.n), h.b))
    return spark.createDataFrame(rows, HALF_SPACES)


def normalized(planes: DataFrame, n: str = "n", b: str = "b") -> DataFrame:
    """Adds u and b_norm: normal and offset over the normal's length plus 1e-12."""
    from ..functions.geometry import norm

    size = norm(F.col(n)) + 1e-12
    return planes.withColumn("u", F.transform(n, lambda v: v / size)).withColumn("b_norm", F.col(b) / size)


def class_baseline(samples: DataFrame, label: str = "y") -> DataFrame:
    """(y, n, share) of every class."""
    counts = samples.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"))
    return counts.select("y", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def confusion(cells: DataFrame, size: int) -> DataFrame:
    """(hs_id, y, tp, fp, fn, tn) of every half-space of the bank and every class, from the cell histogram."""
    inside = cell_ops.membership(cells, size)
    totals = cells.groupBy("y").agg(F.sum("cnt").alias("pos"))
    classes = totals.select("y", "pos", F.sum("pos").over(Window.partitionBy()).alias("n"))
    spaces = cells.sparkSession.range(0, size, 1, 1).select(F.col("id").cast("int").alias("hs_id"))
    grid = spaces.crossJoin(F.broadcast(classes))  # a bank of hundreds by the classes
    out = grid.join(F.broadcast(inside.withColumnRenamed("k", "hs_id")), ["hs_id", "y"], "left").na.fill(0, ["cnt"])
    out = out.withColumn("region", F.sum("cnt").over(Window.partitionBy("hs_id")))
    tp, fp = F.col("cnt"), F.col("region") - F.col("cnt")
    fn = F.col("pos") - F.col("cnt")
    return out.select("hs_id", "y", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (F.col("n") - tp - fp - fn).alias("tn"))


def with_metrics(conf: DataFrame) -> DataFrame:
    """Adds the one-versus-rest metrics and the class score."""
    m = metrics.half_space(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    out = conf.select("*", *[v.alias(k) for k, v in m.items()])
    return out.withColumn("score", metrics.class_score(F.col("balacc"), F.col("lift"), F.col("recall"), F.col("precision")))


def best_class(scored: DataFrame, digits: int = 9) -> DataFrame:
    """(hs_id, best_class, best_score): the class of highest score, the smallest on ties within rounding."""
    order = Window.partitionBy("hs_id").orderBy(F.round("score", digits).desc(), "y")
    return scored.withColumn("rk", F.row_number().over(order)).filter("rk = 1").select("hs_id", F.col("y").alias("best_class"), F.col("score").alias("best_score"))


def region_entropy(conf: DataFrame) -> DataFrame:
    """(hs_id, entropy): natural-log entropy of the classes inside; 0 for an empty region."""
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    return conf.groupBy("hs_id").agg(F.coalesce(F.sum(F.when(F.col("tp") > 0, -p * F.log(p + 1e-12))), F.lit(0.0)).alias("entropy"))


def guardrails(scored: DataFrame, min_size: int = 20, min_lift: float = 1.05, min_gain: float = 0.01, min_purity: float = 0.0) -> DataFrame:
    """Half-space and class pairs that are large and better than the baseline."""
    return scored.filter((F.col("region_size") >= min_size) & ((F.col("lift") >= min_lift) | (F.col("precision") - F.col("baseline") >= min_gain)) & (F.col("precision") >= min_purity))


def top_per_class(scored: DataFrame, k: int = 200, digits: int = 9) -> DataFrame:
    """The k best of each class by score, ties by half-space id; adds rank."""
    order = Window.partitionBy("y").orderBy(F.round("score", digits).desc(), "hs_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def family_edges(spaces: DataFrame, jaccard: DataFrame | None, cos_min: float = 0.999, tau: float = 0.01, signed_min: float = 0.995, region_min: float = 0.8) -> DataFrame:
    """(a, b), a < b: half-spaces of one family, by angle, offset, support and, on the same side, shared region.

    `spaces` has u and b_norm, `jaccard` (a, b, jaccard) of regions. The bank is a small dimension table: the theta
    self-join never sees samples.
    """
    from ..functions.geometry import dot

    a, b = spaces.alias("a"), spaces.alias("b")
    cos = dot(F.col("a.u"), F.col("b.u"))
    sign = F.when(cos < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    support = lambda c: F.filter(F.transform(c, lambda v, i: F.when(F.abs(v) > 1e-9, i)), lambda v: v.isNotNull())
    sa, sb = support(F.col("a.u")), support(F.col("b.u"))
    shared = F.size(F.array_intersect(sa, sb)) / F.greatest(F.size(F.array_union(sa, sb)), F.lit(1))
    pairs = a.join(b, F.col("a.hs_id") < F.col("b.hs_id")).filter((F.abs(cos) >= cos_min) & (F.abs(F.col("a.b_norm") - sign * F.col("b.b_norm")) <= tau) & (shared >= 0.8) & (cos >= signed_min))
    pairs = pairs.select(F.col("a.hs_id").alias("a"), F.col("b.hs_id").alias("b"), (F.col("a.side") == F.col("b.side")).alias("same_side"))
    if jaccard is None:
        return pairs.select("a", "b")
    return pairs.join(jaccard, ["a", "b"], "left").filter(~F.col("same_side") | (F.coalesce("jaccard", F.lit(1.0)) >= region_min)).select("a", "b")


def region_jaccard(cells: DataFrame, size: int) -> DataFrame:
    """(a, b, jaccard) of the regions of every two half-spaces a < b, empty unions as 0."""
    ks = F.array_compact(F.array(*[F.when(cell_ops.holds(k), F.lit(k)) for k in range(size)]))
    per = cells.groupBy(*[c for c in cells.columns if c.startswith("m")]).agg(F.sum("cnt").alias("cnt")).select(ks.alias("ks"), "cnt")
    both = per.select(F.explode("ks").alias("a"), "ks", "cnt").select("a", F.explode(F.filter("ks", lambda v: v > F.col("a"))).alias("b"), "cnt").groupBy("a", "b").agg(F.sum("cnt").alias("both"))
    one = per.select(F.explode("ks").alias("k"), "cnt").groupBy("k").agg(F.sum("cnt").alias("n"))
    ids = cells.sparkSession.range(size).select(F.col("id").cast("int").alias("k")).join(one, "k", "left").na.fill(0)
    grid = ids.select(F.col("k").alias("a"), F.col("n").alias("na")).join(ids.select(F.col("k").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    out = grid.join(both, ["a", "b"], "left").na.fill(0)
    return out.select("a", "b", metrics.ratio(F.col("both"), F.col("na") + F.col("nb") - F.col("both")).alias("jaccard"))


def families(ids: DataFrame, edges: DataFrame, driver_bank: int = DRIVER_BANK) -> DataFrame:
    """(hs_id, family): family is the smallest id that edges reach.

    A bank of up to `driver_bank` half-spaces, which is a list on the driver to begin with, is joined up there; a larger
    one by star contraction, until nothing changes.
    """
    found = ids.limit(driver_bank + 1).collect()
    if len(found) <= driver_bank:
        label = {r["hs_id"]: r["hs_id"] for r in found}

        def root(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for e in edges.toLocalIterator():
            x, y = root(e["a"]), root(e["b"])
            label[max(x, y)] = min(x, y)
        return ids.sparkSession.createDataFrame([(x, root(x)) for x in label], "hs_id int, family int")
    roots = components(edges)
    return ids.join(roots, ids["hs_id"] == roots["node"], "left").select("hs_id", F.coalesce("root", "hs_id").cast("int").alias("family"))


def best_per_family_side(scored: DataFrame, spaces: DataFrame, family: DataFrame) -> DataFrame:
    """The half-space of highest global score of each family and side."""
    top = scored.groupBy("hs_id").agg(F.max(F.round("score", 9)).alias("score_global"))
    rows = top.join(spaces.select("hs_id", "side", "oriented_id"), "hs_id").join(family, "hs_id")
    order = Window.partitionBy("family", "side").orderBy(F.col("score_global").desc(), "hs_id")
    return rows.withColumn("rk", F.row_number().over(order)).filter("rk = 1").drop("rk")


def emit_regions(best: DataFrame, global_sides: str = "good") -> DataFrame:
    """Regions of the chosen half-spaces: their own side (good), the other one (opposite), or both, with region ids."""
    if global_sides not in ("good", "opposite", "both"):
        raise ValueError(f"global_sides: {global_sides}")
    sides = {"good": [1], "opposite": [-1], "both": [1, -1]}[global_sides]
    rows = best.select("*", F.explode(F.array(*[F.lit(s) for s in sides])).alias("turn")).withColumn("region_side", F.col("side") * F.col("turn"))
    order = Window.orderBy("hs_id", F.col("turn").desc())  # the bank's chosen rows, a small table
    return rows.withColumn("region_id", F.format_string("rg%05d", F.row_number().over(order) - 1)).drop("turn")


def pair_metrics(cells: DataFrame, size: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """Metrics and score of every half-space within the rows of two classes, for both of them."""
    out = None
    for a, b in pairs:
        one = with_metrics(confusion(cells.filter(F.col("y").isin(a, b)), size)).select(F.lit(a).alias("pair_a"), F.lit(b).alias("pair_b"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def pair_representatives(pair_scored: DataFrame, family: DataFrame) -> DataFrame:
    """Per pair and family the half-space that separates best: (score for a, best score) descending, then id."""
    best = pair_scored.groupBy("pair_a", "pair_b", "hs_id").agg(
        F.max(F.when(F.col("y") == F.col("pair_a"), F.round("score", 9))).alias("score_a"), F.max(F.round("score", 9)).alias("score_pair"), F.max_by("lift", F.struct(F.round("score", 9), -F.col("y"))).alias("best_lift"), F.max_by("y", F.struct(F.round("score", 9), -F.col("y"))).alias("best_class")
    )
    order = Window.partitionBy("pair_a", "pair_b", "family").orderBy(F.col("score_a").desc(), F.col("score_pair").desc(), "hs_id")
    return best.join(family, "hs_id").withColumn("rk", F.row_number().over(order))


def winners(representatives: DataFrame) -> DataFrame:
    """Representatives of a lift over 1 win; the others go with the rest."""
    return representatives.withColumn("wins", (F.col("rk") == 1) & (F.round("best_lift", 9) > 1))


def conjunction_counts(cells: DataFrame, ks: list[int]) -> DataFrame:
    """(y, pos, inside): rows of each class and those for which all predicates hold."""
    rule = F.lit(True)
    for k in ks:
        rule = rule & cell_ops.holds(k)
    return cells.groupBy("y").agg(F.sum("cnt").alias("pos"), F.sum(F.when(rule, F.col("cnt")).otherwise(0)).alias("inside"))


def inequality(n: list[float], b: float, side: int, names: list[str]) -> str:
    """Readable form of a half-space: one-dimensional cuts are solved, others stay a sum."""
    live = [(w, v) for w, v in zip(n, names, strict=True) if abs(w) > 1e-12]
    less = side >= 0
    if len(live) == 1:
        w, v = live[0]
        return f"{v} {'≤' if less == (w > 0) else '≥'} {-b / w:.6g}"
    if len(live) == 2:
        (w0, v0), (w1, v1) = live
        return f"{v1} {'≤' if less == (w1 > 0) else '≥'} {-w0 / w1:.6g}·{v0} + {-b / w1:.6g}"
    return " + ".join(f"{w:.6g}·{v}" for w, v in live) + f" + {b:.6g} {'≤' if less else '≥'} 0"


def inequality_column(feature: Column, threshold: Column, side: Column) -> Column:
    """The one-dimensional form for a table of axis-aligned cuts."""
    return F.concat(F.lit("x"), feature.cast("string"), F.when(side >= 0, F.lit(" ≤ ")).otherwise(F.lit(" ≥ ")), F.format_string("%.6f", threshold))


def class_pairs(classes: list[int]) -> list[tuple[int, int]]:
    return list(itertools.combinations(sorted(classes), 2))


def sliced(n: list[float], b: float, dims: list[int], reference: list[float]) -> tuple[list[float], float]:
    """A plane on some dimensions only: the others are fixed at a reference point, which moves the offset."""
    keep = set(dims)
    return [w if j in keep else 0.0 for j, w in enumerate(n)], b + sum(w * reference[j] for j, w in enumerate(n) if j not in keep)


def sketched(samples: DataFrame, bank: list[HalfSpace], features: list[str], key: str, share: float = 0.1, label: str = "y", **guard) -> DataFrame:
    """Guardrails on a sample of rows drawn by a digest of their key, then on all rows for the survivors: the second scan
    has the half-spaces that are left only."""
    part = samples.filter(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
    sketch = with_metrics(confusion(cell_ops.histogram(part, [h.column(features) for h in bank], label), len(bank)))
    alive = sorted({r["hs_id"] for r in guardrails(sketch, **guard).select("hs_id").distinct().collect()})  # ids of the bank
    if not alive:
        return guardrails(sketch, **guard).limit(0)
    own = [bank[i] for i in alive]
    full = with_metrics(confusion(cell_ops.histogram(samples, [h.column(features) for h in own], label), len(own)))
    ids = samples.sparkSession.createDataFrame(list(enumerate(alive)), "k int, bank_id int")
    return guardrails(full, **guard).join(F.broadcast(ids), F.col("hs_id") == F.col("k")).drop("k", "hs_id").withColumnRenamed("bank_id", "hs_id")


def greedy_conjunction(cells: DataFrame, size: int, target: int, most: int = 4, min_recall: float = 0.85, min_frac: float = 0.2, min_gain: float = 1e-3) -> list[int]:
    """Predicates added one by one while the balanced accuracy of their conjunction grows and recall and size hold."""

    def tried(chosen: list[int]) -> list[tuple[float, float, int, int]]:
        both = F.lit(True)
        for c in chosen:
            both = both & cell_ops.holds(c)
        inside = cell_ops.membership(cells.filter(both), size)
        rows = inside.groupBy("k").agg(F.sum(F.when(F.col("y") == target, F.col("cnt")).otherwise(0)).alias("tp"), F.sum("cnt").alias("n")).collect()
        return [(0.5 * (r["tp"] / pos + (neg - r["n"] + r["tp"]) / max(1, neg)), r["tp"] / pos, r["n"], r["k"]) for r in rows]

    totals = cells.agg(F.sum(F.when(F.col("y") == target, F.col("cnt")).otherwise(0)).alias("pos"), F.sum("cnt").alias("n")).first()
    pos, neg = max(1, totals["pos"] or 0), (totals["n"] or 0) - (totals["pos"] or 0)
    chosen: list[int] = []
    best, region = 0.0, totals["n"] or 0
    while len(chosen) < most:
        options = [o for o in tried(chosen) if o[3] not in chosen and o[1] >= min_recall and (not chosen or o[2] >= min_frac * region)]
        if not options:
            break
        score, _, n, k = max(options, key=lambda o: (round(o[0], 9), -o[3]))
        if score < best + min_gain:
            break
        chosen.append(k)
        best, region = score, n
    return chosen


def extracted(sources: list[DataFrame], spaces: DataFrame) -> DataFrame:
    """(y, oriented_id, plane_id, side, n, b, priority): planes proposed for a class by several sources (y, hs_id and
    priority), the first source and then the highest priority winning where they propose the same oriented plane."""
    out = None
    for place, rows in enumerate(sources):
        one = rows.select("y", "hs_id", "priority", F.lit(place).alias("source"))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("y", "oriented_id").orderBy("source", F.round("priority", 9).desc(), "hs_id")
    named = out.join(F.broadcast(spaces), "hs_id").withColumn("oriented_id", F.coalesce("oriented_id", F.md5(F.concat_ws(",", F.transform("n", lambda v: F.format_string("%.9f", v)), F.format_string("%.9f", F.col("b")), F.col("side").cast("string")))))
    return named.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("y", "oriented_id", "plane_id", "side", "n", "b", "priority", "source")


def completed(planes_: DataFrame, regions: DataFrame) -> DataFrame:
    """Fills n_norm, b_norm and side of planes from the geometry of the regions with their oriented ids; planes that stay
    without a normal are dropped."""
    own = regions.select("oriented_id", *[F.col(c).alias(f"_{c}") for c in ("n_norm", "b_norm", "side")])
    others = [c for c in planes_.columns if c not in ("oriented_id", "n_norm", "b_norm", "side")]
    out = planes_.join(own, "oriented_id", "left").select("oriented_id", *others, *[F.coalesce(c, f"_{c}").alias(c) for c in ("n_norm", "b_norm", "side")])
    return out.filter(F.col("n_norm").isNotNull() & F.col("b_norm").isNotNull())


def with_perfect_clones(cand: DataFrame, least: float = 0.999) -> DataFrame:
    """Candidates (plane_id, side, priority, precision) with the other side of near-perfect ones, just below them."""
    clones = cand.filter(F.col("precision") >= least).withColumn("side", -F.col("side")).withColumn("priority", F.col("priority") - 1e-6)
    return cand.withColumn("is_clone", F.lit(False)).unionByName(clones.withColumn("is_clone", F.lit(True)))


def enriched(planes_: DataFrame, measured: DataFrame, metrics_: tuple[str, ...] = ("precision", "recall", "f1", "lift")) -> DataFrame:
    """Fills metrics that a plane lacks from measured ones of the same id and class."""
    m = measured.select("hs_id", "y", *[F.col(c).alias(f"_{c}") for c in metrics_])
    return planes_.join(m, ["hs_id", "y"], "left").select("hs_id", "y", *[F.coalesce(c, f"_{c}").alias(c) for c in metrics_])


def augmented(planes_: DataFrame, extra: DataFrame, least: int = 200) -> DataFrame:
    """Planes, and of `extra` those with new oriented ids, in the order of these, until there are `least`."""
    need = max(0, least - planes_.count())
    new = extra.join(planes_.select("oriented_id"), "oriented_id", "left_anti")
    return planes_.unionByName(new.orderBy("oriented_id").limit(need).select(planes_.columns))
