"""Quality rules as learned decision lists, in DataFrame expressions only.

Sequential covering: a rule is grown condition by condition (the threshold of most FOIL gain), pruned from its end on
rows that it was not grown on, accepted if it stays precise there, and the rows it covers leave before the next rule is
sought. Rows are never collected; each step is one aggregate of counts per feature and bin. The list is an ordered
conditional expression that Spark evaluates with the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_TO_BLANK = ("\t\n\x0b\x0c\r", "     ")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep`, counts): word, symbol, line and repetition counts of every whole text, null as empty.

    n_repeat_words counts the words inside three-word windows that occur twice or more in the text; windows are told apart
    by 64-bit hashes within one text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    blank = F.translate("_t", *_TO_BLANK)
    rows = rows.select("*", F.array_remove(F.split(blank, " ", -1), "").alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: F.trim(F.translate(x, *_TO_BLANK)) != "").alias("_l"))
    rows = rows.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " " + _TO_BLANK[0], "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.char_length("_t") - F.char_length(F.translate("_t", _UPPER, ""))).cast("long").alias("n_upper"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "!?.,;:", ""))).cast("long").alias("n_marks"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.when(F.size("_w") < 3, F.expr("cast(array() as array<struct<k:bigint,p:int>>)"))
        .otherwise(F.sort_array(F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("k"), i.alias("p")))))
        .alias("_s"),
    ).drop("_t", "_w", "_l")
    key = lambda i: F.get("_s", i).getField("k")
    twice = F.filter("_s", lambda x, i: F.coalesce(x["k"] == key(i + 1), F.lit(False)) | F.coalesce(x["k"] == key(i - 1), F.lit(False)))
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda x: x["p"])).alias("_p")).drop("_s")
    covered = F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1), x + 3) - x))
    return rows.select("*", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "words_per_line": _share("n_words", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "distinct_share": _share("n_distinct_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # '>=' or '<'
    threshold: float

    def column(self) -> Column:
        f = features()[self.feature]
        return f >= self.threshold if self.op == ">=" else f < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_of(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list rejects: rules are tried in order, the first that holds decides."""
    out = None
    for rule in rules:
        out = F.when(all_of(rule), F.lit(False)) if out is None else out.when(all_of(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = 20_000) -> DataFrame:
    """Statistics and label (`good`) of some `bound` labelled documents, chosen by a hash of the id; stored."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    total = own.count()
    part = own.filter(F.pmod(F.xxhash64(F.col("_id").cast("long")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, bound / max(1, total)))).groupBy("_id").agg(F.min("_y").alias("_y"))
    part = stored(part, "labels")
    if part.count() <= 2 * bound:  # 16 bytes a row
        part = F.broadcast(part)
    joined = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(part, F.col("_doc").cast("long") == F.col("_id"))
    return stored(statistics(joined, "_doc", "_text", keep=("_y",)).withColumn("good", F.col("_y") > 0), "statistics")


def learn(train: DataFrame, bins: int = 24, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_rows: int = 10) -> list[Rule]:
    """Rules that recognise rejected rows, in order, from statistics with a boolean column `good`.

    Two thirds of the rows, by a hash of their id, grow rules; the others prune and judge them. Thresholds are
    quantiles of all rows and of the rejected ones. Ties go to the feature, direction and threshold that come first.
    Without rows of both labels the list is empty.
    """
    names = list(features())
    bad = ~F.col("good")
    rows = train.select(*[f.alias(n) for n, f in features().items()], bad.alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"))
    totals = rows.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return []
    at = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    cuts = rows.agg(*[F.percentile(n, at).alias(f"a{i}") for i, n in enumerate(names)], *[F.percentile(F.when(F.col("bad"), F.col(n)), at).alias(f"b{i}") for i, n in enumerate(names)]).first()
    grid = {n: sorted({*cuts[f"a{i}"], *cuts[f"b{i}"]}) for i, n in enumerate(names)}

    def bin_of(n: str) -> Column:
        value = F.col(n)
        return F.size(F.filter(F.array(*[F.lit(x) for x in grid[n]]), lambda t: t <= value)).alias(f"bin_{n}")

    place = [bin_of(n) for n in names]
    rows = stored(rows.select("bad", "grow", *place), "bins")

    def holds(rule: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for n, op, i in rule:  # value >= grid[i] if and only if the bin is over i
            out = out & (F.col(f"bin_{n}") > i if op == ">=" else F.col(f"bin_{n}") <= i)
        return out

    def histogram(where: Column) -> dict[str, dict[int, tuple[int, int]]]:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"bin_{n}").alias("b")) for n in names]))
        found = rows.filter(where).select("bad", each.alias("e")).groupBy("e.f", "e.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in found:
            out[r["f"]][r["b"]] = (r["p"], r["n"])
        return out

    rules, left = [], F.lit(True)
    for _ in range(max_rules):
        rule: list[tuple[str, str, int]] = []
        for _ in range(max_conditions):
            hist = histogram(left & F.col("grow") & holds(rule))
            p0, n0 = (sum(x[i] for x in hist[names[0]].values()) for i in (0, 1))
            if p0 < min_rows or not n0:
                break
            best, chosen = 1e-9, None
            for n in names:
                for i in range(len(grid[n])):
                    high = [sum(v[j] for b, v in hist[n].items() if b > i) for j in (0, 1)]
                    for op, (p, q) in ((">=", high), ("<", [p0 - high[0], n0 - high[1]])):
                        gain = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0))) if p >= min_rows else 0.0
                        if gain > best * (1 + 1e-9):
                            best, chosen = gain, (n, op, i)
            if chosen is None:
                break
            rule.append(chosen)
        if not rule:
            break
        prefixes = [holds(rule[: k + 1]) for k in range(len(rule))]
        judged = rows.filter(left & ~F.col("grow")).agg(*[F.count_if(h & F.col("bad")).alias(f"p{k}") for k, h in enumerate(prefixes)], *[F.count_if(h & ~F.col("bad")).alias(f"n{k}") for k, h in enumerate(prefixes)]).first()
        worth = [(judged[f"p{k}"] - judged[f"n{k}"]) / max(1, judged[f"p{k}"] + judged[f"n{k}"]) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = judged[f"p{k}"], judged[f"n{k}"]
        if p < max(1, min_rows // 4) or p / (p + n) < min_precision:
            break
        rules.append(tuple(Condition(f, op, grid[f][i]) for f, op, i in rule[: k + 1]))
        left = left & ~holds(rule[: k + 1])
    return rules


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics, base_failed, kept) of every row: kept unless the base fails or a rule rejects.

    Null and blank texts have no words and fail the base. Repeated rows repeat their result, an empty table gives none,
    other columns are left out whatever their names.
    """
    return statistics(docs, id_col, text_col).select("*", base_failed().alias("base_failed")).select("*", (~F.col("base_failed") & verdict(rules)).alias("kept"))
