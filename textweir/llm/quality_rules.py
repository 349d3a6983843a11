"""Quality rules: a decision list learned from labelled text statistics, applied as Spark conditionals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import c, fresh, table

#: Labelled rows that the list is learned from, at most; chosen by a hash of the id.
MAX_TRAINING_ROWS = 20_000
STATS = ("n_words", "mean_word", "symbol_share", "bar_share", "shout_share", "upper_share", "digit_share", "repeat_share", "line_variety")


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, STATS.index(self.stat)]
        return v > self.value if self.above else v <= self.value

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def text_stats(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all built-in expressions; null for a null text.

    repeat_share is the share of words that equal the word before them, line_variety that of distinct lines;
    neither falls as a clean text gets longer, as a share of distinct words would. Other shares are of
    characters, bar_share and shout_share of words.
    """
    words = F.array_remove(F.split(text, r"\s+"), "")
    n, chars = F.size(words), F.greatest(F.length(text), F.lit(1))
    lost = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    count = lambda sign: (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / F.greatest(n, F.lit(1))
    lines = F.split(text, "\n")
    same = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b)
    return {
        "n_words": n.cast("double"),
        "mean_word": chars / F.greatest(n, F.lit(1)),
        "symbol_share": lost(r"[$%&*#@^~<>{}=+_\\]+"),
        "bar_share": count("|"),
        "shout_share": count("!"),
        "upper_share": lost(r"\p{Lu}+"),
        "digit_share": lost("[0-9]+"),
        "repeat_share": (F.size(same) - F.size(F.array_remove(same, True))) / F.greatest(n, F.lit(1)),
        "line_variety": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def _cuts(v: np.ndarray, most: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Middles between neighbouring distinct values, and the gaps; of many, evenly spread ones and the widest."""
    u = np.unique(v)
    mid, gap = (u[1:] + u[:-1]) / 2, np.diff(u)
    if len(mid) > most:
        spread = np.linspace(0, len(mid) - 1, most // 2).astype(int)
        some = np.unique(np.concatenate((spread, np.argsort(-gap, kind="stable")[: most // 2])))
        mid, gap = mid[some], gap[some]
    return mid, gap


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the best condition until no good row is covered.

    Best is the greatest information gain (FOIL's) times the gap around the threshold in standard deviations of
    the good rows, 1 at most: a threshold in empty space is safer for good texts that the sample lacks.
    """
    rule: list[Condition] = []
    on, usual = np.ones(len(x), bool), x[~bad].std(axis=0) + 1e-9
    while (on & ~bad).any() and len(rule) < 6:
        p0, n0 = int((on & bad).sum()), int((on & ~bad).sum())
        best, gain = None, 1e-9
        for j, stat in enumerate(STATS):
            v, b = x[on, j], bad[on]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.concatenate(([0], np.cumsum(b[order])))
            for cut, gap in zip(*_cuts(v)):
                k = int(np.searchsorted(v, cut, side="right"))
                for above, p, total in ((False, pos[k], k), (True, p0 - pos[k], len(v) - k)):
                    if p:
                        g = p * (np.log2(p / total) - np.log2(p0 / (p0 + n0))) * min(1.0, gap / usual[j])
                        if g > gain * (1 + 1e-9):
                            best, gain = Condition(stat, above, float(cut)), g
        if best is None:
            break
        rule.append(best)
        on = on & best.holds(x)
    return tuple(rule)


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for condition in rule:
        on &= condition.holds(x)
    return on


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, held: np.ndarray) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on held rows; of equal ones, by all rows, then the shortest.

    Of conditions on the same side of the same statistic the last, which is the tightest, stays.
    """
    best, value = rule, (-2.0, -2.0)
    for k in range(len(rule), 0, -1):
        on = _covered(rule[:k], x)
        score = []
        for rows in (on & held, on):
            p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
            score.append((p - n) / (p + n) if p + n else -1.0)
        if tuple(score) >= value:
            best, value = rule[:k], tuple(score)
    return tuple({(r.stat, r.above): r for r in best}.values())


def learn_rules(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.99, min_covered: int = 5, most_rules: int = 32) -> list[Rule]:
    """Sequential covering: grow a rule for bad rows on two thirds, prune it on the rest, take it, drop what it covers.

    A rule counts if it covers min_covered bad rows and its precision over all rows left is min_precision; else it
    is grown once more, on all of them, and if that doesn't help, learning ends. Without both good and bad rows there are no rules. Rows with a statistic that
    isn't a number are left out. The same rows in the same order give the same rules.
    """
    good_rows = np.isfinite(x).all(axis=1)
    x, bad = x[good_rows], bad[good_rows].astype(bool)
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    while bad.any() and (~bad).any() and len(rules) < most_rules:
        for own in (~held, np.ones(len(x), bool)):
            rule = _prune(_grow(x[own], bad[own]), x, bad, held)
            on = _covered(rule, x)
            p = int((on & bad).sum())
            if rule and p >= min_covered and p >= min_precision * on.sum():
                break
        else:
            break
        rules.append(rule)
        x, bad, held = x[~on], bad[~on], held[~on]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS, **learning) -> list[Rule]:
    """Learns from at most max_rows labelled documents (label 0: bad), those with the least hash of the id.

    Null ids, labels and texts are left out. Repeated rows count once. The sample is joined by broadcast, its
    size being bounded, so that documents are scanned once and not shuffled.
    """
    i, y, t = c(id_col).alias("i"), c(label_col).cast("int").alias("y"), c(text_col).alias("t")
    sample = labels.select(i, y).dropna().groupBy("i").agg(F.min("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_rows)
    own = docs.select(i, t).dropna().join(F.broadcast(sample), "i")
    stats = own.select("i", "y", *(F.coalesce(v, F.lit(float("nan"))).alias(k) for k, v in text_stats(F.col("t")).items())).distinct()
    rows = stats.orderBy("i", *STATS).limit(2 * max_rows).toPandas()
    return learn_rules(rows[list(STATS)].to_numpy(float), rows["y"].to_numpy() == 0, **learning)


def rule_column(rules: list[Rule], stats: dict[str, Column]) -> Column:
    """Ordered conditionals: 0 where there are no words, else the 1-based place of the first rule that holds, else null."""
    out = F.when(F.coalesce(stats["n_words"], F.lit(0.0)) < 1, 0)
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for condition in rule:
            v = stats[condition.stat]
            holds = holds & (v > condition.value if condition.above else v <= condition.value)
        out = out.when(holds, k)
    return out


def apply_rules(df: DataFrame, rules: list[Rule], text_col: str = "text", out_col: str = "rule") -> DataFrame:
    """Adds the number of the rule that rejects a row, null for a row to keep; one narrow, built-in stage.

    A null or blank text is rejected by rule 0. Only the statistics that the rules ask for are computed. Rows
    stay as they are, repeated ones too. Where the table has out_col already, the new column gets a number.
    """
    used = {"n_words"} | {x.stat for rule in rules for x in rule}
    stats = {k: v for k, v in text_stats(c(text_col)).items() if k in used}
    held, out = fresh(df.columns, "__stats", out_col)
    with_stats = df.withColumn(held, F.struct(*(v.alias(k) for k, v in stats.items())))
    return with_stats.withColumn(out, rule_column(rules, {k: c(held)[k] for k in stats})).drop(held)


def keep_good(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Rows that no rule rejects, with the table's own columns."""
    (out,) = fresh(df.columns, "__rule")
    return apply_rules(df, rules, text_col, out).filter(c(out).isNull()).drop(out)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the rule that rejects it (null: none) and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    names = F.array(F.lit("no words"), *(F.lit(" and ".join(map(str, r))) for r in rules))
    out = apply_rules(docs, rules)
    return out.select("doc_id", F.col("rule").isNull().alias("keep"), "rule", F.get(names, F.col("rule")).alias("because"))
