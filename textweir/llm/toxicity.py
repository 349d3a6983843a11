"""Toxicity: a linear classifier whose scores are held still under swaps of identity terms."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_array, c, check_broadcast, checkpoint, distinct_in_rows, fresh, split_words, table

#: Labelled documents that a classifier is fitted on, at most; chosen by a hash of the id.
MAX_TRAINING_ROWS = 8_000
#: Features that a classifier may have, at most.
MAX_FEATURES = 4_000
#: Texts that a feature is in, and standard errors between its shares in the classes, at least.
MIN_SEEN, MIN_CONTRAST = 5, 6.0
#: Terms that stand for groups; those of one row may be swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"), ("immigrants", "natives", "refugees", "citizens"),
    ("disabled", "deaf", "blind"), ("old", "young", "elderly"), ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
)
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7)


def features_of(word: str) -> list[str]:
    """A word and its beginnings; beginnings are marked so that they don't meet words."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def swaps(words: set[str], terms=IDENTITY_TERMS) -> list[set[str]]:
    """The word set with each identity term in it replaced by each other term of its row."""
    return [words - {t} | {other} for row in terms for t in row if t in words for other in row if other != t]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    threshold: float = 0.5

    def logit(self, words) -> float:
        w = self.weights
        return self.bias + sum(w[f] for f in {f for x in words for f in features_of(x)} if f in w)

    def score(self, words) -> float:
        return float(1 / (1 + np.exp(-self.logit(words))))


def rows_of(words, kept: dict[str, int], terms=IDENTITY_TERMS) -> tuple[list[int], list[list[int]]]:
    """(features of a text's distinct words, its swaps' differences), by number; a feature that a swap takes away is k + 1, one
    that it adds -k - 1. A swap may change nothing."""
    have = Counter(k for w in words for f in features_of(w) if (k := kept.get(f)) is not None)
    words, out = set(words), []
    for row in terms:
        for t in row:
            if t in words:
                for other in row:
                    if other != t:
                        change = Counter({k: -1 for f in features_of(t) if (k := kept.get(f)) is not None})
                        if other not in words:
                            change.update(k for f in features_of(other) if (k := kept.get(f)) is not None)
                        gone = [k + 1 for k, n in change.items() if n < 0 and have[k] + n == 0]
                        out.append(gone + [-k - 1 for k, n in change.items() if n > 0 and have[k] == 0])
    return sorted(have), out


def train(cols: list, deltas: list, y: np.ndarray, d: int, strength: float = 1.0, l2: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float, float]:
    """(weights, bias, threshold) of a logistic regression with counterfactual logit pairing.

    The loss is the mean log loss, classes weighing alike, + strength * the mean squared difference between the
    logits of a text and of each of its swaps + l2 / 2 * the squared weights; full gradient steps with momentum from
    zero, so the same rows give the same weights. The threshold is where the fitted rows' balanced accuracy is
    best, the one next to 0.5 of equal ones.
    """
    flat = lambda lists, kind=np.int32: (np.fromiter((k for x in lists for k in x), kind), np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
    col, row = flat(cols)
    signed, pair = flat(deltas)
    sign, dcol, pairs = np.sign(signed).astype(float), np.abs(signed) - 1, max(len(deltas), 1)
    n, size = len(y), np.bincount(row, minlength=len(y))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    curve = 0.25 * float(np.bincount(col, weights=(share * (size + 1))[row], minlength=d).max(initial=0) + 1) + l2
    if len(signed):
        curve += 2 * strength * float((np.bincount(pair, minlength=pairs) ** 2).sum() / pairs)
    rate = 1.0 / curve
    w, b, vw, vb = np.zeros(d), 0.0, np.zeros(d), 0.0
    for _ in range(rounds):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        err = share * (1 / (1 + np.exp(-z)) - y)
        gw, gb = np.bincount(col, weights=err[row], minlength=d) + l2 * w, err.sum()
        if len(signed):
            change = np.bincount(pair, weights=sign * w[dcol], minlength=pairs)
            gw = gw + 2 * strength * np.bincount(dcol, weights=sign * change[pair], minlength=d) / pairs
        vw, vb = 0.95 * vw - rate * gw, 0.95 * vb - rate * gb
        w, b = w + vw, b + vb
    score = 1 / (1 + np.exp(-(np.bincount(row, weights=w[col], minlength=n) + b)))
    levels, at = np.unique(score, return_inverse=True)
    # by cut between levels: what of either class lies above
    above = lambda c: 1 - np.concatenate(([0], np.cumsum(np.bincount(at, weights=c, minlength=len(levels))))) / c.sum()
    quality = above(y) - above(1 - y)
    cuts = np.concatenate(([levels[0] / 2], (levels[1:] + levels[:-1]) / 2, [(levels[-1] + 1) / 2]))
    cuts, quality = np.append(cuts, 0.5), np.append(quality, quality[np.searchsorted(levels, 0.5)])
    top = cuts[quality >= quality.max() - 1e-12]
    return w, float(b), float(top[np.argmin(np.abs(top - 0.5))])


def _as_model(kept: dict[str, int], w: np.ndarray, b: float, threshold: float) -> ToxicityModel:
    weights = {f: float(w[k]) for f, k in kept.items() if abs(w[k]) > 1e-6}
    return ToxicityModel(weights, b, threshold) if weights else ToxicityModel({}, -30.0)


def contrast(in1, in0, n1: float, n0: float, sqrt=np.sqrt, absolute=np.abs):
    """How many standard errors a feature's shares in the two classes lie apart."""
    p = (in1 + in0) / (n1 + n0)
    return absolute(in1 / n1 - in0 / n0) / sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)


def fit_classifier(texts: list[set[str]], toxic: np.ndarray, terms=IDENTITY_TERMS, max_features: int = MAX_FEATURES, min_seen: int = MIN_SEEN, min_contrast: float = MIN_CONTRAST, **learning) -> ToxicityModel:
    """train() over sets of words that are at hand.

    Features are the max_features words and word beginnings, of those in min_seen texts, whose shares differ most
    between the classes, and all identity terms seen. Without both classes, or without a feature, nothing is toxic.
    """
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, -30.0)
    both = [Counter(f for t, v in zip(texts, y) if v == k for f in {f for w in t for f in features_of(w)}) for k in (1, 0)]
    value = {f: contrast(both[0][f], both[1][f], y.sum(), (1 - y).sum()) for f in both[0] | both[1] if both[0][f] + both[1][f] >= min_seen}
    best = sorted((f for f, z in value.items() if z > min_contrast), key=lambda f: (-value[f], f))[:max_features]
    kept = {f: k for k, f in enumerate(best)}
    for t in (t for r in terms for t in r):
        if both[0][t] + both[1][t]:
            kept.setdefault(t, len(kept))
    made = [rows_of(t, kept, terms) for t in texts]
    return _as_model(kept, *train([x for x, _ in made], [s for _, x in made for s in x], y, len(kept), **learning))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", terms=IDENTITY_TERMS, max_rows: int = MAX_TRAINING_ROWS, max_features: int = MAX_FEATURES, min_seen: int = MIN_SEEN, min_contrast: float = MIN_CONTRAST, **learning) -> ToxicityModel:
    """fit_classifier on the labelled documents of at most max_rows ids, those with the least hash; null ids, labels and
    texts are left out.

    Words and features are counted on the executors. To the driver come the features that are kept and, of each
    document, their numbers.
    """
    i, y, t = c(id_col).alias("i"), c(label_col).cast("int").alias("y"), c(text_col).alias("t")
    sample = labels.select(i, y).dropna().groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_rows)

    def words_of(batches):
        for batch in batches:
            for first, ends, codes, words in split_words(as_array(batch.column(2))):
                row, code, _ = distinct_in_rows(ends, codes, len(words))
                offsets = np.searchsorted(row, np.arange(len(ends)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(code)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, len(ends) - 1) for k in (0, 1)] + [lists], names=["i", "y", "words"])

    own = docs.select(i, t).dropna().join(F.broadcast(sample), "i").select(F.col("i").cast("string").alias("i"), "y", "t")
    own = checkpoint(own.mapInArrow(words_of, "i string, y int, words array<string>").withColumn("words", F.array_sort("words")).distinct())
    n1, n0 = own.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return ToxicityModel({}, -30.0)

    def counted(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for v, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in words for f in features_of(w)}:
                    at = seen.setdefault(f, [0, 0])
                    at[0 if v else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in (0, 1))], names=["f", "in1", "in0"])

    total = own.select("y", "words").mapInArrow(counted, "f string, in1 long, in0 long").groupBy("f").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))
    groups = [t for r in terms for t in r]
    total = total.filter((F.col("in1") + F.col("in0") >= min_seen) | F.col("f").isin(groups)).withColumn("z", contrast(F.col("in1"), F.col("in0"), float(n1), float(n0), F.sqrt, F.abs))
    best = total.filter((F.col("in1") + F.col("in0") >= min_seen) & (F.col("z") > min_contrast)).orderBy(F.desc("z"), "f").limit(max_features)
    kept = {r["f"]: k for k, r in enumerate(best.collect())}
    for r in total.filter(F.col("f").isin(groups)).orderBy("f").collect():
        kept.setdefault(r["f"], len(kept))

    def numbered(batches):
        for batch in batches:
            made = [rows_of(words, kept, terms) for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.list_(pa.int32())))], names=["i", "y", "cols", "deltas"])

    rows = own.mapInArrow(numbered, "i string, y int, cols array<int>, deltas array<array<int>>").orderBy("i", "cols").drop("i").toArrow()
    deltas = [s for x in rows["deltas"].to_pylist() for s in x]
    return _as_model(kept, *train([x.values.to_numpy(zero_copy_only=False) for x in rows["cols"]], deltas, rows["y"].to_numpy().astype(float), len(kept), **learning))


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity", most: int = 1_000_000) -> DataFrame:
    """Adds a struct (score, toxic) to every row, from the whole text; one narrow stage, the model being broadcast.

    Words are lower-cased, split at white space and freed of signs at their ends; how often one occurs doesn't
    matter. A null text and one without words aren't toxic and score 0. Rows stay; a clashing name gets a number.
    """
    check_broadcast(len(model.weights), most, "toxicity model")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score double, toxic boolean>")
    def judge(text: pa.Array) -> pa.Array:
        m, known = shared.value, shared.value.weights
        score = np.zeros(len(text))
        starts = {f for f in known if f.endswith("*")}
        shortest = min(PREFIXES)
        roots = {f[:shortest] for f in starts}
        for first, ends, codes, words in split_words(as_array(text)):
            # each word's features, by number; most words have none
            own: dict[str, int] = {}
            lists = []
            for w in words.to_pylist():
                if w in known or w[:shortest] in roots:
                    lists.append([own.setdefault(f, len(own)) for f in features_of(w) if f in known])
                else:
                    lists.append(())
            n = len(ends) - 1
            full = np.diff(ends) > 0
            logit = np.full(n, m.bias)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            if own:
                flat, begin = np.fromiter((k for x in lists for k in x), np.int64), np.cumsum(size) - size
                row, code, _ = distinct_in_rows(ends, codes, len(words))
                many = size[code]
                at = np.repeat(begin[code], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pair = np.unique(np.repeat(row, many) * len(own) + flat[at])
                w = np.fromiter((known[f] for f in own), float, len(own))
                logit += np.bincount(pair // len(own), weights=w[pair % len(own)], minlength=n)
            score[first : first + n] = np.where(full, 1 / (1 + np.exp(-logit)), 0.0)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(score >= m.threshold)], ["score", "toxic"])

    (out,) = fresh(df.columns, out_col)
    return df.withColumn(out, judge(c(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are found toxic, of all documents, with their scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.filter(F.col("toxicity")["toxic"]).select("doc_id", F.round(F.col("toxicity")["score"], 6).alias("score"), F.lit(True).alias("toxic"))
