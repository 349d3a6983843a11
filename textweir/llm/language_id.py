"""Language identification: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_array, c, check_broadcast, checkpoint, fresh, release_memory, split_words, table, text_batches

#: Labelled documents that a model is fitted on, at most; chosen by a hash of the id.
MAX_TRAINING_ROWS = 8_000
#: Cost of what a language hasn't been seen with, as -log10 of a relative frequency.
PENALTY = 7.0
MAX_N = 4
MIN_MARGIN = 0.002
#: Share of the fitted documents' usual margin that a text needs.
MARGIN_SHARE = 0.4
#: Words whose costs a task remembers, at most; 16 bytes and the word each. Others are worked out again.
_CACHED = 200_000


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a space at either end; the space alone, which all words have, is none."""
    w = f" {word} "
    return [g for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " "]


@dataclass
class LanguageModel:
    """rows[n] holds the numbers of the n-grams, rows[0] those of words; costs is their table (float32), by number and language.

    least_margin and most_cost are the bounds by language within which a text is accepted; None for no bounds.
    """

    languages: list[str]
    rows: list[dict[str, int]]
    costs: np.ndarray
    least_margin: np.ndarray | None = None
    most_cost: np.ndarray | None = None

    def rows_of(self, word: str) -> list[int]:
        """Numbers of what a word's cost is the mean of: the word itself, else those n-grams of the longest length that has any."""
        known = self.rows[0].get(word)
        if known is not None:
            return [known]
        for n in range(len(self.rows) - 1, 0, -1):
            own = self.rows[n]
            if found := [x for g in grams(word, n) if (x := own.get(g)) is not None]:
                return found
        return []

    def word_costs(self, words: list[str]) -> np.ndarray:
        """(words, languages) costs; PENALTY where nothing is known."""
        found = [self.rows_of(w) for w in words]
        many = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for own in found for x in own), np.int64, int(many.sum()))
        out = np.full((len(words), len(self.languages)), PENALTY, np.float32)
        some = many > 0
        if len(flat):
            sums = np.add.reduceat(self.costs[flat], (np.cumsum(many) - many)[some], axis=0, dtype=np.float64)
            out[some] = sums / many[some, None]
        return out

    def size(self) -> int:
        return len(self.costs)


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _count(batches, max_n: int):
    """(lang, n, gram, seen) of the partition: its words (n = 0) and their n-grams."""
    seen: dict[tuple[str, int], Counter] = defaultdict(Counter)
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for first, ends, codes, words in split_words(as_array(batch.column(1))):
            words, own = words.to_pylist(), langs[first : first + len(ends) - 1]
            of = np.repeat(np.arange(len(own)), np.diff(ends))
            for lang in set(own):
                count = np.bincount(codes[(own == lang)[of]], minlength=len(words))
                some = np.flatnonzero(count)
                seen[lang, 0].update({words[k]: int(count[k]) for k in some if has_letter(words[k])})
    for lang, _ in list(seen):
        for n in range(1, max_n + 1):
            at = seen[lang, n]
            for word, count in seen[lang, 0].items():
                for g in grams(word, n):
                    at[g] += count
    for (lang, n), counts in seen.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts)), pa.array([n] * len(counts), pa.int32()), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "n", "gram", "seen"],
        )
    del seen
    release_memory()


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAINING_ROWS, max_words: int = 20_000, max_grams: int = 10_000, max_n: int = MAX_N) -> LanguageModel:
    """Counts words and n-grams of documents with a language: those of the max_rows ids with the least hash.

    The max_words and max_grams most frequent of each language (and length) make the model, so its size is bounded
    by the number of languages; of equal ones the first in code point order. Rows with a null id, language or text
    are left out. An empty table gives a model without languages, which rejects every document.

    The bounds of acceptance come from the fitted documents that the model finds right: of each language, MARGIN_SHARE
    of the margin that all but a twentieth have, and the cost that all but a hundredth keep, raised by half its
    distance from the median. A language without such documents has no bounds.
    """
    text_batches(docs.sparkSession)
    usable = docs.select(c(id_col).alias("i"), c(lang_col).cast("string").alias("lang"), c(text_col).alias("text")).dropna()
    ids = usable.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(max_rows)
    # stored, else what is asked of the fitted documents later is worked out for all documents, before the join
    fitted = checkpoint(usable.join(F.broadcast(ids), "i").select("lang", "text"))
    counted = fitted.mapInArrow(lambda batches: _count(batches, max_n), "lang string, n int, gram string, seen long")
    total = counted.groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen"))
    by = Window.partitionBy("lang", "n")
    top = (
        total.withColumn("of", F.sum("seen").over(by))
        .withColumn("rank", F.row_number().over(by.orderBy(F.desc("seen"), "gram")))
        .filter(F.col("rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams))
        .orderBy("lang", "n", "rank")
        .toPandas()
    )
    languages = sorted(top["lang"].unique()) if len(top) else []
    place = {x: k for k, x in enumerate(languages)}
    numbers: list[dict[str, int]] = [{} for _ in range(max_n + 1)]
    total = 0
    for n, gram in zip(top["n"], top["gram"]):
        if gram not in numbers[n]:
            numbers[n][gram] = total
            total += 1
    costs = np.full((total, len(languages)), PENALTY, np.float32)
    if total:
        at = np.fromiter((numbers[n][gram] for n, gram in zip(top["n"], top["gram"])), np.int64, len(top))
        costs[at, [place[x] for x in top["lang"]]] = -np.log10(top["seen"].to_numpy(float) / top["of"].to_numpy(float))
    model = LanguageModel(languages, numbers, costs)
    if not languages:
        return model
    found = checkpoint(identify(fitted, model, "text", "found").select("lang", "found")).filter("found.lang = lang")
    bounds = found.groupBy("lang").agg(F.percentile("found.margin", 0.05).alias("margin"), F.percentile("found.cost", F.array(F.lit(0.5), F.lit(0.99))).alias("cost")).collect()
    model = LanguageModel(languages, numbers, costs, np.zeros(len(languages)), np.full(len(languages), np.inf))
    for r in bounds:
        model.least_margin[place[r["lang"]]] = MARGIN_SHARE * r["margin"]
        model.most_cost[place[r["lang"]]] = r["cost"][1] + (r["cost"][1] - r["cost"][0]) / 2 + 1e-6
    return model


class _Costs:
    """Costs of words met before, in one table."""

    def __init__(self, model: LanguageModel):
        self.model, self.place = model, {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(costs by word and language, which words have a letter); a word without one costs nothing."""
        if len(self.place) > _CACHED:
            self.place.clear()
        new = [w for w in words if w not in self.place]
        lettered = [w for w in new if has_letter(w)]
        need, first = len(self.place) + len(new) + 1, len(self.place) + 1
        if need > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)))
        # places from 1 on; 0 is a word without letters
        self.place.update(zip(lettered, range(first, first + len(lettered))))
        self.table[first : first + len(lettered)] = self.model.word_costs(lettered)
        self.place.update((w, 0) for w in new if w not in self.place)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.table[at], at > 0


def _score(costs: _Costs, text: pa.Array):
    """Mean cost of each text's words by language, and how many words with a letter it has."""
    n_langs = len(costs.model.languages)
    mean, count = np.zeros((len(text), n_langs)), np.zeros(len(text), np.int64)
    for first, ends, codes, words in split_words(text):
        cost, letters = costs.of(words.to_pylist())
        sums = np.concatenate((np.zeros((1, n_langs)), np.cumsum(cost[codes], axis=0, dtype=np.float64)))
        many = np.concatenate(([0], np.cumsum(letters[codes])))
        own = slice(first, first + len(ends) - 1)
        count[own] = np.diff(many[ends])
        mean[own] = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(count[own], 1)[:, None]
    release_memory()
    return mean, count


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language", min_margin: float = MIN_MARGIN, most: int = 5_000_000) -> DataFrame:
    """Adds a struct (lang, cost, margin, accepted) to every row; one narrow stage, the model being broadcast.

    Words are lower-cased, split at white space and freed of signs at their ends; those without a letter don't
    count. cost is the mean over all words of the whole text, lang the language with the least (of equal ones the
    first by name), margin its distance to the next (0 with one language only). Accepted is a text that has words
    and a margin of min_margin at least (with several languages), and that is within its language's bounds of the
    model, so that random letters and languages that the model doesn't know are rejected. A null or wordless text has a null
    lang and isn't accepted. Other columns and the number of rows stay; a clashing name gets a number.
    """
    check_broadcast(model.size(), most, "language model")
    text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    held: list[_Costs] = []

    @F.arrow_udf("struct<lang string, cost double, margin double, accepted boolean>")
    def judge(text: pa.Array) -> pa.Array:
        m = shared.value
        if not held:
            held.append(_Costs(m))
        mean, count = _score(held[0], as_array(text))
        if m.languages:
            best = mean.argmin(axis=1)
            low = np.sort(mean, axis=1)
            margin = low[:, 1] - low[:, 0] if len(m.languages) > 1 else np.zeros(len(mean))
            known, cost = count > 0, low[:, 0]
            ok = known & ((margin >= min_margin) | (len(m.languages) == 1))
            if m.least_margin is not None:
                ok &= (margin >= m.least_margin[best]) & (cost <= m.most_cost[best])
        else:
            best, margin, cost, known, ok = (np.zeros(len(mean), t) for t in (int, float, float, bool, bool))
        langs = pa.array([m.languages[k] if x else None for k, x in zip(best, known)], pa.string())
        return pa.StructArray.from_arrays([langs, pa.array(cost, mask=~known), pa.array(margin, mask=~known), pa.array(ok)], ["lang", "cost", "margin", "accepted"])

    (out,) = fresh(df.columns, out_col)
    return df.withColumn(out, judge(c(text_col)))


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Rows whose language is accepted, with the table's own columns."""
    (out,) = fresh(df.columns, "__language")
    return identify(df, model, text_col, out, min_margin).filter(c(out)["accepted"]).drop(out)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit_language_model(docs))
    at = F.col("language")
    return out.select("doc_id", at["lang"].alias("language"), F.round(at["cost"], 6).alias("cost"), F.round(at["margin"], 6).alias("margin"), at["accepted"].alias("keep"))
