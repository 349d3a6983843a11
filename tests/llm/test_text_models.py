"""Quality rules, language identification and toxicity against brute force and held-out rows."""

import base64

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from textweir.llm import language_id as L
from textweir.llm import quality_rules as Q
from textweir.llm import toxicity as T
from textweir.llm.common import normal_word

SCHEMA = "doc_id bigint, text string, lang string, rule int, language string, toxicity string, `a.b` string"
LONG = "word " * 30_000
ODD = [(1, None, None, 1, "x", "y", "z"), (None, "", "en", None, None, None, None), (2, " \n\t ", "de", 2, "", "", ""), (3, LONG, "en", 3, None, None, None), (3, LONG, "en", 3, None, None, None), (4, "...", None, None, None, None, None)]


MORE = DATA.replace("0.001", "0.01")


def load(spark, name, folder=DATA):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text):
    return [x for w in (text or "").split() if (x := normal_word(w))]


def split(df, column="doc_id"):
    held = F.pmod(F.xxhash64(column, F.lit(5)), F.lit(3)) == 0
    return df.filter(~held), df.filter(held)


# --- quality rules


def brute_stats(text):
    w = text.split()
    n, chars, lines = max(len(w), 1), max(len(text), 1), text.split("\n")
    return {
        "n_words": len(w), "mean_word": chars / n, "symbol_share": sum(x in "$%&*#@^~<>{}=+_\\" for x in text) / chars, "bar_share": text.count("|") / n, "shout_share": text.count("!") / n,
        "upper_share": sum(x.isupper() for x in text) / chars, "digit_share": sum(x in "0123456789" for x in text) / chars, "repeat_share": sum(a == b for a, b in zip(w, w[1:])) / n, "line_variety": len(set(lines)) / len(lines),
    }


def test_statistics(spark):
    docs = load(spark, "documents").select("doc_id", "text")
    rows = docs.select("text", *(v.alias(k) for k, v in Q.text_stats(F.col("text")).items())).collect()
    for r in rows:
        assert {k: pytest.approx(r[k], abs=1e-9) for k in Q.STATS} == brute_stats(r.text)


def test_rules_on_held_out_rows(spark):
    docs, labels = load(spark, "documents", MORE), load(spark, "labels", MORE)
    rules = Q.fit_rules(docs, split(labels)[0])
    assert rules and rules == Q.fit_rules(docs, split(labels)[0])
    out = Q.apply_rules(docs, rules).join(split(labels)[1], "doc_id").select("quality", "rule").collect()
    bad, good = [r for r in out if r.quality == 0], [r for r in out if r.quality == 1]
    assert np.mean([r.rule is None for r in good]) >= 0.97 and np.mean([r.rule is not None for r in bad]) >= 0.7


def test_rules_are_ordered_conditionals(spark):
    rules = [(Q.Condition("n_words", False, 2.0),), (Q.Condition("upper_share", True, 0.5), Q.Condition("digit_share", False, 0.1))]
    df = spark.createDataFrame([(t,) for t in ("a b c", "A", "ABC DEF GHI", "1 2 3", None, "")], "text string")
    got = [r.rule for r in Q.apply_rules(df, rules).collect()]
    assert got == [None, 1, 2, None, 0, 0]
    assert [r.text for r in Q.keep_good(df, rules).collect()] == ["a b c", "1 2 3"]


def test_learning_ends():
    x = np.zeros((30, len(Q.STATS)))
    assert Q.learn_rules(x, np.ones(30, bool)) == [] and Q.learn_rules(x, np.zeros(30, bool)) == [] and Q.learn_rules(x[:0], np.zeros(0, bool)) == []
    assert Q.learn_rules(x, np.arange(30) < 15) == []  # nothing tells them apart
    x[:15, 0] = 5
    assert [str(r[0]) for r in Q.learn_rules(x, np.arange(30) < 15)] == ["n_words > 2.5"]


def test_rules_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    out = Q.apply_rules(df, [(Q.Condition("repeat_share", True, 0.5),)])
    assert out.columns == [*df.columns, "rule_1"]
    assert sorted(((r.doc_id, r.rule_1) for r in out.collect()), key=repr) == sorted([(1, 0), (None, 0), (2, 0), (3, 1), (3, 1), (4, None)], key=repr)
    assert Q.fit_rules(df, spark.createDataFrame([], "doc_id bigint, quality int")) == []
    assert Q.keep_good(df.limit(0), []).count() == 0 and Q.keep_good(df, []).columns == df.columns


# --- language identification


def test_backoff_by_brute_force(spark):
    docs = load(spark, "documents").select("doc_id", "text", "lang")
    model = L.fit_language_model(docs, max_words=200, max_grams=300)
    out = L.identify(docs, model).select("doc_id", "text", "language.*").collect()

    tables = [{g: model.costs[at] for g, at in own.items()} for own in model.rows]

    def cost(word, k):
        for n in (0, 4, 3, 2, 1):
            table = tables[n]
            keys = [word] if n == 0 else [f" {word} "[i : i + n] for i in range(len(word) + 3 - n)]
            found = [table[g][k] for g in keys if g in table]
            if found:
                return float(np.mean(found))
        return L.PENALTY

    for r in out[:60]:
        own = [w for w in words(r.text) if any(x.isalpha() for x in w)]
        if not own:
            assert r.lang is None and not r.accepted
            continue
        each = [np.mean([cost(w, k) for w in own]) for k in range(len(model.languages))]
        best = np.argsort(each, kind="stable")
        assert r.cost == pytest.approx(each[best[0]], abs=1e-4) and r.margin == pytest.approx(each[best[1]] - each[best[0]], abs=1e-4)
        if r.margin > 1e-4:
            assert r.lang == model.languages[best[0]]


def test_languages_of_held_out_rows(spark):
    docs = load(spark, "documents").select("doc_id", "text", "lang")
    model = L.fit_language_model(split(docs)[0])
    out = L.identify(split(docs)[1], model).select("lang", F.col("language.lang").alias("found"), "language.accepted").collect()
    assert np.mean([r.lang == r.found for r in out]) >= 0.95 and np.mean([r.accepted for r in out]) >= 0.97


def test_languages_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    model = L.fit_language_model(df)
    out = L.identify(df, model)
    assert out.columns == [*df.columns, "language_1"]
    by = {(r.doc_id, r.text): r.language_1 for r in out.collect()}
    assert out.count() == len(ODD) and by[3, LONG].accepted and not by[1, None].accepted and by[4, "..."].lang is None
    assert [r.doc_id for r in L.keep_identified(df, model).collect()] == [3, 3]
    empty = L.fit_language_model(df.limit(0))
    assert empty.languages == [] and not any(r.language_1.accepted for r in L.identify(df, empty).collect())
    assert L.identify(df.limit(0), model).count() == 0


def test_foreign_and_random_texts_are_rejected(spark):
    docs = load(spark, "documents", MORE).select("doc_id", "text", "lang")
    model = L.fit_language_model(docs)
    rng = np.random.default_rng(1)
    odd = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(60)) for _ in range(30)]
    odd += [" ".join(base64.b64encode(rng.bytes(45)).decode() for _ in range(10)) for _ in range(30)]
    odd += [
        "Вчера вечером мы пошли в парк, где дети играли на качелях, а пожилые люди сидели на скамейках и говорили о погоде.",
        "Wczoraj wieczorem poszliśmy do parku, gdzie dzieci bawiły się na huśtawkach, a starsi ludzie siedzieli na ławkach i rozmawiali o pogodzie.",
    ]
    out = L.identify(spark.createDataFrame([(x,) for x in odd], "text string"), model).select("language.*").collect()
    assert not any(r.accepted for r in out) and out[60].cost == L.PENALTY
    assert L.keep_identified(docs, model).count() >= 0.98 * docs.count()


# --- toxicity


def test_swaps_hardly_change_scores(spark):
    rng = np.random.default_rng(0)
    neutral = [f"w{k}" for k in range(60)]
    texts, toxic = [], []
    for k in range(600):
        bad = k % 3 == 0
        # a group is named more often in toxic texts than in others
        group = "muslim" if rng.random() < (0.7 if bad else 0.15) else "christian" if rng.random() < 0.5 else None
        texts.append({*rng.choice(neutral, 8), *(["scum"] if bad and rng.random() < 0.8 else []), *([group] if group else [])})
        toxic.append(bad)
    y = np.array(toxic, float)
    gap = {}
    for strength in (0.0, 20.0):
        m = T.fit_classifier(texts, y, strength=strength, min_contrast=2.0)
        gap[strength] = m.logit({"w1", "muslim"}) - m.logit({"w1", "christian"})
    assert gap[0.0] > 0.5 and abs(gap[20.0]) < 0.3 * gap[0.0]
    assert T.swaps({"men", "x"}) == [{"women", "x"}]
    cols, deltas = T.rows_of(["men", "x"], {"men": 0, "women": 1, "x": 2})
    assert cols == [0, 2] and deltas == [[1, -2]]


def test_toxic_held_out_rows(spark):
    docs, labels = load(spark, "documents", MORE), load(spark, "labels", MORE)
    model = T.fit_toxicity(docs, split(labels)[0])
    out = T.score_toxicity(docs, model).join(split(labels)[1], "doc_id").select("toxic", "toxicity.*", "text").toDF("label", "score", "toxic", "text").collect()
    bad, good = [r for r in out if r.label == 1], [r for r in out if r.label == 0]
    assert np.mean([r.toxic for r in bad]) >= 0.7 and np.mean([r.toxic for r in good]) <= 0.05
    for r in out[:40]:
        assert r.score == pytest.approx(model.score(set(words(r.text))) if words(r.text) else 0.0, abs=1e-9)


def test_same_model_on_the_driver(spark):
    docs, labels = load(spark, "documents"), load(spark, "labels")
    rows = docs.join(labels, "doc_id").orderBy(F.col("doc_id").cast("string")).select("text", "toxic").collect()
    here = T.fit_classifier([set(words(r.text)) for r in rows], np.array([r.toxic for r in rows], float), min_contrast=3.0)
    there = T.fit_toxicity(docs, labels, min_contrast=3.0)
    assert here.weights.keys() == there.weights.keys() and here.bias == pytest.approx(there.bias, abs=1e-6) and here.weights == pytest.approx(there.weights, abs=1e-6)


def test_toxicity_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    nothing = T.fit_toxicity(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    out = T.score_toxicity(df, nothing)
    assert out.columns == [*df.columns, "toxicity_1"] and out.count() == len(ODD) and not any(r.toxicity_1.toxic for r in out.collect())
    model = T.ToxicityModel({"word": 5.0, "wor*": 0.0}, -1.0)
    by = {(r.doc_id, r.text): r.toxicity_1 for r in T.score_toxicity(df, model).collect()}
    assert by[3, LONG].toxic and by[1, None].score == 0 and by[2, " \n\t "].score == 0
    assert T.score_toxicity(df.limit(0), model).count() == 0
