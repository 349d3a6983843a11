"""Corpus pipeline: quality rules, language identification, near-duplicates, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textweir.llm.common import ensure_checkpoint_dir, table
from textweir.llm.language_id import fit_language_model, keep_identified
from textweir.llm.minhash import drop_near_duplicates
from textweir.llm.packing import pack
from textweir.llm.quality_rules import fit_rules, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule rejects; the rules come from the labelled ones among docs.

    Without labelled rows of both kinds there are no rules and all stay. A null, empty or wordless text is judged by
    its statistics, which are 0, and goes only if a rule says so; a null id has no label. Long texts are read whole. Repeated rows are
    judged alike. An empty table gives an empty one. Columns stay as they are, extra ones and clashing names too.
    """
    return keep_good(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart from the others, within the bounds of the fitted ones.

    Rows with a null, empty or wordless text go; a null id or lang is only left out of the fitting. Of languages that
    cost the same the first by name is taken, with a margin of 0, and the row goes. Long texts are read whole.
    Repeated rows are judged alike. An empty table gives an empty one. Columns stay, extra ones and clashing names too.
    """
    return keep_identified(docs, fit_language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Rows with a null id, a null text or no words are in no group and stay. Rows that share an id are one document
    and stay or go together. Long texts are compared whole. An empty table gives an empty one. Columns stay, extra
    ones and clashing names too.
    """
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of BM25 neighbours: (shard, window, position, doc_id, first_word, n_words, score).

    A null id is kept as null; null and wordless texts are in no window. A text longer than a window fills several.
    Neighbours that score the same come by id. Repeated rows are documents of their own. An empty table gives no rows.
    Extra columns are left out.
    """
    return pack(docs)


STAGES = [("quality rules", quality), ("language ID", language), ("near-duplicates", near_duplicates), ("packing", packing)]

#: SQL can't express learned models, sketches or greedy filling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written, in the shared checkpoint folder, and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
