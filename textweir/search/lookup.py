"""Rows of the corpus by group, and re-ranking of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..core.columns import c, full_key
from .base import Search, SearchConfig
from .result import top_k


@dataclass
class GroupLookupConfig(SearchConfig):
    k: int | None = None


class GroupLookupSearch(Search):
    """The rows with the query's group, by place, with score 0; an equi-join. Null groups match nothing."""

    name = "lookup"
    config_class = GroupLookupConfig

    def _build(self, corpus):
        group = full_key(self.config.index_field, self.config.group_key)
        rows = corpus.select(c(group).alias("group"), "idx").filter("group IS NOT NULL")
        return {"groups": rows}, {"rows": corpus.count()}

    def _search(self, queries, k):
        group = full_key(self.config.query_field, self.config.group_key)
        asked = queries.select("qid", c(group).alias("group"))
        found = asked.join(self.tables["groups"], "group").select("qid", "idx", F.lit(0.0).alias("score"))
        return top_k(found, k).drop("rank")


@dataclass
class TopkConfig(SearchConfig):
    merge_previous_results: bool = False


class TopkSearch(Search):
    """The k best of the results that are there already; ValueError without any. There is no index."""

    name = "topk"
    config_class = TopkConfig

    def build(self, corpus=None):
        return self

    def _rank(self, queries, prior, k):
        if prior is None:
            raise ValueError(f"no results in {self.column(self.config.index_key)} to re-rank")
        return top_k(prior, k).drop("rank")

    def _search(self, queries, k):
        raise ValueError("results are re-ranked where they stand: call the engine with the table")
