"""What search engines have in common: configuration, indices in storage, and how results join a table of queries."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.columns import c, full_key
from ..core.fingerprint import get_fingerprint
from ..core.pipe import Pipe
from ..sources.tables import Store, read_json, with_row_index, write_json
from .result import NEG_INF, fill_missing, merge_results, padded, to_long, to_wide

IDX = "__idx__"


@dataclass
class SearchConfig:
    """k None: all. key: the column that tells queries, and rows of the corpus, apart; they are numbered where it isn't there."""

    k: int | None = 10
    merge_previous_results: bool = True
    query_field: str = "query"
    index_field: str = "index"
    score_key: str = "score"
    index_key: str = "idx"
    group_key: str = "group_idx"
    key: str = IDX
    fill_missing: bool = False

    #: What a search may change without another index.
    _no_index_fingerprint = ("k", "merge_previous_results", "query_field", "score_key", "index_key", "fill_missing")

    @property
    def fingerprint(self) -> str:
        return get_fingerprint([type(self).__name__, asdict(self)])

    @property
    def index_fingerprint(self) -> str:
        return get_fingerprint([type(self).__name__, {k: v for k, v in asdict(self).items() if k not in self._no_index_fingerprint}])


class Search(Pipe):
    """An engine. Subclasses write _build and _search, over tables of Spark.

    build(corpus) makes the index, in storage where a path is given (kept if it is there already). A search adds
    ``index_field.idx`` and ``index_field.score`` to the queries, arrays of k padded with -1 and -inf; results that the
    queries have there already are merged with the new ones if merge_previous_results is set.
    """

    name = ""
    config_class: type[SearchConfig] = SearchConfig
    #: Whether queries and corpus need vectors.
    requires_vectors = False

    def __init__(self, config: SearchConfig | dict | None = None, path: str | None = None, **kwargs):
        super().__init__(**kwargs)
        self.config = self.config_class(**config) if isinstance(config, dict) else config or self.config_class()
        self.path = f"{path}/{self.name}-{self.config.index_fingerprint}" if path else None
        self.tables: dict[str, DataFrame] = {}
        self.state: dict = {}

    _no_fingerprint = ("id", "tables", "state", "path")

    def _build(self, corpus: DataFrame) -> tuple[dict[str, DataFrame], dict]:
        raise NotImplementedError

    def _search(self, queries: DataFrame, k: int | None) -> DataFrame:
        """(qid, idx, score) for queries with a column qid."""
        raise NotImplementedError

    # index

    def build(self, corpus: DataFrame):
        spark = corpus.sparkSession
        if self.path and self.exists(spark):
            return self.load(spark)
        if self.config.key not in corpus.columns:
            corpus = with_row_index(corpus, self.config.key)
        self.tables, self.state = self._build(corpus.withColumn("idx", c(self.config.key).cast("long")))
        if self.path:
            self.save()
            self.load(spark)
        return self

    def exists(self, spark: SparkSession) -> bool:
        fs, path = Store(spark, self.path)._files()
        return fs.exists(path(f"{self.path}/state.json"))

    def save(self) -> None:
        """Tables first, then what says that they are whole."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        write_json(spark, f"{self.path}/state.json", {"engine": self.name, "config": asdict(self.config), "state": self.state, "tables": list(self.tables)})

    def load(self, spark: SparkSession):
        said = read_json(spark, f"{self.path}/state.json")
        self.state = said["state"]
        self.tables = {x: spark.read.parquet(f"{self.path}/{x}") for x in said["tables"]}
        return self

    @staticmethod
    def load_from_path(spark: SparkSession, path: str) -> Search:
        """The engine whose index lies at a path, with the configuration that it was built with."""
        from .auto import ENGINES

        said = read_json(spark, f"{path}/state.json")
        engine = ENGINES[said["engine"]](said["config"])
        engine.path = path
        return engine.load(spark)

    def rm(self, spark: SparkSession) -> None:
        Store(spark, self.path).remove()
        self.tables, self.state = {}, {}

    def __len__(self) -> int:
        return int(self.state.get("rows", 0))

    # search

    def column(self, key: str) -> str:
        return full_key(self.config.index_field, key)

    def _seen(self, names: list[str]) -> list[str]:
        """Columns of the queries that the engine reads."""
        return [x for x in names if x.startswith(f"{self.config.query_field}.")]

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Results as rows (qid, idx, score), for queries told apart by config.key."""
        return self._search(queries.select(c(self.config.key).alias("qid"), *(c(x) for x in queries.columns if x != "qid")), k or self.config.k)

    def _apply(self, df, carry, k: int | None = None, **kwargs):
        config, k = self.config, k or self.config.k
        idx, score, key = self.column(config.index_key), self.column(config.score_key), config.key
        if key not in df.columns:
            df, key = with_row_index(df, key), key
        names = [x for x in df.columns if x not in carry or x == key]
        prior = to_long(df, key, idx, score) if {idx, score} <= set(names) else None
        queries = df.select(c(key).alias("qid"), *(c(x) for x in self._seen(names)))
        found = self._rank(queries, prior, k)
        wide = to_wide(found, k, "__hits__", "__scores__")
        out = df.select(*(c(x) for x in carry), *([] if key in carry else [c(key)])).join(wide, c(key) == c("qid"), "left")
        hits, scores = F.coalesce("__hits__", F.array().cast("array<bigint>")), F.coalesce("__scores__", F.array().cast("array<double>"))
        if k is not None:
            hits, scores = padded(hits, scores, k)
        if config.fill_missing and len(self):
            hits = fill_missing(hits, c(key), 0, len(self))
        return out.select(*map(c, carry), hits.alias(idx), scores.alias(score))

    def _rank(self, queries: DataFrame, prior: DataFrame | None, k: int | None) -> DataFrame:
        found = self._search(queries, k)
        return merge_results(prior, found) if prior is not None and self.config.merge_previous_results else found


def config_fields(cls: type) -> list[str]:
    return [f.name for f in fields(cls)]


__all__ = ["IDX", "NEG_INF", "Search", "SearchConfig", "config_fields"]
