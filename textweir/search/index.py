"""A corpus with several engines, searched one after another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..core.columns import c, full_key, hidden
from ..core.fingerprint import table_fingerprint
from ..core.pipe import Pipe
from ..operators.predict import CacheConfig, cache_or_load_vectors
from ..sources.tables import with_row_index
from .auto import auto_engine
from .base import Search


class Index(Pipe):
    """Engines over one corpus; a call chains them, each seeing and merging what those before it found.

    engines: engines, or dicts with name and config. model: a pipe that makes vectors of the columns of a field, for
    engines that need them; without one such engines are left out unless the corpus has the vectors. Under cache_dir the corpus' vectors and
    indices are kept by fingerprint. ValueError for no engines, and for engines with different fields.
    """

    _no_fingerprint = ("id", "cache_dir")

    def __init__(self, corpus: DataFrame, engines: list[Search | Mapping], *, cache_dir: str | None = None, model: Pipe | None = None, model_output: str = "vector", cache_config: CacheConfig | None = None, **kwargs):
        super().__init__(**kwargs)
        path = f"{cache_dir}/index-{table_fingerprint(corpus)}" if cache_dir else None
        made = [x if isinstance(x, Search) else auto_engine(x["name"], x.get("config"), path=path) for x in engines]
        if not made:
            raise ValueError("an index needs an engine")
        for key in ("query_field", "index_field", "key"):
            if len({getattr(x.config, key) for x in made}) > 1:
                raise ValueError(f"engines have different {key}")
        self.model, self.model_output, self.cache_dir, self.cache_config = model, model_output, cache_dir, cache_config
        g = made[0].config
        self.query_field, self.index_field, self.key = g.query_field, g.index_field, g.key
        if g.key not in corpus.columns:
            corpus = with_row_index(corpus, g.key)
        vectors = [x for x in made if x.requires_vectors]
        if vectors:
            column = full_key(self.index_field, vectors[0].config.vector_key)
            if model is not None:
                corpus = self._embedded(corpus, self.index_field, column, f"{path}/vectors" if path else None)
            elif column not in corpus.columns:
                made = [x for x in made if not x.requires_vectors]
        self.engines = made
        for x in made:
            x.build(corpus)

    def _embedded(self, df: DataFrame, field: str, column: str, path: str | None) -> DataFrame:
        (held,) = hidden()
        own = [x for x in df.columns if x.startswith(f"{field}.") and x != column]
        seen = df.select(c(self.key).alias(held), *(c(x).alias(x[len(field) + 1 :]) for x in own))
        if path is None:
            names = hidden(len(df.columns))
            beside = df.select(*(c(x).alias(h) for x, h in zip(df.columns, names)), *(c(x).alias(x[len(field) + 1 :]) for x in own))
            made = self.model.transform(beside, names)
            return made.select(*(c(h).alias(x) for x, h in zip(df.columns, names) if x != column), c(self.model_output).alias(column))
        rows = seen.select(c(held).alias("__idx__"), *(c(x) for x in seen.columns if x != held))
        found = cache_or_load_vectors(rows, self.model, path, self.cache_config, self.model_output)
        return df.drop(column).join(found.select(c("__idx__").alias(self.key), c("vector").alias(column)), self.key)

    def _apply(self, df, carry, **kwargs):
        inputs = [x for x in df.columns if x not in carry]
        key = self.key
        if key not in df.columns:
            df = with_row_index(df, key)
        vectors = [x for x in self.engines if x.requires_vectors]
        column = full_key(self.query_field, vectors[0].config.vector_key) if vectors else None
        if vectors and self.model is not None and column not in df.columns:
            df = self._embedded(df, self.query_field, column, None)
        for engine in self.engines:
            engine.update = True
            df = engine.transform(df, carry, **kwargs)
        made = [x for x in df.columns if x not in inputs and x not in carry and x not in (key, column)]
        return df.select(*map(c, carry), *map(c, made))
