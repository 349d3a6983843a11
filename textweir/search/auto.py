"""Engines by name."""

from __future__ import annotations

from .base import Search, SearchConfig
from .bm25 import Bm25Search
from .dense import DenseSearch
from .lookup import GroupLookupSearch, TopkSearch

ENGINES: dict[str, type[Search]] = {"dense": DenseSearch, "lookup": GroupLookupSearch, "bm25": Bm25Search, "elasticsearch": Bm25Search, "topk": TopkSearch}


def auto_engine(name: str, config: SearchConfig | dict | None = None, **kwargs) -> Search:
    """An engine by its name, with its configuration; ValueError for a name that isn't known."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; there are {', '.join(ENGINES)}")
    return ENGINES[name](config, **kwargs)


def auto_config(name: str, **config) -> SearchConfig:
    return auto_engine(name).config_class(**config)
