"""arbor: structured-document retrieval on Spark DataFrames."""

from __future__ import annotations

from importlib import import_module

_EXPORTS = {
    "Settings": "arbor.settings",
    "build_corpus": "arbor.operators.corpus",
    "build_document": "arbor.service",
    "build_index": "arbor.operators.index",
    "flatten_json": "arbor.operators.tree",
    "load_corpus": "arbor.operators.corpus",
    "load_index": "arbor.operators.index",
    "markdown_tree": "arbor.operators.corpus",
    "page_tree": "arbor.operators.pages",
    "rerank": "arbor.clients",
    "search_corpus": "arbor.operators.corpus",
    "search_index": "arbor.operators.search",
    "search_queries": "arbor.operators.search",
    "word_tree": "arbor.operators.corpus",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(_EXPORTS[name]), name)
