"""Command line: build an index or a corpus, query either, or ask in a loop."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from arbor import clients, service
from arbor.operators.corpus import CorpusFilter, build_corpus
from arbor.operators.search import Request
from arbor.settings import yes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arbor", description=__doc__)
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("--document", help="a Markdown, Word, PDF or JSON-tree file to index")
    mode.add_argument("--directory", help="a directory to build a corpus from")
    mode.add_argument("--index", help="a saved index to query")
    mode.add_argument("--corpus", help="a saved corpus to query")
    p.add_argument("--out", help="where the index or corpus is written")
    p.add_argument("--query")
    p.add_argument("--interactive", action="store_true")
    p.add_argument("--include-text", default=None)
    p.add_argument("--pdf-parser", default="plain")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--source")
    p.add_argument("--top-k", type=int)
    p.add_argument("--leaf-only", default=None)
    p.add_argument("--depth", type=int)
    p.add_argument("--min-page", type=int)
    p.add_argument("--max-page", type=int)
    p.add_argument("--expand-ancestors", type=int)
    p.add_argument("--explain", default="no")
    for name in ("doc-id", "doc-type", "created-from", "created-to"):
        p.add_argument(f"--{name}")
    p.add_argument("--tag", action="append", default=[])
    for name in ("bm25-k1", "bm25-b", "diversity-penalty"):
        p.add_argument(f"--{name}", type=float)
    p.add_argument("--proximity-window", type=int)
    p.add_argument("--settings", help="a file of settings (JSON, or YAML where that module is there), kept with what is built")
    p.add_argument("--weight", action="append", default=[], metavar="FIELD=X")
    p.add_argument("--bonus", action="append", default=[], metavar="NAME=X")
    for name in ("snippet-max-chars", "snippet-context-chars", "toc-check-page-num", "recursive-split-max-depth", "recursive-split-min-pages", "recursive-split-min-tokens"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--recursive-split", default=None)
    p.add_argument("--model")
    p.add_argument("--client", metavar="MODULE:NAME", help="what makes the language model's client, called without arguments")
    p.add_argument("--rerank", default="no")
    p.add_argument("--rerank-top-k", type=int, default=3)
    return p


_SETTINGS = (
    "bm25_k1", "bm25_b", "diversity_penalty", "proximity_window", "snippet_max_chars", "snippet_context_chars", "toc_check_page_num",
    "recursive_split_max_depth", "recursive_split_min_pages", "recursive_split_min_tokens", "model",
)


def settings_values(a: argparse.Namespace) -> dict:
    """The settings that flags give; None where there is no flag."""
    pairs = lambda given: {k.strip(): float(v) for k, _, v in (x.partition("=") for x in given)} or None
    return {
        **{name: getattr(a, name) for name in _SETTINGS},
        "index_include_text": None if a.include_text is None else yes(a.include_text),
        "recursive_split_enabled": None if a.recursive_split is None else yes(a.recursive_split),
        "weights": pairs(a.weight),
        "bonuses": pairs(a.bonus),
    }


def client_of(a: argparse.Namespace) -> clients.Client | None:
    """The client that ``--client`` names, made anew."""
    if not a.client:
        return None
    module, _, name = a.client.partition(":")
    return getattr(importlib.import_module(module), name)()


def request_of(a: argparse.Namespace) -> Request:
    return Request(a.top_k, a.expand_ancestors, None if a.leaf_only is None else yes(a.leaf_only), a.depth, a.min_page, a.max_page)


def filter_of(a: argparse.Namespace) -> CorpusFilter:
    return CorpusFilter(a.doc_id, a.doc_type, a.source, tuple(a.tag), a.created_from, a.created_to)


def main(argv: list[str] | None = None, ask: Callable[[str], str] = input, tell: Callable[[str], None] = print, client: clients.Client | None = None) -> int:
    a = parser().parse_args(argv)
    if (a.document or a.directory) and not a.out:
        tell("--out is needed to build")
        return 2
    client = client or client_of(a)
    if yes(a.rerank) and client is None:
        tell("--client is needed to rerank")
        return 2
    spark = service.session()
    settings = service.settings_of(settings_values(a), a.settings)
    if a.document:
        service.build_document(spark, a.document, settings, a.pdf_parser).save(a.out)
    elif a.directory:
        build_corpus(spark, a.directory, a.exclude, a.source, settings, service.files.text_extractor(a.pdf_parser)).save(a.out)

    def answer(query: str) -> None:
        by = client if yes(a.rerank) else None
        if a.directory or a.corpus:
            found = service.query_corpus(spark, a.corpus or a.out, query, filter_of(a), request_of(a), yes(a.explain), by, a.rerank_top_k)
        else:
            found = service.query_index(spark, a.index or a.out, query, request_of(a), yes(a.explain), by, a.rerank_top_k)
        tell(json.dumps(found, ensure_ascii=False, indent=2))

    if a.query:
        answer(a.query)
    if a.interactive:
        loop(a, answer, ask, tell, client is not None)
    return 0


def loop(a: argparse.Namespace, answer: Callable[[str], None], ask: Callable[[str], str], tell: Callable[[str], None], has_client: bool = False) -> None:
    """Questions until /exit. /topk N, /leaf yes|no, /rerank yes|no, /debug yes|no and /doc ID change what is asked for."""
    while True:
        try:
            line = ask("> ").strip()
        except EOFError:
            return
        word, _, value = line.partition(" ")
        if word in ("/exit", "/quit"):
            return
        if word == "/topk" and value.isdigit():
            a.top_k = int(value)
        elif word == "/leaf":
            a.leaf_only = value
        elif word == "/rerank" and (has_client or not yes(value)):
            a.rerank = value
        elif word == "/rerank":
            tell("--client is needed to rerank")
        elif word == "/debug":
            a.explain = value
        elif word == "/doc" and value:
            a.doc_id = value
        elif line.startswith("/"):
            tell(f"unknown command: {word}")
        elif line:
            answer(line)


if __name__ == "__main__":
    sys.exit(main())
