"""A small HTTP server: health, build-index, build-corpus, query, query-corpus and rerank, with JSON bodies."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from arbor import clients, service
from arbor.operators.corpus import CorpusFilter, build_corpus
from arbor.operators.search import Request
from arbor.settings import Settings

_REQUEST = ("top_k", "expand_ancestors", "leaf_only", "depth", "min_page", "max_page")
_FILTER = ("doc_id", "doc_type", "source", "created_from", "created_to")


class Api:
    """The endpoints as methods from a body to a body."""

    def __init__(self, spark: SparkSession, client: clients.Client | None = None):
        self.spark, self.client = spark, client

    def health(self, body: dict) -> dict:
        return {"status": "ok"}

    def build_index(self, body: dict) -> dict:
        service.build_document(self.spark, body["path"], self._settings(body), body.get("pdf_parser", "plain")).save(body["index_path"])
        return {"index_path": body["index_path"]}

    def build_corpus(self, body: dict) -> dict:
        extract = service.files.text_extractor(body.get("pdf_parser", "plain"))
        built = build_corpus(self.spark, body["directory"], body.get("exclude"), body.get("source"), self._settings(body), extract)
        built.save(body["corpus_path"])
        return {"corpus_path": body["corpus_path"], "documents": built.catalog.count()}

    def query(self, body: dict) -> dict:
        return service.query_index(self.spark, body["index_path"], body["query"], self._request(body), bool(body.get("explain")), *self._reranking(body))

    def query_corpus(self, body: dict) -> dict:
        wanted = CorpusFilter(**{k: body.get(k) for k in _FILTER}, tags=tuple(body.get("tags") or ()))
        return service.query_corpus(self.spark, body["corpus_path"], body["query"], wanted, self._request(body), bool(body.get("explain")), *self._reranking(body))

    def rerank(self, body: dict) -> dict:
        request = self._request({"top_k": 5, **body})
        client, _ = self._reranking({"rerank": True})
        return service.query_index(self.spark, body["index_path"], body["query"], request, False, client, request.top_k)

    def _settings(self, body: dict) -> Settings:
        return service.settings_of({"index_include_text": bool(body.get("include_text")), **(body.get("settings") or {})})

    def _reranking(self, body: dict) -> tuple[clients.Client | None, int]:
        """The client if the body asks for reranking, and how many results it orders."""
        if not body.get("rerank"):
            return None, 0
        if self.client is None:
            raise ValueError("no language model is plugged in")
        return self.client, int(body.get("rerank_top_k") or 3)

    def _request(self, body: dict) -> Request:
        return Request(**{k: body.get(k) for k in _REQUEST})


def server(api: Api, port: int = 0) -> ThreadingHTTPServer:
    """A server for ``api`` on the local interface; port 0 takes a free one."""
    routes = {"/health": api.health, "/build-index": api.build_index, "/build-corpus": api.build_corpus, "/query": api.query, "/query-corpus": api.query_corpus, "/rerank": api.rerank}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.answer()

        def do_POST(self):
            self.answer()

        def answer(self):
            code, out = 200, {}
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size) or b"{}")
                if self.path not in routes:
                    code, out = 404, {"detail": "not found"}
                else:
                    out = routes[self.path](body)
            except (KeyError, ValueError, TypeError) as e:
                code, out = 422, {"detail": str(e)}
            except Exception as e:  # noqa: BLE001 - a failed job is the request's failure, not the server's
                code, out = 500, {"detail": str(e)[:500]}
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
