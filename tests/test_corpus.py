import io
import json
import threading
import urllib.request
import zipfile

import pytest

from arbor import cli, clients, http, service
from arbor.operators import corpus as C
from arbor.operators import search as S
from arbor.operators.index import load_index
from arbor.sources import files


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("N", "Normal")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "Guide One.md").write_text("# Retrieval\nhow retrieval works\n## Scoring\nranking with weights")
    (d / "sub").mkdir()
    (d / "sub" / "notes.docx").write_bytes(docx([("H1", "Budget"), ("N", ""), ("N", "retrieval of money")]))
    (d / "sub" / "paper.pdf").write_bytes(b"first page on retrieval\n\fsecond page")
    (d / "draft.md").write_text("# Draft\nretrieval draft")
    (d / "skip.txt").write_text("retrieval")
    return str(d)


@pytest.fixture(scope="module")
def built(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "c")
    C.build_corpus(spark, folder, ["draft.md"], "here", extract=files.text_extractor("plain")).save(path)
    return path


def test_three_formats_in_one_corpus(spark, built):
    c = C.load_corpus(spark, built)
    assert {(r.doc_id, r.doc_type, r.doc_name) for r in c.catalog.collect()} == {("guide-one", "markdown", "Guide One"), ("notes", "word", "notes.docx"), ("paper", "pdf", "paper.pdf")}
    s = C.summary(c.catalog).first()
    assert (s.n_documents, s.doc_types, s.sources) == (3, ["markdown", "pdf", "word"], ["here"])
    got = service.query_corpus(spark, built, "retrieval")
    assert {r["doc_id"] for r in got["results"]} == {"guide-one", "notes", "paper"}
    assert [r["rank"] for r in got["results"]] == list(range(1, len(got["results"]) + 1))
    only = service.query_corpus(spark, built, "retrieval", C.CorpusFilter(doc_type="word"))
    assert [r["title"] for r in only["results"]] == ["Budget"]
    assert service.query_corpus(spark, built, "retrieval", C.CorpusFilter(tags=("x",)))["results"] == []


def test_metadata_filters(spark):
    rows = [("a", "en", ["x", "y"], "2024-01-05"), ("b", "en", [], "2024-02-01"), ("c", "fr", ["y"], None)]
    c = spark.createDataFrame(rows, "doc_id string, doc_type string, tags array<string>, t string").selectExpr("*", "try_to_timestamp(t)::timestamp_ntz as created_at", "'s' as source")
    ids = lambda **k: sorted(r.doc_id for r in C.filtered(c, C.CorpusFilter(**k)).collect())
    assert ids() == ["a", "b", "c"] and ids(doc_type="en", tags=("y",)) == ["a"] and ids(tags=("y", "z")) == ["a", "c"]
    assert ids(created_from="2024-01-05") == ["a", "b"] and ids(created_from="2024-01-01", created_to="2024-01-05") == ["a"]
    with pytest.raises(Exception):
        ids(created_from="not a time")


def test_command_line(spark, folder, tmp_path):
    said = []
    out = str(tmp_path / "ix")
    assert cli.main(["--document", f"{folder}/Guide One.md", "--out", out, "--include-text", "yes", "--query", "weights", "--explain", "yes"], tell=said.append) == 0
    got = json.loads(said[-1])
    assert got["results"][0]["title"] == "Scoring" and "bonuses_applied" in got["results"][0]
    lines = iter(["/topk 1", "retrieval", "/leaf yes", "/nope", "/exit"])
    cli.main(["--index", out, "--interactive"], ask=lambda _: next(lines), tell=said.append)
    assert len(json.loads(said[-2])["results"]) == 1 and said[-1].startswith("unknown")
    assert cli.main(["--document", "x.md"], tell=said.append) == 2


def test_command_line_settings_and_rerank(spark, folder, tmp_path):
    said, out = [], str(tmp_path / "ix")
    (tmp_path / "s.json").write_text(json.dumps({"weights": {"title": 7, "text": 2}, "snippet_max_chars": 100, "bm25_b": 0, "model": None}))
    build = ["--document", f"{folder}/Guide One.md", "--out", out, "--include-text", "yes", "--settings", str(tmp_path / "s.json")]
    assert cli.main([*build, "--weight", "title=6", "--bonus", "leaf=0.5", "--recursive-split", "no"], tell=said.append) == 0
    kept = load_index(spark, out).settings
    assert (kept.weights["title"], kept.weights["text"], kept.weights["summary"], kept.bonuses["leaf"]) == (6, 2, 3, 0.5)
    assert (kept.snippet_max_chars, kept.bm25_b, kept.recursive_split_enabled, kept.index_include_text) == (100, 0, False, True)
    assert cli.main(["--index", out, "--query", "retrieval", "--rerank", "yes"], tell=said.append) == 2 and "--client" in said[-1]
    last = clients.Recorded(lambda prompt: '["0002"]')
    lines = iter(["/rerank no", "retrieval ranking", "/rerank yes", "retrieval ranking", "/exit"])
    assert cli.main(["--index", out, "--interactive", "--rerank", "yes"], ask=lambda _: next(lines), tell=said.append, client=last) == 0
    plain, ordered = (json.loads(x)["results"] for x in said[-2:])
    assert ordered[0]["node_id"] == "0002" and sorted(r["node_id"] for r in plain) == sorted(r["node_id"] for r in ordered)
    lines = iter(["/rerank yes", "/exit"])
    assert cli.main(["--index", out, "--interactive"], ask=lambda _: next(lines), tell=said.append) == 0 and "--client" in said[-1]
    with pytest.raises(ValueError):
        cli.main([*build, "--weight", "nothing=1"], tell=said.append)


def test_http(spark, folder, tmp_path):
    api = http.Api(spark, clients.Recorded(lambda prompt: '```json\n["0002", "nope",]\n```'))
    s = http.server(api)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", json.dumps(body or {}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    ix, co = str(tmp_path / "ix"), str(tmp_path / "co")
    try:
        assert call("/health") == (200, {"status": "ok"}) and call("/nope")[0] == 404 and call("/query", {})[0] == 422
        assert call("/build-index", {"path": f"{folder}/Guide One.md", "index_path": ix, "include_text": True})[0] == 200
        assert call("/query", {"index_path": ix, "query": "retrieval"})[1]["results"][0]["title"] == "Retrieval"
        assert call("/rerank", {"index_path": ix, "query": "retrieval ranking"})[1]["results"][0]["node_id"] == "0002"
        assert call("/build-corpus", {"directory": folder, "corpus_path": co})[1]["documents"] == 4
        assert call("/query-corpus", {"corpus_path": co, "query": "retrieval", "doc_type": "word"})[1]["results"][0]["doc_id"] == "notes"
        assert call("/query-corpus", {"corpus_path": co, "query": "retrieval", "doc_type": "pdf"})[1]["results"][0]["doc_id"] == "paper"
        assert call("/query", {"index_path": ix, "query": "retrieval ranking", "rerank": True})[1]["results"][0]["node_id"] == "0002"
        api.client = None
        assert call("/query", {"index_path": ix, "query": "retrieval", "rerank": True})[0] == 422
    finally:
        s.shutdown()


def test_clients(spark):
    assert clients.repaired_json("```json\n{'a': 1}\n```") == {} and clients.repaired_json('x {"a": None}') == {}
    assert clients.repaired_json('```\n{"a": None, "b": [1, 2,],}\n```') == {"a": None, "b": [1, 2]}
    assert clients.retry_delay(Exception("try again after 7 seconds"), 0) == 7 and clients.retry_delay(Exception(), 9, jitter=lambda: 0) == 8
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = clients.Limiter(2, lambda: now[0], sleep)
    for _ in range(3):
        limiter.wait()
    assert slept == [60.0]
    tries = []

    class Fails:
        def complete(self, prompt):
            tries.append(prompt)
            raise ValueError("no")

    assert clients.completed(Fails(), "p", attempts=3, sleep=lambda s: None) == "" and len(tries) == 3
    prompts = spark.createDataFrame([("1", "a"), ("2", "b")], "key string, prompt string")
    got = clients.answered(prompts, lambda: clients.Recorded({"a": "A"}), per_minute=1000).collect()
    assert {r.key: r.answer for r in got} == {"1": "A", "2": ""}
    results = spark.createDataFrame([(0, k, f"n{k}") for k in range(1, 5)], "qid int, rank int, node_id string")
    order = spark.createDataFrame([(0, 0, "n3"), (0, 1, "zz"), (0, 2, "n3"), (0, 3, "n1")], "qid int, place int, node_id string")
    assert [r.node_id for r in clients.reranked(results, order).orderBy("new_rank").collect()] == ["n3", "n1", "n2", "n4"]


def test_summaries_and_descriptions(spark):
    rows = [("d", 0, "0000", "A", False, "word " * 300), ("d", 1, "0001", "B", True, "short text")]
    nodes = spark.createDataFrame(rows, "doc_id string, node_idx int, node_id string, title string, is_leaf boolean, text string")
    make = lambda: clients.Recorded(lambda p: f"said {len(p.splitlines())}")
    out = clients.summarised(nodes, make, per_minute=1000)
    got = {r.node_id: (r.summary, r.prefix_summary) for r in out.collect()}
    assert got == {"0000": (None, "said 2"), "0001": ("short text", None)}
    assert clients.described(out, make, per_minute=1000).first().doc_description == "said 3"


def test_json_tree_as_document(spark, tmp_path):
    (tmp_path / "rep_structure.json").write_text(json.dumps({"structure": [{"title": "Money", "start_index": 1, "end_index": 3, "summary": "about money"}]}))
    ix = service.build_document(spark, str(tmp_path / "rep_structure.json"))
    r = S.search_index(ix, "money").first()
    assert r.doc_id == "rep" and r.title == "Money"
