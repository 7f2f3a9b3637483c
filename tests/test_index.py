import json

import pytest

from sparkloom.config import ConfigError, load
from sparkloom.operators import graph
from sparkloom.plans.agent import Stub, Tools, ask, parse_json, rewrite_query
from sparkloom.plans.index import index_repo
from sparkloom.sources.repo import glob_to_regex, inside, listing, read_span


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "lib").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "app/main.py").write_text("from lib.tools import helper\n\ndef main():\n    return helper(1)\n")
    (tmp_path / "lib/tools.py").write_text("def helper(x):\n    return x\n\nclass Kind:\n    def run(self):\n        return helper(2)\n")
    (tmp_path / "node_modules/x.js").write_text("function no() {}\n")
    (tmp_path / "skip.py").write_text("x = 1\n")
    (tmp_path / "notes.txt").write_text("none\n")
    (tmp_path / ".gitignore").write_text("skip.py\n")
    return tmp_path


def test_index_and_tools(spark, tree):
    ix, stats = index_repo(spark, str(tree), index_dir=str(tree / ".loom"))
    assert stats == {"new": 2, "updated": 0, "removed": 0, "skipped": 0}
    assert {r["path"] for r in ix.read("files").collect()} == {"app/main.py", "lib/tools.py"}
    e = {(r["src"], r["dst"], r["relation"]) for r in ix.read("edges").collect()}
    assert ("app/main.py::main", "lib/tools.py::helper", "calls") in e
    assert ("lib/tools.py::run", "lib/tools.py::helper", "calls") in e
    assert ("lib/tools.py::Kind", "lib/tools.py::run", "defines") in e
    assert any(r == "imports" and d == "lib/tools.py::helper" for _, d, r in e)
    t = Tools(ix)
    assert {r["id"] for r in t.find_references("lib/tools.py::helper").collect()} == {"app/main.py::main", "lib/tools.py::run"}
    assert {(r["path"], r["line_number"]) for r in t.find_usages("lib/tools.py::helper").collect()} >= {("app/main.py", 4), ("lib/tools.py", 6)}
    assert "helper" in t.call("search_code", {"query": "helper"})
    assert [r["symbol_id"] for r in t.analyze_impact("lib/tools.py", 1, 2).collect()] == ["lib/tools.py::helper"]
    assert t.call("nothing", {}).startswith("unknown tool") and t.call("read_file", {"bad": 1}).startswith("error")
    assert "F: helper" in t.view_file_outline("lib/tools.py")
    for name, args in (("inspect_graph", {"node": "lib/tools.py::helper"}), ("go_to_definition", {"symbol_name": "helper"}), ("get_type_definition", {"symbol_name": "kind"}), ("read_file", {"path": "app/main.py"}), ("list_files", {}), ("view_code_item", {"path": "lib/tools.py", "node_path": "Kind.run"}), ("view_codebase_map", {}), ("read_files", {"paths": ["app/main.py"]}), ("explore_module", {"path": "lib"}), ("describe_architecture", {}), ("focus_on", {"topic": "helper"})):
        assert not t.call(name, args).startswith(("error", "unknown")), name
    assert ask(t, Stub(), "q").answer == "q"
    # a second state of the tree gives the same index as a fresh one
    (tree / "lib/tools.py").write_text("def helper(x):\n    return x + 1\n")
    (tree / "app/extra.py").write_text("def extra():\n    return 1\n")
    (tree / "app/main.py").unlink()
    _, stats = index_repo(spark, str(tree), index_dir=str(tree / ".loom"))
    assert stats == {"new": 1, "updated": 1, "removed": 1, "skipped": 0}
    fresh, _ = index_repo(spark, str(tree), index_dir=str(tree / "other"))
    for n in ("files", "chunks", "symbols", "refs", "edges"):
        rows = lambda i, n=n: sorted(map(repr, i.read(n).drop("last_modified", "embedding").collect()))
        assert rows(ix) == rows(fresh), n
    assert ix.commits().count() == 2
    ix.delete("app/extra.py")
    assert ix.read("symbols").where("path = 'app/extra.py'").count() == 0 and ix.read("files").count() == 1


def test_update_leaves_other_buckets(spark, tmp_path):
    from sparkloom.plans.index import Index, bucket_of

    kind = "path string, language string, content string, hash string"
    rows = [(f"m{i}.py", "python", f"def f{i}():\n    return {i}\n", f"h{i}") for i in range(12)] + [("bad.py", "python", "def (", "h"), ("x.zig", "zig", "fn", "h")]
    ix = Index(spark, str(tmp_path / "ix"), buckets=4)
    assert ix.update(spark.createDataFrame(rows, kind))["new"] == 14
    assert {r["path"]: r["error"].split(":")[0] for r in ix.read("errors").collect()} == {"bad.py": "SyntaxError", "x.zig": "ValueError"}
    before = ix._pointer()["tables"]["files"]
    rows[3] = ("m3.py", "python", "def g():\n    return f1()\n", "new")
    assert ix.update(spark.createDataFrame(rows[3:4], kind), partial=True) == {"new": 0, "updated": 1, "removed": 0, "skipped": 0}
    after = ix._pointer()["tables"]["files"]
    touched = spark.createDataFrame([("m3.py",)], "path string").select(bucket_of("path", 4)).first()[0]
    assert {k for k in before if before[k] != after[k]} == {str(touched)}
    assert ix.read("files").count() == 14 and {r["name"] for r in ix.read("symbols").collect()} == {f"f{i}" for i in range(12)} - {"f3"} | {"g"}
    assert {(r["src"], r["dst"]) for r in ix.read("edges").where("relation = 'calls'").collect()} == {("m3.py::g", "m1.py::f1")}
    # postings are stored; the vector index of all lists is exact
    assert ix.read("postings").where("term = 'f1'").count() == 2
    q = ix.read("chunks").where("path = 'm5.py'").first()["embedding"]
    exact = [r["chunk_id"] for r in ix.nearest(q, 5).collect()]
    ix.fit_vectors(3)
    assert [r["chunk_id"] for r in ix.nearest(q, 5, 3).collect()] == exact and ix.nearest(q, 5, 1).first()["chunk_id"] == exact[0]


def test_commands(spark, tree, monkeypatch):
    from sparkloom.cli import run

    class Echo:
        def chat(self, messages):
            return json.dumps({"answer": messages[-1]["content"][:2000]})

    monkeypatch.chdir(tree)
    call = lambda *a: run(spark, ["--root", str(tree), *a], Echo())
    with pytest.raises(ValueError, match="no index"):
        call("status")
    assert call("search", "--regex", "return help.*", "--lang", "python", "--path", "app/**") == ["app/main.py:4:     return helper(1)"]
    assert call("search", "--regex", "^x = ") == [] and call("search", "--regex", "--no-ignore", "^x = ") == ["skip.py:1: x = 1"]
    assert call("index") == ["new 2, updated 0, removed 0, skipped 0"] and call("index", "--full") == ["new 0, updated 2, removed 0, skipped 0"]
    assert call("status")[0].endswith("2 files") and len(call("status")) == 3
    assert "helper (function) lib/tools.py" in call("search", "--symbol", "helper")
    for mode in ("lexical", "semantic", "hybrid"):
        assert any("helper" in x for x in call("search", "helper", "--mode", mode))
    assert {"anchors:", "files:", "symbols:", "edges:"} <= set(call("search", "--smart", "helper")[0].split("\n"))
    shown = call("graph", "--node", "lib/tools.py::helper", "--direction", "in", "--kinds", "calls")
    assert "app/main.py::main -calls-> lib/tools.py::helper" in shown and not any(x.startswith("helper (") for x in shown[1:])
    assert {n["id"] for n in json.loads(call("graph", "--node", "helper", "--json", "--file", "tools")[0])["nodes"]} >= {"lib/tools.py::helper"} 
    with pytest.raises(ValueError, match="no node"):
        call("graph", "--node", "nothing")
    chunk = json.loads(as_rows(call("search", "--smart", "helper")[0], "anchors")[0])["chunk_id"]
    assert json.loads(call("inspect", chunk)[0])["type"] == "chunk" and json.loads(call("inspect", "lib/tools.py::Kind")[0])["type"] == "class"
    assert call("inspect", "nothing") == ["no node nothing"]
    assert call("cat", "app/main.py")[0].startswith("--- app/main.py ---\nfrom lib") and call("explore", "lib") == ["lib/tools.py"]
    assert "lib/tools.py" in call("architecture")[0] and "architecture" in call("architecture", "--mode", "deep")[0]
    assert "Risk: low" in call("impact", "lib/tools.py", "3", "3")[0] and "helper (function)" in call("impact", "lib/tools.py", "1", "2")[0]
    focus = json.loads(call("focus", "helper")[0].split("\n")[0])
    assert focus["rank"] == 1 and any("app/main.py" in json.loads(x)["imported_by"] for x in call("focus", "helper")[0].split("\n"))
    assert any("tools.py: helper, Kind" in x for x in call("map")) and "files 2" in call("debug") and "abilities" in call("explain")[0]
    assert call("ask", "q") == ["q"]


def as_rows(text, name):
    at = text.split("\n")
    return at[at.index(f"{name}:") + 1 :]


def test_globs_and_spans(spark, tmp_path):
    import re

    assert re.match(glob_to_regex("src/**/*.{rs,py}"), "src/a/b.py") and re.match(glob_to_regex("**/*"), "x")
    assert not re.match(glob_to_regex("*.py"), "a/b.py")
    with pytest.raises(ValueError):
        glob_to_regex("a[")
    f = spark.createDataFrame([("a/b.py", "1\n2\n3\n"), ("c.py", "x")], "path string, content string")
    assert {r["path"]: r["text"] for r in read_span(f, 2, 9).collect()} == {"a/b.py": "2\n3", "c.py": "x"}
    assert [(r["path"], r["is_dir"]) for r in listing(f).collect()] == [("a", True), ("c.py", False)]
    with pytest.raises(ValueError):
        inside(str(tmp_path), "../x")


def test_bfs(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("b", "d", "imports")], "src string, dst string, relation string")
    n, taken = graph.bfs(e, "a", "out", 2)
    assert {(r["id"], r["hop"]) for r in n.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)} and taken.count() == 3
    assert {r["id"] for r in graph.bfs(e, "a", "in", 1)[0].collect()} == {"a", "c"}
    w = {r["id"]: r["score"] for r in graph.weighted(e, "a", 2, 0.5, {"calls": 1.0}).collect()}
    assert w == {"a": 1.0, "b": 0.5, "c": 0.25}


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[search]\ntop_k = 5\n[bm25]\nk1 = 2.0\n")
    c = load(str(f), {"SPARKLOOM_SEARCH_TOP_K": "7", "SPARKLOOM_CORE_AUTO_INDEX": "no", "SPARKLOOM_BM25_B": "many"})
    assert (c.search.top_k, c.bm25.k1, c.core.auto_index, len(c.warnings)) == (7, 2.0, False, 1)
    f.write_text("[serch]\nx = 1\n")
    with pytest.raises(ConfigError, match="search"):
        load(str(f), {})
    with pytest.raises(ConfigError):
        load(None, {"SPARKLOOM_RANKING_LEXICAL": "0.9"})
    g = tmp_path / "c.yaml"
    g.write_text("graph:\n  max_depth: 3\n")
    assert load(str(g), {}).graph.max_depth == 3


def test_model_answers():
    assert parse_json('```json\n{"a": 1}\n```') == {"a": 1} and parse_json("no") == {}

    class M:
        def chat(self, messages):
            return json.dumps({"keywords": ["x"], "intent": "find"})

    assert rewrite_query(M(), "q")["keywords"] == ["x"]


def test_streaming(spark, tmp_path):
    from datetime import datetime

    from sparkloom.plans.index import Index
    from sparkloom.streaming.ingest import run, stream_files

    rows = [("a.py", "python", "def f():\n    pass\n", "h1", 0, datetime(2024, 1, 1)), ("a.py", "python", "def f():\n    pass\n", "h1", 0, datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "path string, language string, content string, hash string, last_modified long, ts timestamp").write.parquet(str(tmp_path / "in"))
    ix = Index(spark, str(tmp_path / "ix"))
    run(stream_files(spark, str(tmp_path / "in")), ix, str(tmp_path / "ck")).awaitTermination()
    assert ix.read("symbols").count() == 1


class Once:
    """Calls one tool, then answers with what it was shown."""

    def __init__(self, action, args):
        self.first = json.dumps({"action": action, "args": args})

    def chat(self, messages):
        return self.first if len(messages) == 2 else json.dumps({"answer": messages[-1]["content"]})


def test_tool_results_are_whole(spark):
    class Long(Tools):
        def read_file(self, path):
            return spark.range(3000).selectExpr("id", "'some longer text' as line")

    seen = ask(Long(None), Once("read_file", {"path": "a"}), "q").answer
    assert [json.loads(x)["id"] for x in seen.split("\n")] == list(range(3000)) and len(seen) > 8000


def test_modules_are_found_in_paths_by_equal_parts(spark):
    """A name asked for in more modules than are tried one by one, one asked for in few, and one in none."""
    from sparkloom.operators.resolve import FEW_MODULES, holding

    n = 3 * FEW_MODULES
    modules = [("run", m) for k in range(n) for m in (f"lib/m{k}", f"m{k}.py", f"é{k}")] + [("run", "x" * 200), ("run", "aa"), ("few", "lib/m1"), ("few", "nowhere")]
    symbols = [(t, f"{p}::{t}{c}", p) for t in ("run", "few", "none") for c in ("", "2") for k in range(n) for p in (f"lib/m{k}.py", f"app/é{k}.py", "a/aaaa.py")]
    want = sorted({(t, m, p, f"{p}::{t}") for t, m in modules for s, _, p in symbols if s == t and m in p})
    got = holding(spark.createDataFrame(modules, "target string, module string"), spark.createDataFrame(symbols, "target string, symbol_id string, to_path string"))
    assert sorted(map(tuple, got.select("target", "module", "to_path", "symbol_id").collect())) == want


def test_edges_are_joined_without_a_broadcast_by_estimate(spark, tmp_path):
    """Parsed rows come from far smaller files, so what Spark takes for small could be too much for the driver."""
    from sparkloom.plans.index import build_edges

    symbols = spark.createDataFrame([("a.py::C", "C", "class", "a.py", 1, 9, None), ("a.py::f", "f", "function", "a.py", 2, 3, "C")], "symbol_id string, name string, kind string, path string, start_line int, end_line int, parent_scope string")
    chunks = spark.createDataFrame([("c1", "a.py", 1, 9)], "chunk_id string, path string, start_line int, end_line int")
    refs = spark.createDataFrame([("a.py", "call", "f", None, None, 7)], "path string, ref_kind string, name string, alias string, context string, line int")
    for name, rows in (("symbols", symbols), ("chunks", chunks), ("refs", refs)):
        rows.write.parquet(str(tmp_path / name))
    edges = build_edges(*(spark.read.parquet(str(tmp_path / n)) for n in ("symbols", "chunks", "refs")))
    assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, edges.collect())) == [("a.py", "a.py::C", "defines"), ("a.py", "a.py::f", "defines"), ("a.py::C", "a.py::f", "calls"), ("a.py::C", "a.py::f", "defines"), ("a.py::C", "c1", "contains"), ("a.py::f", "c1", "contains")]
