"""Tools over an index, and a bounded loop of thought, action and observation around a pluggable model."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import functions as F

from ..config import Config
from ..operators import graph, search
from ..operators.extract import code_item, embed, outline, symbols
from ..operators.intervals import affected
from ..operators.lines import grep, usages
from ..sources.repo import inside, listing, read_files, read_span
from .index import Index, codebase_map


class Model(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class Stub:
    """Answers at once; stands where no model can be reached."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        return json.dumps({"thought": "no model", "answer": messages[-1]["content"]})


def parse_json(text: str) -> dict:
    """A JSON object, code fences taken off; empty if it can't be read."""
    t = text.strip()
    if t.startswith("```"):
        t = t.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        x = json.loads(t)
        return x if isinstance(x, dict) else {}
    except ValueError:
        return {}


def rewrite_query(model: Model, query: str) -> dict[str, Any]:
    """original, keywords, intent; no keywords and `unknown` if the answer can't be read."""
    x = parse_json(model.chat([{"role": "user", "content": f"Keywords and intent, as JSON, of: {query}"}]))
    return {"original": query, "keywords": [str(k) for k in x.get("keywords", [])], "intent": str(x.get("intent", "unknown"))}


class Tools:
    """What a model or a person can ask of an index; weights, limits and sizes are those of the configuration."""

    def __init__(self, index: Index, config: Config | None = None):
        self.ix, self.config = index, config or Config()
        self.names = ["search_code", "inspect_graph", "find_references", "go_to_definition", "get_type_definition", "read_file", "list_files", "view_file_outline", "view_code_item", "view_codebase_map", "read_files", "explore_module", "find_usages", "describe_architecture", "analyze_impact", "focus_on"]

    def _nodes(self):
        return graph.node_view(self.ix.read("symbols"), self.ix.read("files"), self.ix.read("chunks"))

    def _file(self, path):
        return self.ix.read("files").where(F.col("path") == inside(".", path).relative_to(Path.cwd()).as_posix())

    def hits(self, query, limit=None, mode=None, keywords=None):
        """chunk_id and scores by text, by vectors, or fused; text alone where no vector can be made of the query."""
        limit, mode, c = limit or self.config.search.top_k, mode or self.config.search.mode, self.config
        text = search.query_text(query, keywords)
        vector = embed([text], c.embedding.dim)[0]
        vector = vector.tolist() if mode != "lexical" and vector.any() else None
        if mode == "semantic" and vector is not None:
            near = self.ix.nearest(vector, max(10, limit * 3))
            return search.rerank(near, self.ix.read("edges"), limit).select("chunk_id", F.col("final_score").alias("score"))
        return search.hybrid(self.ix.read("chunks"), self.ix.read("postings"), self.ix.read("edges"), text, vector, limit, {"lexical": c.ranking.lexical, "vector": c.ranking.vector}, c.bm25.k1, c.bm25.b)

    def search_code(self, query, limit=None, mode=None, keywords=None):
        found = self.hits(query, limit, mode, keywords)
        return search.group_by_symbol(self.ix.read("chunks").join(found, "chunk_id", "left_semi"), self.ix.read("edges"))

    def search_context(self, query, limit=None, keywords=None):
        return search.context_graph(self.hits(query, limit, None, keywords).select("chunk_id"), self.ix.read("chunks"), self._nodes(), self.ix.read("edges"))

    def search_library(self, query, limit=None):
        chunks, symbols_ = search.library_search(self.hits(query, limit), self.ix.read("symbols"), query)
        return {"chunks": chunks, "symbols": symbols_}

    def subgraph(self, node, relation=None, max_hops=1, direction="both", file_filter=None):
        """(candidates or None, nodes, edges) around the one node that `node` names; ValueError if there is none."""
        start = graph.start_nodes(self._nodes(), self.ix.read("symbols"), self.ix.read("files"), node, file_filter)
        found = start.limit(2).collect()
        if not found:
            raise ValueError(f"no node is named {node}")
        if len(found) > 1:
            return start, None, None
        e = self.ix.read("edges")
        e = e.where(F.col("relation") == relation) if relation else e
        hops = min(int(max_hops), max(self.config.graph.max_depth, 1))
        ids, edges = graph.both_ways(e, found[0]["id"], hops) if direction == "both" else graph.bfs(e, found[0]["id"], direction, hops)
        return None, self._nodes().join(ids.select("id"), "id", "left_semi"), edges

    def inspect_graph(self, node, relation=None, max_hops=1, direction="both", file_filter=None):
        candidates, nodes, edges = self.subgraph(node, relation, max_hops, direction, file_filter)
        return candidates if candidates is not None else {"nodes": nodes, "edges": edges}

    def inspect(self, wanted):
        return graph.inspect(self._nodes(), self.ix.read("chunks"), wanted)

    def find_references(self, symbol_id):
        return graph.references(self.ix.read("edges"), self._nodes(), symbol_id)

    def go_to_definition(self, symbol_name):
        return graph.find_definition(self.ix.read("symbols"), symbol_name)

    def get_type_definition(self, symbol_name):
        return graph.type_definition(self.ix.read("symbols"), symbol_name)

    def read_file(self, path, start_line=0, end_line=0):
        return read_span(self._file(path), start_line, end_line)

    def list_files(self, path="", depth=1):
        return listing(self.ix.read("files"), path, depth, 100, self.config.core.exclude)

    def view_file_outline(self, path):
        row = self._file(path).first()
        return outline(symbols(row["content"], row["language"])) if row else f"no file {path}"

    def view_code_item(self, path, node_path):
        row = self._file(path).first()
        return row and code_item(row["content"], row["language"], node_path)

    def view_codebase_map(self, max_depth=5):
        return codebase_map(self.ix.read("files"), self.ix.read("symbols"), max_depth)

    def read_files(self, paths):
        return read_files(self.ix.read("files"), paths)

    def explore_module(self, path, depth=1):
        return listing(self.ix.read("files"), path, depth, 100).where("not is_dir")

    def find_usages(self, symbol):
        row = graph.start_nodes(self._nodes(), self.ix.read("symbols"), self.ix.read("files"), symbol).limit(2).collect()
        if len(row) != 1:
            raise ValueError(f"{symbol} is {'unknown' if not row else 'ambiguous'}")
        return usages(self.ix.read("edges"), self._nodes(), self.ix.read("files"), row[0]["id"], row[0]["label"])

    def describe_architecture(self, mode="fast"):
        """Coupling of folders and most called nodes; `deep` adds the first 50 lines of the top three's files."""
        e, n = self.ix.read("edges"), self._nodes()
        central = graph.central(e, n, 10)
        out = {"coupling": graph.coupling(e, n).orderBy(F.desc("strength"), "source_module", "target_module").limit(20), "central": central}
        if mode == "deep":
            hubs = central.orderBy(F.desc("in_degree"), "id").limit(3).select("path").distinct()
            out["hubs"] = read_span(self.ix.read("files").join(hubs, "path", "left_semi"), 1, 50)
        return out

    def analyze_impact(self, file_path, start_line, end_line):
        d = self.ix.spark.createDataFrame([(file_path, start_line, end_line)], "path string, start int, end int")
        return affected(self.ix.read("symbols"), d)

    def focus_on(self, topic):
        """path, rank, outline, imported_by: the files of the three best hits, best first."""
        e, n, spark = self.ix.read("edges"), self._nodes(), self.ix.spark
        hits = self.hits(topic, 3)
        ranked = self.ix.read("chunks").join(hits, "chunk_id").groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").collect()  # at most three
        rows = [(r["path"], k + 1, self.view_file_outline(r["path"]), [x["path"] for x in graph.importers(e, n, r["path"]).collect()]) for k, r in enumerate(ranked)]
        return spark.createDataFrame(rows, "path string, rank int, outline string, imported_by array<string>")

    def grep(self, pattern, language=None, path_glob=None):
        return grep(self.ix.read("files"), pattern, language, path_glob)

    def call(self, name: str, args: dict) -> str:
        """The tool's whole result as text; errors and unknown tools are text as well."""
        if name not in self.names:
            return f"unknown tool {name}"
        try:
            return as_text(getattr(self, name)(**args))
        except Exception as e:
            return f"error: {e}"


def as_text(out) -> str:
    """Frames as a JSON object a row; a dictionary's frames under their names."""
    if isinstance(out, dict):
        return "\n".join(f"{k}:\n{as_text(v)}" for k, v in out.items())
    return "\n".join(out.toJSON().collect()) if hasattr(out, "toJSON") else str(out)


@dataclass
class Run:
    answer: str
    steps: list[dict] = field(default_factory=list)


def ask(tools: Tools, model: Model, question: str, max_steps: int | None = None) -> Run:
    max_steps = max_steps or tools.config.agent.max_steps
    messages = [{"role": "system", "content": "Tools: " + ", ".join(tools.names)}, {"role": "user", "content": question}]
    run = Run("")
    for _ in range(max_steps):
        x = parse_json(model.chat(messages))
        if "answer" in x or not x:
            run.answer = str(x.get("answer", ""))
            return run
        seen = tools.call(str(x.get("action", "")), x.get("args") or {})
        run.steps.append({"thought": x.get("thought"), "action": x.get("action"), "args": x.get("args"), "observation": seen})
        messages.append({"role": "user", "content": seen})
    run.answer = "no answer within the steps allowed"
    return run


# ---- reports: what a model is given is the tools' results, whole -----------------------------------


def architecture(tools: Tools, model: Model, mode: str = "fast") -> str:
    """A description of layers, flows and cycles; fast from the structure and its hubs, deep by the loop over all tools."""
    if mode == "deep":
        return ask(tools, model, "Describe the architecture: kind of project, modules and what each answers for, main data flows, patterns. Name files.").answer
    facts = as_text(tools.describe_architecture("deep"))
    return model.chat([{"role": "user", "content": f"Describe layers, data flow, central abstractions and circular dependencies of a code base with these couplings, central nodes and files:\n{facts}"}])


def functional(tools: Tools, model: Model) -> str:
    """What the software does for its users, and how each ability works inside, by the loop over all tools."""
    return ask(tools, model, "Say what this software is for, its main abilities, how a user reaches each and how it works inside, and its outer interfaces. Name files.").answer


def impact(tools: Tools, model: Model, path: str, start: int, end: int) -> str:
    """Risk of a change to lines of a file; without a symbol in them the risk is low, and no model is asked."""
    found = tools.analyze_impact(path, start, end).select("name", "kind").orderBy("name").collect()
    if not found:
        return f"No symbol lies in {path}:{start}-{end}; comments, blanks or other files may have changed. Risk: low."
    names = ", ".join(f"{r['name']} ({r['kind']})" for r in found)
    return ask(tools, model, f"Lines {start} to {end} of {path} changed; they hold {names}. Read them, find the callers, say how each is affected, and rate the risk low, medium or high.").answer
