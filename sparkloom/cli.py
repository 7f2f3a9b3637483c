"""The command line: fourteen commands over a tree and its index. Results are lines of text, or JSON."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ConfigError, load
from .operators import graph
from .operators.lines import grep
from .plans import agent
from .plans.agent import Model, Stub, Tools, as_text
from .plans.index import Session
from .sources.repo import language_of, matches, scan_repo


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("--root", default=".")
    p.add_argument("--config")
    p.add_argument("--index-dir")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        return c

    add("index").add_argument("--full", action="store_true")
    c = add("search", "query")
    c.add_argument("--top", type=int)
    c.add_argument("--mode", choices=("lexical", "semantic", "hybrid"))
    c.add_argument("--lang")
    c.add_argument("--path")
    for flag in ("--symbol", "--regex", "--no-ignore", "--smart"):
        c.add_argument(flag, action="store_true")
    add("ask", "question").add_argument("--verbose", action="store_true")
    c = add("graph")
    c.add_argument("--node", required=True)
    c.add_argument("--file")
    c.add_argument("--direction", choices=("in", "out", "both"), default="both")
    c.add_argument("--max-hops", type=int, default=1)
    c.add_argument("--kinds", nargs="*", default=[])
    c.add_argument("--kind")
    c.add_argument("--json", action="store_true")
    c.add_argument("--show-chunks", action="store_true")
    add("status")
    add("inspect", "id")
    add("cat").add_argument("files", nargs="+")
    add("explore", "path").add_argument("--depth", type=int, default=1)
    add("architecture").add_argument("--mode", choices=("fast", "deep"), default="fast")
    c = add("impact", "file")
    c.add_argument("start", type=int)
    c.add_argument("end", type=int)
    add("focus", "topic")
    add("map").add_argument("--depth", type=int, default=2)
    add("debug")
    add("explain")
    return p


def _search(s: Session, t: Tools, a: argparse.Namespace, model: Model) -> Iterable[str]:
    top = a.top or s.config.search.top_k

    def filtered(df):
        if a.lang:  # paths without an extension stay
            df = df.where(~F.col("path").rlike("\\.[^./]+$") | (language_of(F.col("path")) == a.lang))
        return df.where(matches(F.col("path"), [a.path])) if a.path else df

    if a.regex:  # the tree itself is read, so no index is needed
        files = scan_repo(s.spark, s.root, s.config.core.include, s.config.core.exclude, not a.no_ignore)
        found = grep(files, a.query, a.lang, a.path)
        return [f"{r['path']}:{r['line_number']}: {r['line']}" for r in found.orderBy("path", "line_number").collect()]
    s.opened()
    ix = s.index
    if a.symbol:
        found = filtered(graph.find_by_label(filtered(ix.read("symbols")), filtered(ix.read("files")), a.query, None, top))
        return [f"{r['label']} ({r['kind']}) {r['path']}" for r in found.collect()]
    keywords = agent.rewrite_query(model, a.query)["keywords"] if a.smart else None
    if a.smart:
        return [as_text(t.search_context(a.query, top, keywords))]
    chunks = filtered(ix.read("chunks"))
    found = chunks.join(t.hits(a.query, top, a.mode), "chunk_id").orderBy(F.desc("score"), "chunk_id")
    return [f"{r['path']}:{r['start_line']}-{r['end_line']} {r['score']:.4f}\n{r['content']}" for r in found.collect()]


def _graph(t: Tools, a: argparse.Namespace) -> Iterable[str]:
    candidates, nodes, edges = t.subgraph(a.node, a.kind, a.max_hops, a.direction, a.file)
    if candidates is not None:
        return ["several nodes are named so:", as_text(candidates)]
    if a.kinds:
        edges = edges.where(F.col("relation").isin(a.kinds))
    if not a.show_chunks:
        nodes = nodes.where("kind <> 'chunk'")
        edges = edges.where("relation <> 'contains'")
    if a.json:
        return [graph.as_json(nodes, edges).first()["json"]]
    shown = [f"{r['label']} ({r['id']})" for r in graph.without_start(nodes, a.node).orderBy("id").collect()]
    return [f"{len(shown)} neighbours", *shown, *(f"{r['src']} -{r['relation']}-> {r['dst']}" for r in edges.orderBy("src", "dst", "relation").collect())]


def run(spark: SparkSession, argv: list[str], model: Model | None = None) -> list[str]:
    """The lines that a command prints; ValueError where it can't be done."""
    a, model = parser().parse_args(argv), model or Stub()
    s = Session(spark, a.root, load(a.config), a.index_dir)
    t = Tools(s.index, s.config)
    if a.command == "index":
        return [", ".join(f"{k} {v}" for k, v in s.update(a.full).items())]
    if a.command == "search":
        return list(_search(s, t, a, model))
    s.opened()
    if a.command == "graph":
        return list(_graph(t, a))
    if a.command == "ask":
        done = agent.ask(t, model, a.question)
        return [*(f"{x['action']} {x['args']}: {x['observation']}" for x in done.steps if a.verbose), done.answer]
    if a.command == "status":
        return [f"branch {s.index.dir.rsplit('=', 1)[-1]}, {s.index.read('files').count()} files", *(f"{r['timestamp']} {r['note']}" for r in s.index.commits(5).collect())]
    if a.command == "inspect":
        return [as_text(t.inspect(a.id)) or f"no node {a.id}"]
    if a.command == "cat":
        return [f"--- {r['path']} ---\n{r['content']}" for r in t.read_files(a.files).orderBy("path").collect()]
    if a.command == "explore":
        return [r["path"] for r in t.explore_module(a.path, a.depth).collect()]
    if a.command == "architecture":
        return [agent.architecture(t, model, a.mode)]
    if a.command == "impact":
        return [agent.impact(t, model, a.file, a.start, a.end)]
    if a.command == "focus":
        return [as_text(t.focus_on(a.topic)) or f"nothing found on {a.topic}"]
    if a.command == "map":
        return [r["entry"] for r in t.view_codebase_map(a.depth).collect()]
    if a.command == "debug":
        return [f"{r[0]} {r[1]}" for r in s.index.counts().collect()]
    return [agent.functional(t, model)]


def main() -> int:
    spark = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print("\n".join(run(spark, sys.argv[1:])))
        return 0
    except (ValueError, ConfigError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
