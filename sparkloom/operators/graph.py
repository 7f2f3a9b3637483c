"""Graph operators over nodes (id, label, kind, path) and edges (src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dirname, pascal_case
from ..store import written

TYPE_KINDS = ("class", "struct", "enum", "interface")


def node_view(symbols: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    s = symbols.select(F.col("symbol_id").alias("id"), F.col("name").alias("label"), "kind", "path")
    f = files.select(F.col("path").alias("id"), F.col("path").alias("label"), F.lit("file").alias("kind"), "path")
    c = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("label"), F.lit("chunk").alias("kind"), "path")
    return s.unionByName(f).unionByName(c)


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "relation"])


def find_definition(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def find_by_label(symbols: DataFrame, files: DataFrame, label: str, path_part: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols, then files whose label holds the text; `limit` of each, in id order, after all filters."""
    s = symbols.where(F.col("name").contains(label))
    f = files.where(F.col("path").contains(label))
    if path_part:
        s, f = s.where(F.col("path").contains(path_part)), f.where(F.col("path").contains(path_part))
    s = s.select(F.col("symbol_id").alias("id"), F.col("name").alias("label"), "kind", "path").orderBy("id").limit(limit)
    return s.union(f.select(F.col("path").alias("id"), F.col("path").alias("label"), F.lit("file").alias("kind"), "path").orderBy("id").limit(limit))


def neighbours(edges: DataFrame, node: str, direction: str) -> DataFrame:
    """Edges out of or into a node; any other direction has none."""
    return edges.where((F.col("src") if direction == "out" else F.col("dst")) == node if direction in ("out", "in") else F.lit(False))


def references(edges: DataFrame, nodes: DataFrame, symbol: str) -> DataFrame:
    callers = edges.where((F.col("relation") == "calls") & (F.col("dst") == symbol)).select(F.col("src").alias("id"))
    return callers.join(nodes, "id").dropDuplicates(["id"])


def called_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, names: the labels that each caller calls, each once, in order."""
    e = edges.where("relation = 'calls'").select("src", F.col("dst").alias("id")).join(nodes.select("id", "label"), "id")
    return e.groupBy("src").agg(F.array_sort(F.collect_set("label")).alias("names"))


def import_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, src_path, dst_path of imports between nodes that both have a path."""
    p = nodes.where("path is not null").select("id", "path")
    e = edges.where("relation = 'imports'").select("src", "dst")
    return e.join(p.select(F.col("id").alias("src"), F.col("path").alias("src_path")), "src").join(p.select(F.col("id").alias("dst"), F.col("path").alias("dst_path")), "dst")


def start_nodes(nodes: DataFrame, symbols: DataFrame, files: DataFrame, text: str, path_part: str | None = None) -> DataFrame:
    """The node of that id, or candidates by label."""
    by_id = nodes.where(F.col("id") == text)
    return by_id if by_id.limit(1).count() else find_by_label(symbols, files, text, path_part)


def without_start(nodes: DataFrame, start: str) -> DataFrame:
    """nodes but the one whose id or label is `start`."""
    return nodes.where(~(F.col("id").eqNullSafe(start) | F.col("label").eqNullSafe(start)))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and those of new that they lack; adding an edge again changes nothing."""
    return edges.unionByName(new.select("src", "dst", "relation")).dropDuplicates(["src", "dst", "relation"])


def importers(edges: DataFrame, nodes: DataFrame, path: str, limit: int = 3) -> DataFrame:
    """path: files that hold an import of something in `path`, in order."""
    inner = nodes.where(F.col("path") == path).select(F.col("id").alias("dst"))
    src = edges.where("relation = 'imports'").join(inner, "dst", "left_semi").select(F.col("src").alias("id"))
    return src.join(nodes.select("id", "path"), "id").where(F.col("path") != path).select("path").distinct().orderBy("path").limit(limit)


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, json: a subgraph's nodes and edges in id order. For results that a person looks at."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "label", "kind", F.col("path").alias("file_path")))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("kind")))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("json"))  # one row each


def inspect(nodes: DataFrame, chunks: DataFrame, wanted: str) -> DataFrame:
    """type, id, label, path, start_line, end_line, content of the chunk of that id, else of the node; no row if there is neither."""
    nothing = F.lit(None)
    c = chunks.where(F.col("chunk_id") == wanted).select(F.lit("chunk").alias("type"), F.col("chunk_id").alias("id"), F.lit("chunk").alias("label"), "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content", F.lit(0).alias("turn"))
    n = nodes.where(F.col("id") == wanted).select(F.col("kind").alias("type"), "id", "label", "path", nothing.cast("long").alias("start_line"), nothing.cast("long").alias("end_line"), nothing.cast("string").alias("content"), F.lit(1).alias("turn"))
    return c.union(n).orderBy("turn").limit(1).drop("turn")


def bfs(edges: DataFrame, start: str, direction: str, max_hops: int, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with hop, edges) within max_hops. One join a hop, against nodes not seen before; each hop is written, so none is done again."""
    spark = edges.sparkSession
    e = edges.where(F.col("relation").isin(kinds)) if kinds else edges
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    seen = spark.createDataFrame([(start, 0)], "id string, hop int")
    front, taken = seen, e.limit(0)
    for hop in range(1, max_hops + 1):
        step = written(e.join(front.select(F.col("id").alias(here)), here).select("src", "dst", "relation"), "hop")
        taken = taken.union(step)
        front = written(step.select(F.col(there).alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop")), "front")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen, taken.dropDuplicates(["src", "dst", "relation"])


def both_ways(edges: DataFrame, start: str, max_hops: int = 1) -> tuple[DataFrame, DataFrame]:
    n1, e1 = bfs(edges, start, "out", max_hops)
    n2, e2 = bfs(edges, start, "in", max_hops)
    return n1.union(n2).groupBy("id").agg(F.min("hop").alias("hop")), e1.union(e2).dropDuplicates(["src", "dst", "relation"])


def weighted(edges: DataFrame, start: str, max_depth: int, decay: float, weights: dict[str, float]) -> DataFrame:
    """id, score: the best path's product of decay and relation weights, to max_depth."""
    spark = edges.sparkSession
    w = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
    e = edges.select("src", "dst", (F.coalesce(F.try_element_at(w, F.col("relation")), F.lit(0.0)) * decay).alias("w")).where("w > 0")
    best = front = spark.createDataFrame([(start, 1.0)], "id string, score double")
    for _ in range(max_depth):
        front = written(front.join(e, F.col("id") == F.col("src")).groupBy("dst").agg(F.max(F.col("score") * F.col("w")).alias("score")).select(F.col("dst").alias("id"), "score"), "front")
        best = best.union(front)
    return best.groupBy("id").agg(F.max("score").alias("score"))


def type_definition(symbols: DataFrame, name: str) -> DataFrame:
    """The definition if it is a type, else the type of the guessed PascalCase name, else the definition."""
    d = symbols.where(F.col("name") == name).withColumn("rank", F.when(F.col("kind").isin(*TYPE_KINDS), 0).otherwise(2))
    g = symbols.where((F.col("name") == pascal_case(F.lit(name))) & F.col("kind").isin(*TYPE_KINDS)).withColumn("rank", F.lit(1))
    return d.union(g).orderBy("rank", "symbol_id").limit(1).drop("rank")


def central(edges: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    n = edges.where("relation = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.where("path is not null").join(n, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).orderBy(F.desc("in_degree"), "id").limit(limit)


def coupling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_module, target_module, strength over imports between folders."""
    p = nodes.select("id", dirname(F.col("path")).alias("m"))
    e = edges.where("relation = 'imports'").select("src", "dst")
    e = e.join(p.select(F.col("id").alias("src"), F.col("m").alias("source_module")), "src").join(p.select(F.col("id").alias("dst"), F.col("m").alias("target_module")), "dst")
    e = e.where("source_module <> target_module and source_module <> '' and target_module <> ''")
    return e.groupBy("source_module", "target_module").agg(F.count("*").alias("strength"))

