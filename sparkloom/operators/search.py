"""Text and vector search, reranking by calls, fusion, context and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import boost, dot, terms


def postings(chunks: DataFrame, *keep: str) -> DataFrame:
    """term, chunk_id, tf, dl and the columns to keep: the inverted index."""
    t = chunks.select("chunk_id", *keep, terms(F.col("content")).alias("ts"))
    return t.select("chunk_id", *keep, F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term")).groupBy("term", "chunk_id", *keep).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(query: str) -> list[str]:
    from ..functions.columns import ACCENTED, PLAIN

    import re

    return sorted(set(re.findall("[a-z0-9]+", query.lower().translate(str.maketrans(ACCENTED, PLAIN)))))


def match(index: DataFrame, query: str, every: bool = True) -> DataFrame:
    """chunk_id of chunks with all (or any) of the query's terms."""
    ts = query_terms(query)
    hit = index.where(F.col("term").isin(ts)).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return hit.where(F.col("n") == len(ts)).select("chunk_id") if every else hit.select("chunk_id")


def bm25(index: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """chunk_id, score. The index is read once for its totals and once for the query's terms."""
    docs = index.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
    total = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    n, avg = total["n"], float(total["avg"] or 1.0)
    hit = index.where(F.col("term").isin(query_terms(query)))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = hit.join(F.broadcast(df), "term")  # as many rows as the query has terms
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    return s.groupBy("chunk_id").agg(F.sum(part).alias("score"))


def knn(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k rows of the highest cosine: id, score. One pass; the query is a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    v = F.col(vector)
    d = vectors.where(v.isNotNull() & (F.size(v) == len(query)))
    s = d.select(F.col(id_col), (dot(v, q) / (F.sqrt(dot(v, v)) * norm)).alias("score")).where("not isnan(score)")
    return s.orderBy(F.desc("score"), id_col).limit(k)


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'calls'").groupBy("dst").agg(F.count("*").alias("in_degree"))


def rerank(hits: DataFrame, edges: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """hits (id, score) by score * (1 + ln(1 + calls of the containing symbol) / 10). hits are few and lead the joins."""
    holder = edges.where("relation = 'contains'").select(F.col("dst").alias(id_col), F.col("src").alias("symbol"))
    held = hits.join(holder, id_col, "left").groupBy(id_col, "score").agg(F.min("symbol").alias("symbol"))
    calls = edges.where("relation = 'calls'").select(F.col("dst").alias("symbol"), F.col("src").alias("caller"))
    n = held.join(calls, "symbol", "left").groupBy(id_col, "score").agg(F.count("caller").alias("in_degree"))
    return n.withColumn("final_score", F.col("score") * boost(F.col("in_degree"))).orderBy(F.desc("final_score"), id_col).limit(limit)


def hybrid_compat(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Both lists by id, each id once, not limited again."""
    return vector_hits.select("chunk_id").union(text_hits.select("chunk_id")).distinct().orderBy("chunk_id")


def fuse(parts: dict[str, DataFrame], weights: dict[str, float], limit: int) -> DataFrame:
    """Weighted sum of scores, each list divided by its largest: chunk_id, score, then one column for each list."""
    all_ = None
    for name, df in parts.items():
        top = df.agg(F.max("score").alias("top"))
        scaled = df.join(F.broadcast(top), F.col("top").isNotNull()).select("chunk_id", F.lit(name).alias("part"), (F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("s"))  # one row
        all_ = scaled if all_ is None else all_.union(scaled)
    cols = [F.max(F.when(F.col("part") == n, F.col("s"))).alias(n) for n in parts]
    out = all_.groupBy("chunk_id").agg(*cols)
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) * float(weights.get(n, 0.0)) for n in parts), F.lit(0.0))
    return out.withColumn("score", total).orderBy(F.desc("score"), "chunk_id").limit(limit)


def query_text(query: str, keywords: list[str] | None = None) -> str:
    """What both kinds of search are asked: the query and its keywords."""
    return " ".join([query, *keywords]) if keywords else query


def hybrid(chunks: DataFrame, index: DataFrame, edges: DataFrame, query: str, vector: list[float] | None, limit: int, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """chunk_id, lexical, vector, score: text and vector search fused; text alone where the query has no vector."""
    parts = {"lexical": bm25(index, query, k1, b)}
    if vector is not None:
        hits = knn(chunks, vector, max(10, limit * 3))
        parts["vector"] = rerank(hits, edges, limit * 3).select("chunk_id", F.col("final_score").alias("score"))
    return fuse(parts, weights, limit)


def library_search(hits: DataFrame, symbols: DataFrame, query: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(chunk_id with score 1.0, symbols whose name holds the query, in id order)."""
    return hits.select("chunk_id").distinct().withColumn("score", F.lit(1.0)), symbols.where(F.col("name").contains(query)).orderBy("symbol_id").limit(limit)


def context_graph(anchors: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """anchors (chunk_id, score), files (path), symbols (id, label, kind, path) and edges around the anchors.

    Symbols are those that contain an anchor, and what these have edges to, chunks aside; edges are those
    between them, and from the containing symbols to their chunks.
    """
    scored = with_context(anchors, edges)
    holds = edges.where("relation = 'contains'").join(anchors.select(F.col("chunk_id").alias("dst")), "dst", "left_semi")
    holders = holds.select("src").distinct()
    out = edges.join(holders, "src", "left_semi").select("src", "dst", "relation").distinct()
    ids = holders.select(F.col("src").alias("id")).union(out.where("relation <> 'contains'").select("dst")).distinct()
    return {"anchors": scored, "files": chunks.join(anchors.select("chunk_id"), "chunk_id", "left_semi").select("path").distinct(), "symbols": nodes.join(ids, "id", "left_semi"), "edges": out}


def with_context(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk_id, score: anchors 1.0, other chunks of the anchors' symbols 0.5."""
    e = edges.where("relation = 'contains'")
    holders = anchors.select("chunk_id").join(e, F.col("chunk_id") == F.col("dst")).select("src").distinct()
    siblings = e.join(holders, "src").select(F.col("dst").alias("chunk_id")).distinct().join(anchors.select("chunk_id"), "chunk_id", "left_anti")
    return anchors.select("chunk_id", F.lit(1.0).alias("score")).union(siblings.select("chunk_id", F.lit(0.5)))


def group_by_symbol(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol, min_start, max_end, text: a symbol's chunks in order, gaps of lines marked; a chunk without a symbol is a row with a null one."""
    e = edges.where("relation = 'contains'").groupBy(F.col("dst").alias("chunk_id")).agg(F.min("src").alias("symbol"))
    c = chunks.join(e, "chunk_id", "left")
    piece = F.struct("start_line", "end_line", "chunk_id", "content")
    alone = F.when(F.col("symbol").isNull(), F.col("chunk_id"))
    g = c.groupBy("symbol", alone.alias("alone")).agg(F.min("start_line").alias("min_start"), F.max("end_line").alias("max_end"), F.array_sort(F.collect_list(piece)).alias("ps"))
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("last"))

    def add(acc, x):
        gap = x["start_line"] - (acc["last"] + 1)
        mark = F.when(acc["last"].isNull(), "").when(gap > 1, F.concat(F.lit("\n... "), gap.cast("string"), F.lit(" lines ...\n"))).when(acc["text"].endswith("\n"), "").otherwise("\n")
        return F.struct(F.concat(acc["text"], mark, x["content"]).alias("text"), x["end_line"].cast("int").alias("last"))

    return g.select("symbol", "min_start", "max_end", F.aggregate("ps", zero, add)["text"].alias("text"))


def first_per(df: DataFrame, key: str, n: int, *order) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("k") <= n).drop("k")
