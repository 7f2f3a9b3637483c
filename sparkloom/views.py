"""The code graph's tables as views of the supplied star schema, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import content_hash


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _id(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: path is source/lang/doc_id."""
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return d.select(path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"), content_hash(F.col("text")).alias("hash"), "doc_id")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: path is brand/size, the range follows from size and key."""
    p = read(spark, sf_dir, "part")
    start = F.col("p_size").cast("long")
    return p.select(_id("p", "p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("path"), start.alias("start_line"), (start + F.col("p_partkey") % 7).alias("end_line"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: the path is the conversation, each turn ten lines."""
    c = read(spark, sf_dir, "conversations")
    turn = F.col("turn")
    return c.select(F.concat(_id("t", "conv_id"), F.lit("-"), F.lpad(turn.cast("string"), 4, "0")).alias("chunk_id"), _id("v", "conv_id").alias("path"), F.col("text").alias("content"), (turn * 10 + 1).cast("long").alias("start_line"), (turn * 10 + 10).cast("long").alias("end_line"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir).select(F.col("symbol_id").alias("id"), F.col("name").alias("label"), "kind", "path")
    c = read(spark, sf_dir, "customer").select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("kind"), F.concat(_id("n", "c_nationkey"), F.lit("/"), _id("c", "c_custkey")).alias("path"))
    u = read(spark, sf_dir, "supplier").select(_id("s", "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("kind"), F.concat(_id("n", "s_nationkey"), F.lit("/"), _id("s", "s_suppkey")).alias("path"))
    return s.unionByName(c).unionByName(u)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls: order to part; imports: customer to supplier; defines: region to nation to customer; contains: conversation to turn."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    calls = line.select(_id("o", "l_orderkey").alias("src"), _id("p", "l_partkey").alias("dst"), F.lit("calls").alias("relation")).distinct()
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    imports = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(_id("c", "o_custkey").alias("src"), _id("s", "l_suppkey").alias("dst"), F.lit("imports").alias("relation")).distinct()
    n = read(spark, sf_dir, "nation").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst"), F.lit("defines").alias("relation"))
    c = read(spark, sf_dir, "customer").select(_id("n", "c_nationkey").alias("src"), _id("c", "c_custkey").alias("dst"), F.lit("defines").alias("relation"))
    t = chunks(spark, sf_dir).select(F.col("path").alias("src"), F.col("chunk_id").alias("dst"), F.lit("contains").alias("relation"))
    return calls.union(imports).union(n).union(c).union(t)


#: The same views for DuckDB.
SQL = {
    "files": "select source || '/' || lang || '/' || doc_id as path, lang as language, text as content, sha256(text) as hash, doc_id from documents",
    "symbols": "select 'p' || p_partkey as symbol_id, p_name as name, lower(p_type) as kind, p_brand || '/' || p_size as path, p_size::bigint as start_line, p_size::bigint + p_partkey % 7 as end_line from part",
    "chunks": "select 't' || conv_id || '-' || lpad(turn::varchar, 4, '0') as chunk_id, 'v' || conv_id as path, text as content, turn * 10 + 1 as start_line, turn * 10 + 10 as end_line from conversations",
    "nodes": "select symbol_id as id, name as label, kind, path from symbols union all select 'c' || c_custkey, c_name, 'customer', 'n' || c_nationkey || '/c' || c_custkey from customer union all select 's' || s_suppkey, s_name, 'supplier', 'n' || s_nationkey || '/s' || s_suppkey from supplier",
    "edges": "select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst, 'calls' as relation from lineitem union all select distinct 'c' || o_custkey, 's' || l_suppkey, 'imports' from lineitem join orders on l_orderkey = o_orderkey union all select 'r' || n_regionkey, 'n' || n_nationkey, 'defines' from nation union all select 'n' || c_nationkey, 'c' || c_custkey, 'defines' from customer union all select path, chunk_id, 'contains' from chunks",
}


def with_views(body: str, *names: str) -> str:
    need = [n for n in ("files", "symbols", "chunks", "nodes", "edges") if n in names or n == "symbols" and "nodes" in names or n == "chunks" and "edges" in names]
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in need) + " " + body
