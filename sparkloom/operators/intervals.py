"""Interval joins on a path: equi join on the path, range as residual, a window picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import by_shuffle


def _first(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("pick = 1").drop("pick")


def symbol_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """symbol_id, chunk_id: the first chunk that contains the symbol, else all that overlap it."""
    s = symbols.select("symbol_id", "path", F.col("start_line").alias("s0"), F.col("end_line").alias("s1"))
    c = chunks.select("chunk_id", "path", F.col("start_line").alias("c0"), F.col("end_line").alias("c1"))
    met = s.join(by_shuffle(c), "path").where("s0 <= c1 and s1 >= c0").withColumn("inside", F.expr("s0 >= c0 and s1 <= c1"))
    w = Window.partitionBy("symbol_id")
    ranked = met.withColumn("any_inside", F.max("inside").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("inside"), "c0", "chunk_id")))
    return ranked.where("not any_inside or k = 1").select("symbol_id", "chunk_id")


def line_nodes(refs: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """refs (ref_id, path, line) with node: the narrowest symbol around the line, else the first chunk, else the file."""
    r = refs.select("ref_id", "path", "line")
    s = r.join(by_shuffle(symbols.select("symbol_id", "path", "start_line", "end_line")), "path").where("line between start_line and end_line")
    s = _first(s, ["ref_id"], F.col("end_line") - F.col("start_line"), "symbol_id").select("ref_id", "symbol_id")
    c = r.join(by_shuffle(chunks.select("chunk_id", "path", "start_line", "end_line")), "path").where("line between start_line and end_line")
    c = _first(c, ["ref_id"], "start_line", "chunk_id").select("ref_id", "chunk_id")
    return r.join(by_shuffle(s), "ref_id", "left").join(by_shuffle(c), "ref_id", "left").select("ref_id", "path", "line", F.coalesce("symbol_id", "chunk_id", "path").alias("node"))


def affected(symbols: DataFrame, diffs: DataFrame) -> DataFrame:
    """Symbols that overlap a changed range (path, start, end), each once."""
    d = diffs.select(F.col("path").alias("d_path"), F.col("start").alias("d0"), F.col("end").alias("d1"))
    return symbols.join(d, (F.col("path") == F.col("d_path")) & (F.col("start_line") <= F.col("d1")) & (F.col("end_line") >= F.col("d0")), "left_semi")
