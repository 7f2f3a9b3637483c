"""Line operators: grep, usages with context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lines
from ..sources.repo import language_of, matches


def explode_lines(files: DataFrame) -> DataFrame:
    """path, line_number (from 1), line."""
    return files.select("path", F.posexplode(lines(F.col("content"))).alias("at", "line")).select("path", (F.col("at") + 1).cast("long").alias("line_number"), "line")


def grep(files: DataFrame, pattern: str, language: str | None = None, path_glob: str | None = None) -> DataFrame:
    """Lines that match; files without any matching line are left before they are split."""
    f = files.where(F.col("content").rlike(f"(?m){pattern}"))
    if language:  # files without an extension stay
        f = f.where(~F.col("path").rlike("\\.[^./]+$") | (language_of(F.col("path")) == language))
    if path_glob:
        f = f.where(matches(F.col("path"), [path_glob]))
    return explode_lines(f).where(F.col("line").rlike(pattern))


def usages(edges: DataFrame, nodes: DataFrame, files: DataFrame, symbol: str, text: str, around: int = 2) -> DataFrame:
    """path, line_number, code: lines of callers' files that hold the text, with lines around them."""
    callers = edges.where(F.col("dst") == symbol).join(nodes.select(F.col("id").alias("src"), "path"), "src").select("path").distinct()
    ls = lines(F.col("content"))
    f = files.where(F.col("content").contains(text)).join(callers, "path", "left_semi").select("path", ls.alias("ls"))
    hit = f.select("path", "ls", F.posexplode("ls").alias("at", "line")).where(F.col("line").contains(text))
    first = F.greatest(F.col("at") - around, F.lit(0))
    code = F.array_join(F.slice("ls", first + 1, F.col("at") + around - first + 1), "\n")
    return hit.select("path", (F.col("at") + 1).cast("long").alias("line_number"), code.alias("code")).dropDuplicates(["path", "line_number"])
