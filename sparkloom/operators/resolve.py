"""Resolution of references to symbols by import scope, context and proximity, as minima by equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dirname, last_component, module_path
from ..store import by_shuffle, written

#: Names asked for in more modules than this look their modules up by equal text instead of trying each in each path.
FEW_MODULES = 32


def import_scope(refs: DataFrame) -> DataFrame:
    """path, local, full: what a name means in a file; of several imports the one nearest the top counts."""
    local = F.coalesce("alias", last_component(F.col("name")))
    return refs.where("ref_kind = 'import'").groupBy("path", local.alias("local")).agg(F.min_by("name", F.struct("line", "name")).alias("full"))


def nearest(refs: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """refs (ref_id, path, keys) with symbol_id: among symbols (keys, to_path, symbol_id) of equal keys, the nearest to path.

    Nearest: same file, same folder, below the folder above, elsewhere; then the smallest id. Each tier is
    a minimum by an equal key, so a frequent name costs its rows, not their pairs. References without a symbol of
    their keys are left out; null keys match nothing.
    """
    least = F.min("symbol_id")
    files = symbols.groupBy(*keys, "to_path").agg(least.alias("t0"))
    folders = files.groupBy(*keys, dirname(F.col("to_path")).alias("folder")).agg(F.min("t0").alias("t1"))
    any_ = files.groupBy(*keys).agg(F.min("t0").alias("t3"))
    r = refs.withColumn("folder", dirname(F.col("path"))).withColumn("above", dirname(F.col("folder")))
    asked = r.where("above <> ''").select(*keys, "above").distinct()
    # a path's prefixes of the lengths that the folders above have: their number is bounded by the longest path
    sizes = asked.agg(F.coalesce(F.collect_set(F.length("above")), F.array().cast("array<int>")).alias("sizes"))
    heads = files.join(F.broadcast(sizes)).select(*keys, "t0", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length("to_path")), lambda n: F.substring("to_path", F.lit(1), n))).alias("above"))  # one row
    below = heads.join(by_shuffle(asked), [*keys, "above"], "left_semi").groupBy(*keys, "above").agg(F.min("t0").alias("t2"))
    out = r.join(by_shuffle(any_), keys).join(by_shuffle(files.withColumnRenamed("to_path", "path")), [*keys, "path"], "left").join(by_shuffle(folders), [*keys, "folder"], "left").join(by_shuffle(below), [*keys, "above"], "left")
    return out.withColumn("symbol_id", F.coalesce("t0", "t1", "t2", "t3")).select(*refs.columns, "symbol_id")


def holding(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """asked (target, module) with to_path, symbol_id: the symbols of that target whose path holds the module.

    A target with few modules tries each in each of its paths. One with many has all parts of its paths that are as
    long as one of its modules, and finds them by an equal key, so its cost is its paths, not their pairs with modules.
    """
    asks = asked.groupBy("target").agg(F.count("*").alias("n"), F.collect_set(F.length("module")).alias("sizes"))
    s = written(symbols.groupBy("target", "to_path").agg(F.min("symbol_id").alias("symbol_id")).join(by_shuffle(asks), "target"), "asked_for")
    columns = ("target", "module", "to_path", "symbol_id")
    few = s.where(F.col("n") <= FEW_MODULES).join(by_shuffle(asked), "target").where(F.col("to_path").contains(F.col("module"))).select(*columns)
    starts = lambda n: F.sequence(F.lit(1), F.length("to_path") - n + 1)
    parts = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length("to_path")), lambda n: F.transform(starts(n), lambda i: F.substring("to_path", i, n))))
    many = s.where(F.col("n") > FEW_MODULES).select("target", "to_path", "symbol_id", F.explode(F.array_distinct(parts)).alias("module"))
    return few.unionByName(many.join(by_shuffle(asked), ["target", "module"]).select(*columns))


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (ref_id, path, ref_kind, name, alias, context, line) with the symbol_id that each means, where there is one.

    A call's module is its context's import, or its context, or its own import; an import's module is its path
    before the last component. Symbols whose path holds the module come first, then the nearer, then the smaller id.
    """
    scope = import_scope(refs)
    ctx = scope.select(F.col("path").alias("sp"), F.col("local").alias("sl"), F.col("full").alias("ctx_full"))
    own = scope.select(F.col("path").alias("op"), F.col("local").alias("ol"), F.col("full").alias("own_full"))
    r = refs.join(by_shuffle(ctx), (F.col("path") == F.col("sp")) & (F.col("context") == F.col("sl")), "left").drop("sp", "sl")
    r = r.join(by_shuffle(own), (F.col("path") == F.col("op")) & (F.col("name") == F.col("ol")) & F.col("context").isNull(), "left").drop("op", "ol")
    whole = F.when(F.col("ref_kind") == "import", F.col("name")).otherwise(F.col("own_full"))
    before = F.regexp_extract(whole, "^(.*?)(?:::|\\.|/)[^:./]*$", 1)
    r = r.withColumn("target", F.when(whole.isNotNull(), last_component(whole)).otherwise(last_component(F.col("name"))))
    r = written(r.withColumn("module", module_path(F.coalesce("ctx_full", "context", before, F.lit("")))), "refs")
    s = symbols.select(F.col("name").alias("target"), "symbol_id", F.col("path").alias("to_path"))
    # the symbols of each name whose path holds the module, found once for each name, module and path
    asked = r.where("module <> ''").select("target", "module").distinct()
    held = written(holding(asked, s), "held")
    first = nearest(r, held, ["target", "module"])
    rest = nearest(r.join(by_shuffle(held.select("target", "module").distinct()), ["target", "module"], "left_anti"), s, ["target"])
    return first.unionByName(rest).select("ref_id", "path", "ref_kind", "name", "line", "symbol_id")
