"""Mixing to target weights: iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells of (source, language, topic). Token weights of the cells are raked in turn to
the target marginals of source, language and topic; the result keeps the cells' interaction and meets all
three. A weight above 1 is no probability, so the weights are calibrated to probabilities that still meet all
three, with nearly as many tokens as the scarcest target lets a sample without repeats hold; `rate` thins that
further, and `least` asks for a larger sample at the price of the scarcest targets.
A document is kept with its cell's probability, decided by a hash of its id, so a rerun decides alike. report()
says which targets are not met.

Targets: by default each marginal is its present share to the power `alpha`, made to sum to 1 (smaller
sources, languages and topics gain). Other targets: a DataFrame (value, share) for a dimension; values
without a share get weight 0, and the shares of values without tokens go to the others in proportion.

Topics are formats of the text that native functions can tell: `tabular`, `shouting`, `short`, `prose`.

Defined results: null keys are a value of their own, '<null>'; a text without words has 0 tokens, and
is kept with its cell's probability; an empty table gives an empty result; repeated rows are
kept or dropped together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_join, table

DIMS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixingParams:
    alpha: float = 0.7
    sweeps: int = 8
    rate: float = 1.0
    #: The sample holds about this share of the tokens at least; targets that can't be met in it are missed, see report().
    least: float = 0.0
    seed: str = "mix"
    targets: dict = field(default_factory=dict)


def n_tokens(text):
    """Words `[^\\x20\\x09-\\x0D]+`: places where a word begins."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def topic(text, tokens):
    t = F.coalesce(text, F.lit(""))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return F.when(count("|") * 10 > tokens, "tabular").when(count("!") * 4 > tokens, "shouting").when(tokens < 100, "short").otherwise("prose")


def key(c):
    return F.coalesce(c.cast("string"), F.lit("<null>"))


def uniform(id_col, seed: str):
    """A number in [0, 1) from the id: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key(id_col), F.lit(":" + seed)).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_goals(cells: DataFrame, p: MixingParams, all_tokens: float) -> DataFrame:
    """cells with the target share of each dimension's value, {d}_goal; the values that hold tokens share 1."""
    w = cells
    for d in DIMS:
        own = table(cells.groupBy(d).agg(F.sum("tokens").alias("n")), "marginal")
        if d in p.targets:
            given = p.targets[d].select(key(F.col("value")).alias(d), F.col("share").alias("share"))
            raw = own.join(given, d).where("n > 0").select(d, "share")
        else:
            raw = own.select(d, F.pow(F.col("n") / F.lit(float(max(all_tokens, 1))), p.alpha).alias("share"))
        norm = raw.agg(F.sum("share")).first()[0] or 1.0
        w = w.join(raw.select(d, (F.col("share") / norm).alias(f"{d}_goal")), d, "left").withColumn(f"{d}_goal", F.coalesce(f"{d}_goal", F.lit(0.0)))
    return w


def sweep(w: DataFrame, p: MixingParams, column: str, total: float, bounded: bool = False) -> DataFrame:
    """Sweeps of raking `column` to marginals that sum to `total` tokens; bounded ones keep it at 1 at most."""
    for k in range(p.sweeps):
        for d in DIMS:
            now = F.sum(F.col("tokens") * F.col(column)).over(Window.partitionBy(d))
            x = F.when(F.col("now") > 0, F.col(column) * F.col(f"{d}_goal") * total / F.col("now")).otherwise(F.col(column))
            w = w.withColumn("now", now).withColumn(column, F.least(F.lit(1.0), x) if bounded else x).drop("now")
        if k % 4 == 3:
            w = table(w, "raked")
    return w


def total_tokens(cells: DataFrame) -> float:
    return float(cells.agg(F.sum("tokens")).first()[0] or 0)


def rake(cells: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """Cells (source, lang, topic, tokens) with weight: tokens * weight has the target marginals."""
    n = total_tokens(cells)
    w = sweep(with_goals(cells, p, n).withColumn("weight", F.lit(1.0)), p, "weight", n)
    return table(w.select(*DIMS, "tokens", "weight", *[f"{d}_goal" for d in DIMS]), "raked")


def capped(own: DataFrame, d: str, total: float) -> DataFrame:
    """d and {d}_goal from (d, n, goal): shares of `total` in proportion to goal, but no value above its n tokens."""
    scale, before = total, 0.0
    while scale != before:
        before = scale
        full = F.col("n") <= F.col("goal") * scale
        used, left = own.agg(F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("goal")))).first()
        scale = max(scale, (total - (used or 0)) / left) if left else scale
    return own.select(d, (F.least(F.col("n").cast("double"), F.col("goal") * scale) / total).alias(f"{d}_goal"))


def calibrate(raked: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """rake(cells) with probability: tokens * probability has the target marginals too, in a smaller total.

    No sample without repeats can hold more than the smallest own share / target share of the tokens. Sweeps
    bounded by 1 aim at that total. Sweeps without the bound then mend the marginals, and all is divided
    by the largest result, so that none passes 1. If p.least asks for a larger total, values too scarce for their
    targets are kept whole as far as the other dimensions allow, and the others share the rest by their targets.
    """
    n = total_tokens(raked)
    most, own = 1.0, {}
    for d in DIMS:
        own[d] = table(raked.groupBy(d).agg(F.sum("tokens").alias("n"), F.first(f"{d}_goal").alias("goal")).where("n > 0 and goal > 0"), "own")
        least = own[d].agg(F.min(F.col("n") / F.col("goal"))).first()[0]
        most = min(most, least / n) if least is not None else most
    if most < p.least:
        goals = raked
        for d in DIMS:
            goals = goals.drop(f"{d}_goal").join(capped(own[d], d, n * p.least), d, "left").withColumn(f"{d}_goal", F.coalesce(f"{d}_goal", F.lit(0.0)))
        w = sweep(goals.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * p.least)), p, "probability", n * p.least, True)
        w = raked.join(w.select(*DIMS, "probability"), list(DIMS))
    else:
        w = raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * most))
        w = sweep(sweep(w, p, "probability", n * most, True), p, "probability", n * most)
    w = table(w, "calibrated")
    largest = max(1.0, w.where("tokens > 0").agg(F.max("probability")).first()[0] or 0.0)
    return w.withColumn("probability", F.least(F.lit(1.0), F.col("probability") / largest * p.rate))


def report(calibrated: DataFrame, p: MixingParams = MixingParams(), tolerance: float = 0.01) -> DataFrame:
    """Per dim and value: own, target and expected shares of the tokens, and whether the target is met.

    Not met are targets of values without tokens, and targets that contradict each other.
    """
    n, kept = total_tokens(calibrated), calibrated.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 0.0
    out = None
    for d in DIMS:
        got = calibrated.groupBy(F.col(d).alias("value")).agg((F.sum("tokens") / max(n, 1.0)).alias("own"), F.first(f"{d}_goal").alias("goal"), (F.sum(F.col("tokens") * F.col("probability")) / (kept or 1.0)).alias("expected"))
        if d in p.targets:
            got = got.join(p.targets[d].select(key(F.col("value")).alias("value"), F.col("share").cast("double").alias("share")), "value", "full").select("value", "own", F.coalesce("share", F.lit(0.0)).alias("goal"), "expected")
        got = got.select(F.lit(d).alias("dim"), "value", F.coalesce("own", F.lit(0.0)).alias("own"), F.col("goal").alias("target"), F.coalesce("expected", F.lit(0.0)).alias("expected"))
        out = got if out is None else out.unionByName(got)
    return out.withColumn("met", F.abs(F.col("expected") - F.col("target")) <= tolerance * F.col("target"))


def with_cells(docs: DataFrame, id_col="doc_id", text="text", source="source", lang="lang") -> DataFrame:
    """docs with mix_tokens and the cell's keys, mix_source, mix_lang and mix_topic."""
    d = docs.withColumn("mix_tokens", n_tokens(F.col(text)))
    return d.withColumn("mix_topic", topic(F.col(text), F.col("mix_tokens"))).withColumn("mix_source", key(F.col(source))).withColumn("mix_lang", key(F.col(lang)))


def weights(celled: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """The raked cells of with_cells(docs), and their probability."""
    cells = table(celled.groupBy(*[F.col(f"mix_{d}").alias(d) for d in DIMS]).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    return calibrate(rake(cells, p), p)


def mix(docs: DataFrame, p: MixingParams = MixingParams(), id_col="doc_id", text="text", source="source", lang="lang") -> DataFrame:
    """docs with mix_tokens, mix_source, mix_lang, mix_topic, weight, probability and sampled."""
    celled = with_cells(docs.drop("weight", "probability", "sampled"), id_col, text, source, lang)
    w = table(weights(celled, p).select(*[F.col(d).alias(f"mix_{d}") for d in DIMS], "weight", "probability"), "weights")
    out = small_join(celled, w, [f"mix_{d}" for d in DIMS], "left")
    return out.withColumn("sampled", uniform(F.col(id_col), p.seed) < F.col("probability"))
