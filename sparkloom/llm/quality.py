"""Quality: hierarchical empirical Bayes over a document classifier, hosts and paths.

A logistic classifier on byte-level features of the whole text gives each document's evidence. Grouped
aggregation gives, for each host and each path below it, the labelled counts and the classifier's
mean over unlabelled documents (at a small weight). A host's rate is shrunk toward the global rate, a
path's toward its host's, with prior strengths estimated by moments from the groups themselves, so sparse
sites fall back on their parents. Posterior odds = classifier odds / training odds * site odds.

Defined results: a null host or path is a site of its own; a document without a label counts by
its evidence; without labels every posterior is 0.5, which is kept; a null text is an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Words, append_columns, buffers, distinct, pick, small_join, steps, table

FEATURES = ("log_words", "word_bytes", "distinct", "repeats", "upper", "marks", "bangs", "bars", "digits", "pairs")


@dataclass(frozen=True)
class QualityParams:
    #: At most so many labelled documents are fitted, those with the smallest hash of the id.
    max_train_docs: int = 20_000
    ridge: float = 1e-3
    #: Weight of an unlabelled document's evidence against a label's.
    soft: float = 0.05
    threshold: float = 0.5


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES)."""
    raw, off = buffers(column)
    out = np.zeros((len(off) - 1, len(FEATURES)))
    for i, j in steps(off):
        data = raw[off[i] : off[j]]
        w = Words(data, off[i : j + 1])
        n_docs = j - i
        n = w.counts()
        size = np.maximum(np.diff(off[i : j + 1]), 1)
        d = np.repeat(np.arange(n_docs), np.diff(off[i : j + 1]))
        share = lambda mask: np.bincount(d[mask], minlength=n_docs) / size
        upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        same = w.doc[1:] == w.doc[:-1]
        pair = (w.hash[1:] + w.hash[:-1] * np.uint64(3))[same]
        per = np.maximum(n, 1)
        out[i:j] = np.stack(
            [
                np.log1p(n),
                np.bincount(w.doc, w.end - w.start, minlength=n_docs) / per,
                _distinct(w.doc, w.hash, n_docs) / per,
                np.bincount(w.doc[1:][same & (w.hash[1:] == w.hash[:-1])], minlength=n_docs) / per,
                np.bincount(d[upper], minlength=n_docs) / np.maximum(np.bincount(d[upper | lower], minlength=n_docs), 1),
                share((data < 128) & ~upper & ~lower & (data > 32)),
                share(data == 33),
                share(data == 124),
                share((data >= 48) & (data <= 57)),
                _distinct(w.doc[1:][same], pair, n_docs) / per,
            ],
            1,
        )
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(distinct(doc, h, n_docs)[0], minlength=n_docs)


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last is the intercept
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.concatenate([z, z**2, np.ones((len(x), 1))], 1)
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float) -> Classifier:
    """Logistic regression on the features and their squares, by Newton steps."""
    k = len(FEATURES)
    if not len(y):
        return Classifier(np.zeros(k), np.ones(k), np.zeros(2 * k + 1), 0.5)
    c = Classifier(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(2 * k + 1), float((y.sum() + 1) / (len(y) + 2)))
    z = np.clip((x - c.mean) / c.scale, -8, 8)
    z = np.concatenate([z, z**2, np.ones((len(x), 1))], 1)
    for _ in range(25):
        q = c.probability(x)
        h = (z * (q * (1 - q) + 1e-6)[:, None]).T @ z + ridge * len(y) * np.eye(2 * k + 1)
        step = np.linalg.solve(h, z.T @ (y - q) - ridge * len(y) * c.weight)
        c.weight = c.weight + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return c


def train(docs: DataFrame, labels: DataFrame, p: QualityParams, learn_from, id_col="doc_id", text="text", label="quality", label_id="doc_id") -> Classifier:
    ids = pick(labels, id=label_id, y=label).where("id is not null and y is not null").where(learn_from(F.col("id")))
    ids = table(ids.groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(p.max_train_docs), "sample")
    d = pick(docs, id=id_col, text=text).join(F.broadcast(ids), "id")  # bounded by max_train_docs
    got = append_columns(d, _feature_arrays, _feature_schema(), "text").select("id", "y", *FEATURES).orderBy("id", *FEATURES).toArrow()
    return fit(np.stack([got[f].to_numpy() for f in FEATURES], 1), got["y"].to_numpy(), p.ridge)


def _feature_arrays(column):
    return [pa.array(c) for c in features(column).T]


def _feature_schema() -> T.StructType:
    s = T.StructType()
    for f in FEATURES:
        s = s.add(f, "double")
    return s


def with_evidence(docs: DataFrame, c: Classifier, text: str = "text", name: str = "p_doc") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(c)
    return append_columns(docs, lambda column: [pa.array(sent.value.probability(features(column)))], T.StructType().add(name, "double"), text)


def _strength(groups: DataFrame, rate: str) -> float:
    """Beta prior strength by moments: how far groups' labelled rates differ beyond chance from `rate`."""
    r = F.col("good") / F.col("n")
    m = F.col(rate)
    s = groups.where("n > 0").agg(F.sum(F.col("n") * (r - m) ** 2).alias("v"), F.sum(m * (1 - m)).alias("e"), F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("n2"), F.count("*").alias("j"), F.avg(m * (1 - m)).alias("b")).first()
    if not s["n"] or s["j"] < 2 or s["n"] <= s["n2"] / s["n"]:
        return 50.0
    between = max((s["v"] - s["e"]) / (s["n"] - s["n2"] / s["n"]), 1e-6)
    return float(np.clip(s["b"] / between - 1, 1.0, 1e5))


def sites(evidence: DataFrame, labels: DataFrame, p: QualityParams, learn_from, label: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """(id, host, path, p_doc) to the shrunk rate of each (host, path): host, path, host_rate, path_rate."""
    y = pick(labels, id=label_id, y=label).where("id is not null and y is not null").where(learn_from(F.col("id"))).groupBy("id").agg(F.max(F.col("y").cast("double")).alias("y"))
    one = F.col("y").isNotNull()
    per = evidence.join(y, "id", "left").groupBy("host", "path").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("good"), F.sum(F.when(one, 0.0).otherwise(1.0)).alias("m"), F.sum(F.when(one, 0.0).otherwise(F.col("p_doc"))).alias("soft"))
    paths = table(per, "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    hosts = table(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "good", "m", "soft")]).withColumn("rate", F.lit(rate)), "hosts")

    def shrunk(parent, k):
        return (F.col("good") + p.soft * F.col("soft") + k * F.col(parent)) / (F.col("n") + p.soft * F.col("m") + k)

    hosts = table(hosts.withColumn("host_rate", shrunk("rate", _strength(hosts, "rate"))).select("host", "host_rate"), "hosts")
    h = hosts.withColumnRenamed("host", "h")
    paths = table(paths.join(h, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "paths")
    return table(paths.withColumn("path_rate", shrunk("host_rate", _strength(paths, "host_rate"))).select("host", "path", "host_rate", "path_rate"), "sites")


def posterior(evidence: DataFrame, rates: DataFrame, c: Classifier, p: QualityParams, host: str = "host", path: str = "path") -> DataFrame:
    """evidence with host_rate, path_rate, posterior and keep."""
    r = rates.select(F.struct(F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path")).alias("site"), "host_rate", "path_rate")
    e = evidence.withColumn("site", F.struct(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")))
    logit = lambda x: F.log(x / (1 - x))
    safe = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    out = small_join(e, r, ["site"], "left").drop("site")
    odds = logit(safe(F.col("p_doc"))) - float(np.log(c.prior / (1 - c.prior))) + logit(safe(F.col("path_rate")))
    return out.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("posterior") >= p.threshold)
