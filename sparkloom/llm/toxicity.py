"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits (A-Z lower-cased). Features are the distinct unigrams,
bigrams and pairs with one or two words between, hashed into 2**bits buckets. Per-coordinate
rates and the L1 term leave few weights, which are broadcast (at most 2**bits, a fixed bound).

Defined results: a null or empty text has no features and scores the intercept alone; without
labelled rows every score is 0; null labels are no labels; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import NOT_ALNUM, append_columns, mix, pick, table, text_steps


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20
    #: At most so many labelled documents are fitted, those with the smallest hash of the id.
    max_train_docs: int = 12_000
    epochs: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.1
    threshold: float = 0.3


def features(words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, bucket) of every n-gram and skip-gram, repeats included."""
    h, doc = words.hash, words.doc
    docs, buckets = [doc], [h >> np.uint64(64 - bits)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = mix(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(5) + np.uint64(gap))
            docs.append(doc[:-gap][same])
            buckets.append(pair[same] >> np.uint64(64 - bits))
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def distinct_features(words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    doc, bucket = features(words, bits)
    key = np.unique((doc.astype(np.int64) << bits) | bucket)
    return key >> bits, key & ((1 << bits) - 1)


class Ftrl:
    """Per-coordinate FTRL-proximal with an intercept that has no L1 term."""

    def __init__(self, p: ToxicityParams):
        self.p, self.z, self.n = p, np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, p = self.z[at], self.p
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, p.l1)
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2), 0.0)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, p: ToxicityParams = ToxicityParams()) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits (id, text, label): (buckets, weights, intercept). One task reads at most max_train_docs rows."""

    def run(batches):
        model, docs, ys, ids = Ftrl(p), [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            ys += b.column(2).to_pylist()
            for i, j, words in text_steps(b.column(1), NOT_ALNUM):
                doc, bucket = distinct_features(words, p.bits)
                docs += [x.astype(np.int32) for x in np.split(bucket, np.searchsorted(doc, np.arange(1, j - i)))]
        order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(str(ids[k]).encode()), ids[k], ys[k], len(docs[k])))
        for _ in range(p.epochs):
            for k in order:
                model.learn(docs[k], ys[k])
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w) if ids else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["bucket", "weight"])

    model = labelled.repartition(1).mapInArrow(run, "bucket long, weight double").toArrow()
    at, w = model["bucket"].to_numpy(), model["weight"].to_numpy()
    inner = at < (1 << p.bits)
    return at[inner], w[inner], float(w[~inner].sum())


def training_rows(docs: DataFrame, labels: DataFrame, label: str, p: ToxicityParams, learn_from, id_col: str = "doc_id", text: str = "text", label_id: str = "doc_id") -> DataFrame:
    """The bounded labelled sample: ids are chosen in the labels table, then only their texts are read."""
    ids = pick(labels, id=label_id, label=label).where("id is not null and label is not null").where(learn_from(F.col("id")))
    ids = table(ids.groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(p.max_train_docs), "sample")
    d = pick(docs, id=id_col, text=text)
    return d.join(F.broadcast(ids), "id").select("id", "text", "label")  # bounded by max_train_docs


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], p: ToxicityParams = ToxicityParams(), text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold)."""
    at, w, intercept = model
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), w))
    empty = len(at) == 0 and intercept == 0

    def make(column):
        at, w = sent.value
        dense = np.zeros(1 << p.bits)
        dense[at] = w
        used = dense != 0
        out = np.full(len(column), intercept)
        for i, j, words in text_steps(column, NOT_ALNUM):
            doc, bucket = features(words, p.bits)
            on = used[bucket]
            key = np.unique((doc[on].astype(np.int64) << p.bits) | bucket[on])
            out[i:j] += np.bincount(key >> p.bits, dense[key & ((1 << p.bits) - 1)], minlength=j - i)
        s = np.zeros(len(out)) if empty else 1 / (1 + np.exp(-np.clip(out, -35, 35)))
        return pa.array(s, pa.float64()), pa.array((s >= p.threshold).astype(np.int32), pa.int32())

    return append_columns(docs, make, T.StructType().add("score", "double").add("predicted", "integer"), text)
