"""Nearest neighbours from randomly rotated one-bit codes.

A vector is centred, rotated into `expand` times as many dimensions and kept as packed signs with two
correction scalars: its centred length and the cosine between signs and rotated direction. A query's inner
product is estimated from the signs; the error bound says which vectors must be reranked with their
original values, in double precision. A vector is left out only if estimate + bound is below the
query's k-th best score so far.

All queries meet all rows in blocks: a block of at most `query_block` queries is broadcast (a fixed
bound) and every task keeps each query's k best. A bounded sample gives first thresholds, and rows come in
slices that grow eightfold, so that a query's results shuffled are about 8 k a slice, not k a task. Estimate,
bound and threshold are one matrix product for each step, in single precision.

Any finite scale will do: estimates are made of vectors divided by a power of two near the largest component
and of queries of length 1; ranking uses inner products with the query divided by a power of two, which
neither overflow nor round otherwise than the plain ones. A score beyond double's range is given as infinite.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part; null ids take no part; rows with one id are queries and candidates each for itself, so
that their id has k rows for each of them; ties go to smaller ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, table


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    expand: int = 2
    #: Standard deviations of the estimate's error that the bound allows.
    eps: float = 4.0
    #: Rows fitted for the centre and searched for the first thresholds, those with the smallest hash of the id.
    sample: int = 8192
    query_block: int = 8192
    growth: int = 8
    seed: int = 11


#: Allows for single precision in the estimates.
SLACK = 1e-4


@dataclass
class Rotation:
    centre: np.ndarray
    turn: np.ndarray  # (expand * dim, dim), orthonormal columns
    scale: float  # a power of two that brings the components below 1


def rotation(sample: np.ndarray, scale: float, p: AnnParams) -> Rotation:
    dim = sample.shape[1]
    g = np.random.default_rng(p.seed).standard_normal((p.expand * dim, dim))
    return Rotation((sample * scale).mean(0), np.linalg.qr(g)[0], scale)


def encode(x: np.ndarray, r: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, centred length, cosine of signs and direction), of the scaled vectors."""
    o = x * r.scale - r.centre
    length = np.linalg.norm(o, axis=1)
    t = (o / np.where(length > 0, length, 1)[:, None]) @ r.turn.T
    return np.packbits(t > 0, axis=1), length, np.maximum(np.abs(t).sum(1) / np.sqrt(t.shape[1]), 1e-6)


def left_side(codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, bits: int, eps: float) -> np.ndarray:
    """Rows (signs times their factor, error bound, 1): times right_side, estimate + bound - threshold for each query."""
    out = np.empty((len(codes), bits + 2), np.float32)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    np.multiply(signs * 2 - 1, (length / (cosine * np.sqrt(bits))).astype(np.float32)[:, None], out=out[:, :bits])
    out[:, bits] = length * eps * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine / np.sqrt(bits - 1)
    out[:, bits + 1] = 1
    return out


def right_side(q: np.ndarray, r: Rotation) -> np.ndarray:
    """Columns for queries q of length 1; the threshold is still to be taken from the last row."""
    out = np.empty((r.turn.shape[0] + 2, len(q)), np.float32)
    out[:-2] = (q @ r.turn.T).T
    out[-2] = 1
    out[-1] = q @ r.centre
    return out


def halved(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row divided by the power of two above its largest component, and the exponents."""
    _, exponent = np.frexp(np.abs(q).max(1, initial=0))
    return np.ldexp(q, -exponent[:, None]), exponent


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score, then smaller id."""
    order = np.lexsort((uids, ids, -score, q))
    g = q[order]
    first = np.searchsorted(g, g)
    return order[np.arange(len(order)) - first < k]


class Search:
    """One task's search: keeps k best of each query of a block over all rows that it is shown.

    Scores are inner products of x / 2**shrink with q / 2**exponent.
    """

    def __init__(self, q_uid: np.ndarray, q: np.ndarray, floor: np.ndarray, r: Rotation, shrink: int, p: AnnParams):
        self.q_uid, self.r, self.p, self.shrink = q_uid, r, p, shrink
        self.q, self.exponent = halved(q)
        self.norm = np.linalg.norm(self.q, axis=1)
        self.right = right_side(self.q / self.norm[:, None], r)
        self.about = self.right[-1].copy()
        self.floor = floor.copy()  # no row below this score is among the k best
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.lift()

    def lift(self) -> None:
        floor = np.ldexp(self.floor, self.shrink) * self.r.scale / self.norm
        self.right[-1] = self.about - np.clip(floor, -1e30, 1e30).astype(np.float32)

    def add(self, ids, uids, x, codes, length, cosine) -> None:
        step = max(1, (1 << 22) // max(len(self.q), 1))
        x = np.ldexp(x, -self.shrink) if self.shrink else x
        for i in range(0, len(ids), step):
            s = slice(i, i + step)
            left = left_side(codes[s], length[s], cosine[s], self.r.turn.shape[0], self.p.eps)
            row, q = np.nonzero(left @ self.right >= -SLACK)
            for a in range(0, len(row), 1 << 15):
                rr, qq = row[a : a + (1 << 15)], q[a : a + (1 << 15)]
                exact = np.einsum("ij,ij->i", x[s][rr], self.q[qq])
                found = uids[s][rr]
                ok = (exact >= self.floor[qq]) & (found != self.q_uid[qq])
                self.held = tuple(np.concatenate([h, n[ok]]) for h, n in zip(self.held, (qq, exact, ids[s][rr], found), strict=True))
                if len(self.held[0]) > 4 * self.p.k * len(self.q) + (1 << 15):
                    self.trim()
            self.trim()

    def trim(self) -> None:
        q, score, ids, uids = self.held
        at = best(q, score, ids, uids, self.p.k)
        self.held = q, score, ids, uids = q[at], score[at], ids[at], uids[at]
        n = np.bincount(q, minlength=len(self.q))
        ends = np.cumsum(n)
        full = np.flatnonzero(n == self.p.k)
        self.floor[full] = np.maximum(self.floor[full], score[ends[full] - 1])
        self.lift()

    def batch(self, q_ids: np.ndarray) -> pa.RecordBatch:
        q, y, ids, uids = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.q_uid[q], pa.int64()), pa.array(q_ids[q], pa.int64()), pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(y), pa.array(np.ldexp(y, self.exponent[q] + self.shrink))], names=NAMES)


NAMES = ["q", "query_id", "uid", "vec", "y", "score"]
FOUND = "q long, query_id long, uid long, vec long, y double, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _index(d: DataFrame, p: AnnParams, dim: int, n: int, top: float) -> tuple[DataFrame, Rotation, float, int]:
    """The written index (id, uid, u, vec, code, length, cosine), its rotation, the u below which rows are the sample, its size."""
    u = (F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    size = min(p.sample, max(n // p.growth, 2 * p.k))
    lowest = d.select("vec", u).orderBy("u").limit(size + 1).toArrow()
    low = 1.0 if n <= size else max(lowest["u"].to_pylist())  # the sample is all rows below it
    lowest = lowest.filter(pa.compute.less(lowest["u"], low))
    sample = _matrix(lowest["vec"]) if len(lowest) else np.zeros((1, dim))  # none: as many copies of one id as the sample has rows
    r = rotation(sample, float(np.ldexp(1.0, -int(np.frexp(top)[1]))), p)
    sent = d.sparkSession.sparkContext.broadcast(r)

    def index(batches):
        for b in batches:
            if b.num_rows:
                codes, length, cosine = encode(_matrix(b.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(cosine)], names=["id", "vec", "u", "code", "length", "cosine"])

    coded = d.select("id", "vec", u).mapInArrow(index, "id long, vec array<double>, u double, code binary, length double, cosine double")
    return table(coded.withColumn("uid", F.monotonically_increasing_id()), "codes"), r, low if len(lowest) else 0.0, size


def search(df: DataFrame, is_query, p: AnnParams = AnnParams(), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id_col, score: each query row's k nearest other rows by inner product."""
    spark = df.sparkSession
    d = pick(df, id=id_col, vec=vector).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    v = F.col("vec")
    d = d.where("id is not null and vec is not null").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    shape = d.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return empty
    dim, n, top = shape
    shrink = max(0, int(np.frexp(top)[1]) - 1000)
    indexed, r, low, size = _index(d.where(F.size("vec") == dim), p, dim, n, top)
    queries = table(indexed.where(is_query(F.col("id"))).select("uid", "id", "vec"), "queries")
    n_queries = queries.count()
    if not n_queries:
        return empty
    blocks = -(-n_queries // (p.query_block * 3 // 4)) if n_queries > p.query_block else 1
    edges = [0.0, low] if low else [0.0]
    while edges[-1] < 1:
        edges.append(min(1.0, max(edges[-1], size / n) * p.growth))
    sent_r = spark.sparkContext.broadcast(r)
    order = Window.partitionBy("q").orderBy(F.desc("y"), "vec", "uid")
    out = None
    for block in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(blocks)) == block).toArrow().sort_by("uid")
        q_uid, q_ids, q = got["uid"].to_numpy(), got["id"].to_numpy(), _matrix(got["vec"])
        floor, held = np.full(len(q), -np.inf), None
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            sent = spark.sparkContext.broadcast((q_uid, q_ids, q, floor))

            def run(batches, sent=sent):
                q_uid, q_ids, q, floor = sent.value
                s = Search(q_uid, q, floor, sent_r.value, shrink, p)
                for b in batches:
                    if b.num_rows:
                        codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                        s.add(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)), codes, b.column(4).to_numpy(), b.column(5).to_numpy())
                yield s.batch(q_ids)

            new = indexed.where((F.col("u") >= lo) & (F.col("u") < hi)).select("id", "uid", "vec", "code", "length", "cosine").mapInArrow(run, FOUND)
            ranked = (new.union(held.select(*NAMES)) if held is not None else new).withColumn("rank", F.row_number().over(order))
            held = table(ranked.where(F.col("rank") <= p.k), "top")
            if hi < 1:
                last = held.where(F.col("rank") == p.k).select("q", "y").toArrow()
                at = np.searchsorted(q_uid, last["q"].to_numpy())
                floor[at] = np.maximum(floor[at], last["y"].to_numpy())
        out = held if out is None else out.union(held)
    return out.select("query_id", "rank", F.col("vec").alias(id_col), "score")
