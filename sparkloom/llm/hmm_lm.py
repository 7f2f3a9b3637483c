"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact scaled forward scores.

Tokens are words (A-Z lower-cased), then one end. A state emits a symbol, a symbol a word: the `own_words`
most frequent words and the end are symbols of their own, every other word belongs to the symbol of its
first two and last three bytes (hashed into `affix_symbols`). Within a symbol a word has the share
(c+1)/(N_s+V_s+1) of its training count, with one share for all unknown words, as in the base score. So
the state tables have a fixed size, and
    log10 P(text) = log10 forward(symbols) + sum over tokens of log10 share(word | symbol).

Counts cover every training document. Texts are read twice, once to count words and once to write each row's
symbols (two bytes a token), which training and scoring read. Baum-Welch starts from the counts of a small
hash part of the training documents, then goes through all of them in each of `passes` passes: counts are summed by a grouped
aggregation and replace those before. It stops early when the likelihood rises by less than `tolerance`.

Nothing is cut: sequences are handled in segments, side by side, and the transfer matrix of each segment carries the forward and
backward variables across the cuts exactly, as it does across the steps of a text too long for one step.

Counts of the `head_words` most frequent words are broadcast (a fixed bound); the rest are joined by a shuffle.

Defined results: a null or empty text is the end alone; a null id counts as training and is not held out;
without training rows the base and the shares are those of N = V = 0; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, buffers, cuts, mix, pick, steps, table

END = np.uint64(0x9D3F1C2B4A5E6F70)


@dataclass(frozen=True)
class HmmParams:
    states: int = 8
    own_words: int = 4096
    affix_symbols: int = 4096
    head_words: int = 100_000
    #: Full passes at most, and the rise of log10 P a token below which no further one is made.
    passes: int = 3
    tolerance: float = 1e-3
    #: Sixteenths of the training documents, by hash, that the first passes see; their counts are dropped.
    warm_up: tuple[int, ...] = (1, 2)
    smoothing: float = 0.05
    seed: int = 7
    #: Tokens of a segment, tokens and bytes of a step.
    segment: int = 512
    step_tokens: int = 250_000
    step_bytes: int = 1 << 19

    @property
    def symbols(self) -> int:
        return self.own_words + 1 + self.affix_symbols


def affixes(words: Words, n: int) -> np.ndarray:
    """A symbol of 0 to n-1 for each word, from its first two and last three bytes."""
    b, s, e = words.bytes, words.start, words.end
    x = b[s].astype(np.uint64)
    for take, at in ((1, s + 1), (2, e - 1), (3, e - 2), (4, e - 3)):
        inside = (at >= s) & (at < e)
        x = x * np.uint64(257) + np.where(inside, b[np.where(inside, at, s)], take).astype(np.uint64)
    return (mix(x) % np.uint64(n)).astype(np.int64)


def word_steps(column: pa.Array, budget: int):
    """(first, end, Words, done): rows with at most `budget` bytes; a longer row comes in pieces, the last one with done."""
    raw, off = buffers(column)
    for i, j in steps(off, budget):
        if off[j] - off[i] <= budget:
            yield i, j, Words(raw[off[i] : off[j]], off[i : j + 1]), True
            continue
        one = raw[off[i] : off[j]]
        for a, z in cuts(one, budget):
            yield i, j, Words(one[a:z], np.array([0, z - a])), z == len(one)


def word_counts(docs: DataFrame, p: HmmParams) -> DataFrame:
    """(word hash, affix symbol, c) over all texts of docs (id, text); the end has symbol -1."""

    def run(batches):
        held: list[tuple] = []
        size = ends = 0

        def merged():
            h, a, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, a[first], np.bincount(back, c).astype(np.int64)

        def batch(u, a, c):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(a.astype(np.int64)), pa.array(c)], names=["h", "affix", "c"])

        for b in batches:
            ends += b.num_rows
            for _, _, w, _ in word_steps(b.column(1), p.step_bytes):
                u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((u, affixes(w, p.affix_symbols)[first], n))
                size += len(u)
                if size > 400_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 200_000:
                        yield batch(*held[0])
                        held, size = [], 0
        if ends:
            held.append((np.array([END]), np.array([-1]), np.array([ends])))
            yield batch(*merged())

    return docs.mapInArrow(run, "h long, affix long, c long").groupBy("h").agg(F.min("affix").alias("affix"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Bounded tables that every task gets: the head words, and the size of each symbol."""

    head: np.ndarray  # sorted hashes
    head_c: np.ndarray
    head_symbol: np.ndarray  # -1: by affix
    size: np.ndarray  # N_s + V_s + 1 by symbol
    N: int
    V: int

    def symbols(self, w: Words, p: HmmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, in head, count of head words) by word."""
        s = affixes(w, p.affix_symbols) + p.own_words + 1
        if not len(self.head):
            return s, np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        distinct, back = np.unique(w.hash, return_inverse=True)
        at = np.searchsorted(self.head, distinct)
        at[at == len(self.head)] = 0
        known = (self.head[at] == distinct)[back]
        at = at[back]
        own = known & (self.head_symbol[at] >= 0)
        s[own] = self.head_symbol[at[own]]
        return s, known, np.where(known, self.head_c[at], 0)


def lexicon(vocab: DataFrame, p: HmmParams) -> Lexicon:
    total = vocab.agg(F.sum("c").alias("N"), F.count("*").alias("V")).first()
    top = vocab.where("affix >= 0").orderBy(F.desc("c"), "h").limit(p.head_words).toArrow()
    h, c, a = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy(), top["affix"].to_numpy()
    own = np.arange(len(h)) < p.own_words
    size = np.ones(p.symbols)
    per = vocab.where("affix >= 0").groupBy("affix").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # at most affix_symbols rows
    at = per["affix"].to_numpy() + p.own_words + 1
    size[at] += per["n"].to_numpy() + per["v"].to_numpy()
    np.subtract.at(size, a[own] + p.own_words + 1, c[own] + 1.0)
    size[: own.sum()] = c[own] + 1.0
    size[p.own_words] = (vocab.where("affix = -1").agg(F.sum("c")).first()[0] or 0) + 1.0
    order = np.argsort(h)
    symbol = np.where(own, np.arange(len(h)), -1)
    return Lexicon(h[order], c[order], symbol[order], size, int(total["N"] or 0), int(total["V"]))


def coded(docs: DataFrame, lex: Lexicon, p: HmmParams) -> DataFrame:
    """(id, learn, text) to a table of id, learn, row, n_tokens, n_head, log_c, log_size, symbols (2 bytes each), h, k.

    log_c sums over head words and the end, log_size over all symbols; h and k are the other words and their counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        lex = sent.value
        log_size = np.log10(lex.size)
        end_c = float(lex.size[p.own_words] - 1)

        def rows(b, i, j, symbol, end_at, log_c, known, size, rest_doc, rest):
            """One batch of rows i to j; end_at are the ends of their symbols."""
            n = j - i
            order = np.lexsort((rest, rest_doc))
            rest_doc, rest = rest_doc[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(rest)))
            ends = pa.array(np.searchsorted(rest_doc[at], np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(rest[at].view(np.int64)), pa.array(times.astype(np.int32)))]
            data = symbol.astype("<u2").tobytes()
            edges = np.concatenate([[0], end_at]) * 2
            codes = pa.array([data[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            length = np.diff(edges) // 2
            return pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(length), pa.array(known + int(end_c > 0)), pa.array(log_c + math.log10(end_c + 1)), pa.array(size + log_size[p.own_words]), codes, *lists], names=["id", "learn", "n_tokens", "n_head", "log_c", "log_size", "symbols", "h", "k"])

        for b in batches:
            held: list[tuple] = []
            for i, j, w, done in word_steps(b.column(2), p.step_bytes):
                n = j - i
                symbol, known, c = lex.symbols(w, p)
                log_c = np.bincount(w.doc, np.log10(c + 1.0), minlength=n)
                size = np.bincount(w.doc, log_size[symbol], minlength=n)
                known_n, rest = np.bincount(w.doc[known], minlength=n), ~known
                if not done or held:  # pieces of one long row
                    held.append((symbol.astype(np.uint16), log_c, known_n, size, w.hash[rest]))
                    if done:
                        s, log_c, known_n, size, rest = zip(*held, strict=True)
                        s, rest = np.append(np.concatenate(s), np.uint16(p.own_words)), np.concatenate(rest)
                        yield rows(b, i, j, s, np.array([len(s)]), sum(log_c), sum(known_n), sum(size), np.zeros(len(rest), np.int64), rest)
                        held = []
                    continue
                ends = np.cumsum(w.counts() + 1)
                out = np.full(len(symbol) + n, p.own_words)
                out[np.arange(len(symbol)) + w.doc] = symbol
                yield rows(b, i, j, out, ends, log_c, known_n, size, w.doc[rest], w.hash[rest])

    id_type = docs.schema["id"].dataType.simpleString()
    out = docs.select("id", "learn", "text").mapInArrow(run, f"id {id_type}, learn boolean, n_tokens long, n_head long, log_c double, log_size double, symbols binary, h array<long>, k array<int>")
    return table(out.withColumn("row", F.monotonically_increasing_id()), "coded")


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (symbols, states): P(symbol | state)


def initial(p: HmmParams, lex: Lexicon) -> Hmm:
    rng = np.random.default_rng(p.seed)
    emit = lex.size[:, None] * rng.gamma(2.0, 1.0, (p.symbols, p.states))
    move = np.full((p.states, p.states), 0.1 / max(p.states - 1, 1)) + np.eye(p.states) * (0.9 - 0.1 / max(p.states - 1, 1))
    return Hmm(np.full(p.states, 1 / p.states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Packed:
    """Sequences in time-major order, the longest first: step t holds the t-th symbol of those that go on."""

    def __init__(self, symbol: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        n = length[self.order]
        first = (np.cumsum(length) - length)[self.order]
        top = int(n[0]) if len(n) else 0
        self.active = np.searchsorted(-n, -np.arange(top), side="left")  # sequences with more than t symbols
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.symbol = np.empty(len(symbol), np.int64)
        self.row = np.empty(len(symbol), np.int32)
        for t, k in enumerate(self.active):
            lo = self.at[t]
            self.symbol[lo : lo + k] = symbol[first[:k] + t]
            self.row[lo : lo + k] = np.arange(k)

    def back(self, by_row: np.ndarray) -> np.ndarray:
        out = np.empty_like(by_row)
        out[self.order] = by_row
        return out


def transfers(m: Hmm, x: Packed) -> np.ndarray:
    """For each sequence the matrix of emissions and moves from its first to its last symbol, up to a factor."""
    K, out = len(m.start), None
    for t, k in enumerate(x.active):
        e = m.emit[x.symbol[x.at[t] : x.at[t] + k]]
        if out is None:
            out = np.zeros((k, K, K))
            out[:, np.arange(K), np.arange(K)] = e
            continue
        now = (out[:k].reshape(-1, K) @ m.move).reshape(k, K, K) * e[:, None, :]
        out[:k] = now / now.sum((1, 2))[:, None, None] if t % 8 == 0 else now
    return x.back(out / out.sum((1, 2))[:, None, None])


class Step:
    """Sequences cut to segments, with the forward variables before and the backward ones after each segment.

    before: forward variables at the end of what precedes the first sequence, if that goes on; after: backward
    variables at the end of the last sequence, if it goes on.
    """

    def __init__(self, m: Hmm, symbol: np.ndarray, length: np.ndarray, p: HmmParams, before=None, after=None):
        self.m = m
        n = -(-length // p.segment)
        ends = np.cumsum(n)
        size = np.full(ends[-1], p.segment)
        size[ends - 1] = length - (n - 1) * p.segment
        self.doc = np.repeat(np.arange(len(n)), n)
        self.first, self.last = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
        self.first[ends - n], self.last[ends - 1] = before is None or np.arange(len(n)) > 0, True
        self.x = Packed(symbol, size)
        K = len(m.start)
        self.prev, self.after = np.zeros((ends[-1], K)), np.ones((ends[-1], K))
        if before is not None:
            self.prev[0] = before
        if after is not None:
            self.after[-1] = after
        self.many = np.flatnonzero(np.repeat((n > 1) | (np.arange(len(n)) == 0) & (before is not None), n))
        if len(self.many):
            inside = np.zeros(ends[-1], bool)
            inside[self.many] = True
            self.t = transfers(m, Packed(symbol[np.repeat(inside, size)], size[inside]))
            for s, t in zip(self.many, self.t, strict=True):
                if not self.last[s]:
                    v = (m.start if self.first[s] else self.prev[s] @ m.move) @ t
                    self.prev[s + 1] = v / v.sum()
            for s, t in zip(self.many[::-1], self.t[::-1], strict=True):
                if not self.first[s] and s:
                    v = m.move @ (t @ self.after[s])
                    self.after[s - 1] = v / v.sum()

    def whole(self) -> np.ndarray:
        """The transfer matrix of all segments, those of one sequence that has `before` or more than one."""
        out = self.t[0]
        for t in self.t[1:]:
            out = out @ self.m.move @ t
            out = out / out.sum()
        return out

    def forward(self, keep: bool = False):
        """ln P of each sequence, the last forward variables by segment; with keep all of them and the scales, time-major."""
        m, x = self.m, self.x
        begin = np.where(self.first[:, None], m.start, self.prev @ m.move)[x.order]
        scale = np.empty(len(x.symbol))
        kept = np.empty((len(x.symbol), len(m.start))) if keep else None
        end = np.empty_like(begin)
        a, ones = begin, np.ones(len(m.start))
        for t, k in enumerate(x.active):
            lo = x.at[t]
            a = (begin if t == 0 else a[:k] @ m.move) * m.emit.take(x.symbol[lo : lo + k], 0)
            s = a @ ones  # sums of short rows are faster as products
            a /= s[:, None]
            scale[lo : lo + k] = s
            if keep:
                kept[lo : lo + k] = a
            ended = x.active[t + 1] if t + 1 < len(x.active) else 0
            end[ended:k] = a[ended:]
        by_segment = x.back(np.bincount(x.row, np.log(scale), minlength=len(x.order)))
        ll = np.bincount(self.doc, by_segment)
        return (ll, x.back(end), kept, scale) if keep else (ll, x.back(end))

    def expected(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """ln P, and Baum-Welch counts of starts, moves and emissions."""
        m, x = self.m, self.x
        ll, end, alpha, scale = self.forward(keep=True)
        K = len(m.start)
        after = (self.after / (end * self.after).sum(1, keepdims=True))[x.order]
        moves = np.zeros((K, K))
        beta, nk = np.zeros((0, K)), 0
        for t in range(len(x.active) - 1, -1, -1):
            lo, k = x.at[t], x.active[t]
            now = after[:k].copy()
            if nk:
                nl = x.at[t + 1]
                ahead = m.emit.take(x.symbol[nl : nl + nk], 0)
                ahead *= beta
                ahead /= scale[nl : nl + nk, None]
                moves += alpha[lo : lo + nk].T @ ahead
                now[:nk] = ahead @ m.move.T
                alpha[nl : nl + nk] *= beta  # they become expected counts once they have been used for the moves
            beta, nk = now, k
        ahead = m.emit[x.symbol[:nk]] * beta / scale[:nk, None]
        alpha[:nk] *= beta
        goes_on = ~self.first[x.order]
        moves = (moves + self.prev[x.order][goes_on].T @ ahead[goes_on]) * m.move
        emits = np.stack([np.bincount(x.symbol, alpha[:, k], minlength=len(m.emit)) for k in range(K)], 1)
        return float(ll.sum()), alpha[:nk][~goes_on].sum(0), moves, emits


def _sequences(column: pa.Array, p: HmmParams):
    """(first, end, symbols, lengths) of rows of symbols, about step_tokens at a time or one longer row."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    for i, j in steps(off - off[0], 2 * p.step_tokens):
        yield i, j, np.frombuffer(data, "<u2", (off[j] - off[i]) // 2, off[i]), np.diff(off[i : j + 1]) // 2


def _parts(symbol: np.ndarray, p: HmmParams) -> list[np.ndarray]:
    return [symbol[a : a + p.step_tokens] for a in range(0, len(symbol), p.step_tokens)]


def expected_counts(m: Hmm, symbol: np.ndarray, length: np.ndarray, p: HmmParams) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """ln P and Baum-Welch counts of sequences; one sequence that is too long for a step is taken in parts."""
    if len(length) > 1 or length[0] <= p.step_tokens:
        return Step(m, symbol, length, p).expected()
    parts = _parts(symbol, p)
    before, after, whole = [None], [None], []
    for x in parts:
        s = Step(m, x, np.array([len(x)]), p, before[-1])
        whole.append(s.whole())
        v = (m.start if before[-1] is None else before[-1] @ m.move) @ whole[-1]
        before.append(v / v.sum())
    for t in whole[:0:-1]:
        v = m.move @ (t @ (np.ones(len(m.start)) if after[-1] is None else after[-1]))
        after.append(v / v.sum())
    total = None
    for x, b, a in zip(parts, before, after[::-1], strict=False):
        got = Step(m, x, np.array([len(x)]), p, b, a).expected()
        total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
    return total


def log_likelihood(m: Hmm, symbol: np.ndarray, length: np.ndarray, p: HmmParams) -> np.ndarray:
    """ln P of each sequence."""
    if len(length) > 1 or length[0] <= p.step_tokens:
        return Step(m, symbol, length, p).forward()[0]
    before, total = None, 0.0
    for x in _parts(symbol, p):
        ll, end = Step(m, x, np.array([len(x)]), p, before).forward()
        before, total = end[-1], total + ll
    return total


def maximise(counts: np.ndarray, p: HmmParams, lex: Lexicon) -> Hmm:
    """counts: [starts, a row of moves for each state, emissions]."""
    K = p.states
    start = counts[0] + p.smoothing
    move = counts[1 : K + 1] + p.smoothing
    prior = lex.size / lex.size.sum()
    emit = counts[K + 1 :] + p.smoothing * p.symbols * prior[:, None]
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(rows: DataFrame, lex: Lexicon, p: HmmParams) -> tuple[Hmm, list[float]]:
    """The model, and log10 P a symbol of the learning rows (id, learn, n_tokens, symbols) before each full pass."""
    spark = rows.sparkSession
    model, rises = initial(p, lex), []
    rows = rows.where("learn")
    tokens = rows.agg(F.sum("n_tokens")).first()[0]
    if not tokens:
        return model, rises
    n_rows = 1 + p.states + p.symbols
    schema = "row long, " + ", ".join(f"s{k} double" for k in range(p.states))
    part = F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(16))
    for full, docs in [*((False, rows.where(part < n)) for n in p.warm_up), *((True, rows) for _ in range(p.passes))]:
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            total = np.zeros((n_rows + 1, p.states))
            for b in batches:
                for _, _, symbol, length in _sequences(b.column(0), p) if b.num_rows else ():
                    ll, s, m, e = expected_counts(sent.value, symbol, length, p)
                    total[0] += s
                    total[1 : p.states + 1] += m
                    total[p.states + 1 : n_rows] += e
                    total[n_rows, 0] += ll
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at)] + [pa.array(total[at, k]) for k in range(p.states)], names=["row"] + [f"s{k}" for k in range(p.states)])

        # at most 2 + states + symbols rows reach the driver
        got = docs.select("symbols").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(p.states)]).toArrow()
        sent.unpersist()
        counts, at = np.zeros((n_rows + 1, p.states)), got["row"].to_numpy()
        for k in range(p.states):
            counts[at, k] += got[f"s{k}"].to_numpy()
        if not counts.any():
            continue  # no document in this part
        model = maximise(counts[:n_rows], p, lex)
        if full:
            rises.append(float(counts[n_rows, 0]) / math.log(10) / tokens)
            if len(rises) > 1 and rises[-1] - rises[-2] < p.tolerance:
                break
    return model, rises


def score(docs: DataFrame, p: HmmParams = HmmParams(), learn_from=None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    d = pick(docs, id=id_col, text=text).withColumn("learn", learn_from(F.col("id")) if learn_from is not None else F.lit(True))
    vocab = table(word_counts(d.where("learn").select("id", "text"), p), "vocab")
    lex = lexicon(vocab, p)
    rows = coded(d, lex, p)
    model, _ = train(rows, lex, p)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                hmm = np.concatenate([log_likelihood(sent.value, symbol, length, p) for _, _, symbol, length in _sequences(b.column(5), p)]) / math.log(10)
                score = b.column(3).to_numpy() + hmm - b.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), b.column(6), pa.array(score)], names=["id", "n_tokens", "n_head", "log_c", "row", "score"])

    id_type = d.schema["id"].dataType.simpleString()
    scored = rows.select("id", "n_tokens", "n_head", "log_c", "log_size", "symbols", "row").mapInArrow(run, f"id {id_type}, n_tokens long, n_head long, log_c double, row long, score double")
    rest = rows.select("row", F.explode(F.arrays_zip("h", "k")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.k").alias("k"))
    found = rest.join(vocab.select("h", "c"), "h").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("tail_c"), F.sum("k").alias("n_tail"))
    tail = F.coalesce("tail_c", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(lex.N).cast("long").alias("train_tokens"),
        (F.col("log_c") + tail - F.col("n_tokens") * math.log10(lex.N + lex.V + 1)).alias("base_score"),
        (F.col("score") + tail).alias("score"),
    )
