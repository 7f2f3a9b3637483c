"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import io
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from itertools import combinations, product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from sparkloom.llm import ann, hmm_lm, lang_id, licenses, media, mixing, near_dup, packing, quality, queries, toxicity
from sparkloom.llm.shared import Words, buffers, components, read, shingles

SF = "/root/testdata/sf0.001"
FOLD = {i: i + 32 for i in range(65, 91)}
DOC = "doc_id long, text string, lang string, source string"
#: Nulls, empty and blank texts, repeats, a long text, and texts of one and two words.
AWKWARD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "Same text here today", "en", "a"), (4, "Same text here today", "en", "a"), (5, "same TEXT here today", None, "a"), (6, "one", "de", None), (7, "one", "de", "b"), (8, "long word " * 30000, "en", "b"), (9, "two words", "fr", "b"), (None, "no id at all", "en", "b"), (10, "über straße \U0001f600 !!", "de", "b")]


@pytest.fixture
def awkward(spark):
    d = spark.createDataFrame(AWKWARD, DOC)
    # columns that clash with the operators' own names
    return d.withColumns({c: F.lit(1) for c in ("id", "score", "weight", "n", "p_doc", "row", "mix_topic", "keep", "c0", "Text2")})


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], DOC)


def words(text, letters=r"[^\x20\x09-\x0D]+"):
    return re.findall(letters, (text or "").translate(FOLD))


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_words_and_shingles():
    texts = ["A b  c", "", None, "x", "a b c a b c", "Ünter x\x0by"]
    raw, off = buffers(pa.array(texts))
    w = Words(raw, off)
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    assert w.hash[0] == w.hash[4] and len(set(w.hash.tolist())) == 6
    d, h = shingles(w, 2)
    assert np.bincount(d, minlength=6).tolist() == [len(shingle_set(t, 2)) for t in texts]
    assert set(h[d == 0].tolist()) <= set(h[d == 4].tolist())


def test_hashes_of_regular_words_differ():
    """Thue-Morse words and their complements collide in polynomial hashes modulo 2**64."""
    t = "a"
    for _ in range(11):
        t += t.translate({97: 98, 98: 97})
    other = t.translate({97: 98, 98: 97})
    many = [t[:n] for n in range(1, 80)] + [other[:n] for n in range(1, 80)] + [t, other, t[:1024], other[:1024], "a" * 32, "a" * 33, "a" * 32 + "b", "\x00", "\x00" * 2, "a\x00"]
    raw, off = buffers(pa.array(many))
    w = Words(raw, off)
    assert w.counts().tolist() == [1] * len(many) and len(set(w.hash.tolist())) == len(many)
    again = Words(*buffers(pa.array([" ".join(many)])))
    assert again.hash.tolist() == w.hash.tolist()  # a hash depends on the word's bytes alone


def test_near_dup_of_regular_words(spark):
    t = "a"
    for _ in range(10):
        t += t.translate({97: 98, 98: 97})
    d = spark.createDataFrame([(1, t), (2, t.translate({97: 98, 98: 97})), (3, t)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.link(d).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 50), (7, 7)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(e).collect()} == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40}
    assert components(e.limit(0)).count() == 0


# ---- near duplicates ---------------------------------------------------------------------------


def brute_components(rows, k):
    ids, parent = defaultdict(set), {}
    for i, t in rows:
        if i is not None:
            parent[i] = i
            if s := shingle_set(t, k):
                ids[i].add(s)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations([(i, s) for i, ss in ids.items() for s in ss], 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dup_matches_brute_force(spark, k):
    rng = np.random.default_rng(5)
    rows = [(int(r["doc_id"]), r["text"]) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
    for i in range(60):  # copies of one text with growing numbers of edits: links, near misses and chains
        t = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 9))):
            t[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((10_000 + i, " ".join(t)))
    want = brute_components(rows, k)
    got = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDupParams(words=k, block=16)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    sizes = {i: len(shingle_set(t, k)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def test_near_dup_awkward(awkward, no_rows):
    got = near_dup.link(awkward, near_dup.NearDupParams(words=2))
    r = {x["doc_id"]: x for x in got.collect()}
    assert got.count() == len(AWKWARD) and r[5]["component_id"] == 4 and r[7]["component_id"] == 6
    assert all(r[i]["kept"] and r[i]["n_shingles"] == 0 for i in (1, 2, 3)) and r[None]["kept"]
    assert {x["doc_id"] for x in near_dup.keep_one(awkward).collect()} == {1, 2, 3, 4, 6, 8, 9, None, 10}
    assert near_dup.link(no_rows).count() == 0


def test_near_dup_packs_pairs_in_short_rows(spark):
    """All pairs of two large groups, once each, in rows that don't grow with the groups, whatever a step holds."""
    n = 60
    regs = np.arange(160, dtype=np.uint16).tobytes()
    rows = [(g, 0, 0, 0, 0, 1000 * g + i, 100, 1000 * g + i, 7 + g, regs) for g in range(3) for i in range(n)]
    members = spark.createDataFrame(rows, "key long, bi int, bj int, blk int, band int, id long, n long, comp long, home long, regs binary")
    for step in (1, 1 << 12, 1 << 20):
        p = near_dup.NearDupParams(row_pairs=100, step_pairs=step)
        found = near_dup._bucket_pairs(members, p, True).collect()
        pairs = [tuple(x) for r in found for x in np.frombuffer(r["pairs"], np.int64).reshape(-1, 2).tolist()]
        assert sorted(pairs) == [(1000 * g + i, 1000 * g + k) for g in range(3) for i in range(n) for k in range(i + 1, n)]
        assert max(len(r["pairs"]) for r in found) <= 16 * p.row_pairs
        best = near_dup._bucket_pairs(members, p, False).collect()
        assert {r["a"] for r in best} == {1000 * g + i for g in range(3) for i in range(n)}


def test_setsketch_estimates_and_merges():
    p = near_dup.NearDupParams(bands=64, rows=8)
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    r = [near_dup.registers(np.zeros(len(x), int), x, 1, p)[0] for x in (a, b, np.arange(1000, dtype=np.uint64))]
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    est, fits = near_dup._estimates(r[0][None], r[1][None], np.array([900]), np.array([900]), p)
    assert abs(est[0] - 0.8) < 0.06 and fits[0]


# ---- packing -----------------------------------------------------------------------------------


def letters(text):
    return np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32) + 1


def check_pieces(rows, texts, window, tokenizer):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids, at = np.append(tokenizer(t or ""), 0).astype("<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(r["length"] for r in rows) / len(by_seq) / window


def test_packing(spark):
    rng = np.random.default_rng(1)
    texts = {i: "x" * int(n) for i, n in enumerate(rng.integers(0, 150, 3000))} | {5000: None, 5001: "y" * 1000, 5002: "", 5003: "z" * 63}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = packing.pack(d, letters, packing.PackingParams(window=64)).collect()
    assert check_pieces(rows, texts, 64, letters) > 0.99
    assert packing.pack(d.limit(0), letters).count() == 0


def test_packing_vocabulary(spark):
    t = queries.byte_bpe()
    whole = tokenizers.Tokenizer.from_file(t.path)
    whole.encode_special_tokens = True
    awkward = ["Hello  world\n\n", "<|endoftext|> é \U0001f600", "", "a" * 3000, " " * 9999 + "x", " " * 200_000 + "x", "\n\t" * 6000, "it's I'LL 'S 's don't", "x\u00a0\u2003y\u200bz \x1c\x1d\x85\u2028 \x00\ufeff", "١٢٣ ½ ² Ⅷ 中文字 हिन्दी é e\u0301 ǅ ﬁ \U0001d7d8", "a\r\n\r\n b   c", "!!??..::// ___ --- \u2014\u2014", "\U0010ffff\ue000\ufffd", "wordé word, (word) don't 'sfoo a'lla x\u00a0 \u00a0  y\x1c\x1f z!\x85  \x0b\x0c w\u3000\u3000v", "one  two\n" * 120_000, "wordé" * 50_000 + " " + "ab,c" * 300_000]
    for x in awkward + [r["text"] or "" for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]:
        assert t(x).tolist() == whole.encode(x, add_special_tokens=False).ids
    texts = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = queries.op2_pack_sequences(spark, SF).collect()
    assert check_pieces(rows, texts, 1024, t) > 0.97


def test_packing_awkward(awkward):
    rows = packing.pack(awkward, letters, packing.PackingParams(window=64)).collect()
    assert sum(r["length"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t, _, _ in AWKWARD)


def test_nnls_uses_pairs_that_fit():
    h = np.zeros(17, np.int64)
    h[[4, 12, 16, 5, 11]] = [7, 7, 2, 3, 3]
    assert sum(n for _, n in packing.plan(h, packing.PackingParams(window=16))) == 12


# ---- language model ----------------------------------------------------------------------------


def plain_forward(m, x):
    a = m.start * m.emit[x[0]]
    for k in x[1:]:
        a = (a @ m.move) * m.emit[k]
    return math.log(a.sum())


def test_forward_is_exact_and_em_climbs():
    """Segments of 4 and steps of 9 tokens against a plain recursion and sums over all paths."""
    p = hmm_lm.HmmParams(states=3, own_words=2, affix_symbols=3, segment=4, step_tokens=9, smoothing=1e-9)
    rng = np.random.default_rng(0)
    lex = hmm_lm.Lexicon(*[np.zeros(0, t) for t in ("u8", "i8", "i8")], np.ones(p.symbols) * 2, 5, 3)
    m = hmm_lm.initial(p, lex)
    lengths = np.array([3, 1, 6, 2, 17, 4, 5, 8])
    symbol, ends = rng.integers(0, p.symbols, lengths.sum()), np.cumsum(lengths)
    want = [plain_forward(m, symbol[e - n : e]) for n, e in zip(lengths, ends, strict=True)]
    assert np.allclose(hmm_lm.log_likelihood(m, symbol, lengths, p), want, rtol=1e-10)
    whole = replace(p, segment=1000, step_tokens=10_000)
    for x, y in zip(hmm_lm.expected_counts(m, symbol, lengths, p), hmm_lm.expected_counts(m, symbol, lengths, whole), strict=True):
        assert np.allclose(x, y)
    for n in (10, 23, 60):  # one text longer than a step
        one, size = rng.integers(0, p.symbols, n), np.array([n])
        assert np.allclose(hmm_lm.log_likelihood(m, one, size, p), plain_forward(m, one))
        for x, y in zip(hmm_lm.expected_counts(m, one, size, p), hmm_lm.expected_counts(m, one, size, whole), strict=True):
            assert np.allclose(x, y)
    one, total, starts, moves, emits = symbol[:5], 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((p.symbols, 3))
    for path in product(range(3), repeat=5):
        q = m.start[path[0]] * math.prod(m.emit[s, k] for s, k in zip(one, path, strict=True)) * math.prod(m.move[i, j] for i, j in zip(path[:-1], path[1:], strict=True))
        total += q
        starts[path[0]] += q
        np.add.at(moves, (path[:-1], path[1:]), q)
        np.add.at(emits, (one, path), q)
    got = hmm_lm.expected_counts(m, one, np.array([5]), replace(p, segment=2))
    for x, y in zip(got, (math.log(total), starts / total, moves / total, emits / total), strict=True):
        assert np.allclose(x, y)
    rises = []
    for _ in range(5):
        ll, s, mv, e = hmm_lm.expected_counts(m, symbol, lengths, p)
        rises.append(ll)
        m = hmm_lm.maximise(np.concatenate([s[None], mv, e]), p, lex)
    assert rises == sorted(rises) and rises[-1] > rises[0] + 1


def test_lm_scores_and_training_equal_plain_ones(spark, monkeypatch):
    """Scores by a plain recursion over each text, and passes by plain sums; long texts come in pieces."""
    p = hmm_lm.HmmParams(states=3, own_words=20, affix_symbols=16, head_words=50, segment=32, step_tokens=500, step_bytes=3000, passes=3, tolerance=0.0)
    kept, train = {}, hmm_lm.train
    monkeypatch.setattr(hmm_lm, "train", lambda rows, lex, p: kept.setdefault("model", (*train(rows, lex, p), lex))[:2])
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").limit(40).collect()] + [(10**6, "Some  words\x0b" * 3000), (10**6 + 1, None), (10**6 + 2, "x" * 9000 + " y")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm_lm.score(d, p, queries.learns(7, 2)).collect()}
    m, rises, lex = kept["model"]
    assert len(rises) == 3 and rises == sorted(rises)
    vocab = {r["h"] & (2**64 - 1): r["c"] for r in hmm_lm.word_counts(d.where(queries.learns(7, 2)(F.col("doc_id"))).select("doc_id", "text"), p).collect()}
    n_end = vocab[int(hmm_lm.END)]
    sequences = []
    for i, t in docs:
        raw, off = buffers(pa.array([t]))
        w = Words(raw, off)
        x = [*lex.symbols(w, p)[0].tolist(), p.own_words]
        share = sum(math.log10((vocab.get(h, 0) + 1) / lex.size[s]) for h, s in zip(w.hash.tolist(), x, strict=False)) + math.log10((n_end + 1) / lex.size[p.own_words])
        assert got[i]["n_tokens"] == len(words(t)) + 1
        assert math.isclose(got[i]["score"], share + plain_forward_scaled(m, x), rel_tol=1e-9)
        if zlib.crc32(str(i).encode()) % 7 != 2:
            sequences.append(np.array(x))
    # one more pass over all learning texts gives the likelihood that the model now has
    whole = replace(p, segment=10**6, step_tokens=10**7)
    now = sum(hmm_lm.expected_counts(m, x, np.array([len(x)]), whole)[0] for x in sequences) / math.log(10) / sum(map(len, sequences))
    assert now > rises[-1]


def plain_forward_scaled(m, x):
    a, out = None, 0.0
    for k in x:
        a = (m.start if a is None else a @ m.move) * m.emit[k]
        out += math.log10(a.sum())
        a = a / a.sum()
    return out


def test_lm_base_score_and_gain(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    c, n_docs = Counter(), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(words(t))
            n_docs += 1
    N, V = sum(c.values()) + n_docs, len(c) + 1
    lp = lambda x: math.log10((x + 1) / (N + V + 1))
    gain = {True: 0.0, False: 0.0}
    for r in queries.op3_hmm_lm(spark, SF).collect():
        w = words(dict(docs)[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, N)
        assert math.isclose(r["base_score"], sum(lp(c[x]) for x in w) + lp(n_docs), rel_tol=1e-9)
        gain[r["held_out"]] += r["score"] - r["base_score"]
    assert gain[True] > 0 and gain[False] > 0


def test_lm_shares_sum_to_one(spark):
    """Within a symbol, the shares of all known words and one unknown word are 1."""
    p = hmm_lm.HmmParams(own_words=3, affix_symbols=4, head_words=5)
    d = spark.createDataFrame([(1, "a b c d e f g a b c a"), (2, "a h i j")], "id long, text string")
    vocab = hmm_lm.word_counts(d, p)
    lex = hmm_lm.lexicon(vocab, p)
    rows = vocab.collect()
    assert lex.N == 17 and lex.V == 11 and sum(r["c"] for r in rows) == 17
    own = set(lex.head[lex.head_symbol >= 0].tolist())
    total = np.zeros(p.symbols)
    for r in rows:
        h = r["h"] & (2**64 - 1)
        if r["affix"] >= 0 and h not in own:
            total[p.own_words + 1 + r["affix"]] += r["c"] + 1
    used = np.arange(p.symbols) > p.own_words
    assert np.allclose(total[used] + 1, lex.size[used])


def test_lm_awkward(awkward, no_rows):
    got = hmm_lm.score(awkward, hmm_lm.HmmParams(states=2), queries.learns(7, 2)).collect()
    assert len(got) == len(AWKWARD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert hmm_lm.score(no_rows).count() == 0


# ---- classifiers -------------------------------------------------------------------------------


def test_language_id(spark):
    d = read(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() / got.count() > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_equals_plain_compression(spark):
    """Dictionaries and sizes without Spark; all learning rows are in the sample."""
    import zstandard

    d = read(spark, SF, "documents")
    p = lang_id.LanguageParams(docs_per_language=10**6, dictionary_bytes=4000)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in d.collect()]
    counts, n_docs = defaultdict(Counter), Counter()
    clean = lambda t: re.sub(rb"[\x00-\x7f]", lambda c: c[0] if c[0].isalpha() else b" ", t.lower().encode()).split()
    for i, t, l in rows:
        if t is not None and l is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[l].update(clean(t))
            n_docs[l] += 1
    best = {l: b" ".join(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: p.dictionary_bytes // 2][::-1])[-p.dictionary_bytes :] for l, c in counts.items()}
    found = lang_id.learn(d, p, queries.learns(3, 1))
    assert found == best and list(found) == sorted(best, key=lambda l: (-n_docs[l], l))
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.predict(d, found, p).collect()}
    for i, t, _ in rows:
        if t is None or not re.search(r"[^\W\d_]", t):
            assert got[i] == "und"
            continue
        b = b" ".join(clean(t))
        sizes = []
        for k, l in enumerate(found):
            coder = zstandard.ZstdCompressor(level=p.level, dict_data=zstandard.ZstdCompressionDict(found[l], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
            sizes.append((sum(len(coder.compress(b[a : a + p.segment])) for a in range(0, len(b), p.segment)), k, l))
        assert got[i] == min(sizes)[2]


def test_language_counts_repeated_words(spark):
    """The text's words decide, not its vocabulary: mostly one language, a few distinct words of the other."""
    de, en = "strasse werk hund katze baum haus".split(), "street work river table candle mother window garden orange yellow silver winter".split()
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(de if i % 2 else en, 80)), "de" if i % 2 else "en", "s") for i in range(60)]
    mixed = " ".join([" ".join(rng.choice(de, 40)) + " " + w for w in en])
    found = lang_id.learn(spark.createDataFrame(rows, DOC), lang_id.LanguageParams(), queries.learns(3, 1))
    out = lang_id.predict(spark.createDataFrame([(1, mixed, None, None)], DOC), found).collect()
    assert out[0]["lang_pred"] == "de"
    none = spark.createDataFrame([], DOC)
    assert lang_id.predict(none, found).count() == 0


def test_language_awkward(awkward, no_rows):
    p = lang_id.LanguageParams()
    found = lang_id.learn(awkward, p, queries.learns(3, 1))
    r = {x["doc_id"]: x for x in lang_id.predict(awkward, found, p).collect()}
    assert all(r[i]["lang_pred"] == "und" for i in (1, 2, 3)) and r[9]["lang_pred"] != "und" and "Text2" in lang_id.predict(awkward, found, p).columns
    assert lang_id.learn(no_rows, p, queries.learns(3, 1)) == {}
    assert {x["lang_pred"] for x in lang_id.predict(awkward, {}, p).collect()} == {"und"}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    missed = sum(r["toxic"] and not r["predicted"] for r in got) / sum(r["toxic"] for r in got)
    assert right > 0.95 and missed < 0.35


def test_toxicity_equals_plain_ftrl(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["calm", "nice", "tree", "bad", "vile", "Foul"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 3 if i % 3 else 6], 5)) + "!", int(i % 3 == 0)) for i in range(60)] + [(100, None, 0), (101, "", 1)]
    p = toxicity.ToxicityParams(l1=0.5, epochs=3)
    z, n, b = Counter(), Counter(), [0.0, 0.0]

    def found(text):
        w = re.findall("[a-z0-9]+", (text or "").lower())
        return {(x,) for x in w} | {(w[i], w[i + g], g) for g in (1, 2, 3) for i in range(len(w) - g)}

    def weight(zz, nn, l1):
        return 0.0 if abs(zz) <= l1 else (math.copysign(l1, zz) - zz) / ((p.beta + math.sqrt(nn)) / p.alpha + p.l2)

    def margin(text):
        return sum(weight(z[f], n[f], p.l1) for f in found(text)) + weight(*b, 0.0)

    for _ in range(p.epochs):
        for i, text, y in sorted(rows, key=lambda r: zlib.crc32(str(r[0]).encode())):
            g = 1 / (1 + math.exp(-margin(text))) - y
            old = {f: weight(z[f], n[f], p.l1) for f in found(text)}
            for f, w in old.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / p.alpha * w
                n[f] += g * g
            w = weight(*b, 0.0)
            b[0] += g - (math.sqrt(b[1] + g * g) - math.sqrt(b[1])) / p.alpha * w
            b[1] += g * g
    d = spark.createDataFrame(rows, "id long, text string, label int")
    got = {r["id"]: r["score"] for r in toxicity.score(d, toxicity.train(d, p), p).collect()}
    for i, text, _ in rows:
        assert math.isclose(got[i], 1 / (1 + math.exp(-margin(text))), rel_tol=1e-9)


def test_toxicity_awkward(spark, awkward, no_rows):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (5, None), (8, 0)], "doc_id long, toxic int")
    p = toxicity.ToxicityParams()
    rows = toxicity.training_rows(awkward, labels, "toxic", p, queries.learns(4, 2))
    got = toxicity.score(awkward, toxicity.train(rows, p), p)
    assert got.count() == len(AWKWARD) and got.where("score between 0 and 1").count() == len(AWKWARD)
    none = toxicity.train(toxicity.training_rows(no_rows, labels, "toxic", p, queries.learns(4, 2)), p)
    assert {r["score"] for r in toxicity.score(awkward, none, p).collect()} == {0.0}


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_site_quality(spark, sf).join(read(spark, sf, "labels"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(len(bad), 1) < 0.4


def test_quality_equals_plain_sums(spark):
    d = read(spark, SF, "documents").select("doc_id", "text", "source", "lang")
    labels = read(spark, SF, "labels")
    rows, y = d.collect(), {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    x = quality.features(pa.array([r["text"] for r in rows]))
    for r, f in zip(rows, x, strict=True):
        t, b = words(r["text"]), (r["text"] or "").encode()
        n, size, letters_ = max(len(t), 1), max(len(b), 1), sum(chr(c).isalpha() for c in b if c < 128)
        plain = [math.log1p(len(t)), sum(len(w.encode()) for w in t) / n, len(set(t)) / n, sum(p == q for p, q in zip(t, t[1:], strict=False)) / n, sum(65 <= c <= 90 for c in b) / max(letters_, 1)]
        plain += [sum(32 < c < 128 and not chr(c).isalpha() for c in b) / size, b.count(b"!") / size, b.count(b"|") / size, sum(48 <= c <= 57 for c in b) / size, len(set(zip(t, t[1:], strict=False))) / n]
        assert np.allclose(f, plain)
    p = quality.QualityParams()
    m = quality.train(d, labels, p, queries.learns(4, 2))
    on = [k for k, r in enumerate(rows) if r["doc_id"] in y]
    z = np.clip((x[on] - m.mean) / m.scale, -8, 8)
    z = np.concatenate([z, z**2, np.ones((len(on), 1))], 1)
    goal = np.array([y[rows[k]["doc_id"]] for k in on])
    slope = z.T @ (1 / (1 + np.exp(-z @ m.weight)) - goal) / len(on) + p.ridge * m.weight
    assert np.abs(slope).max() < 1e-5  # the one minimum of a convex loss
    e = quality.with_evidence(d, m)
    sites = quality.sites(e.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.col("lang").alias("path"), "p_doc"), labels, p, queries.learns(4, 2))
    p_doc = m.probability(x)
    per = defaultdict(lambda: np.zeros(4))
    for r, q in zip(rows, p_doc, strict=True):
        for key in ((r["source"],), (r["source"], r["lang"])):
            per[key] += [r["doc_id"] in y, y.get(r["doc_id"], 0), r["doc_id"] not in y, 0 if r["doc_id"] in y else q]
    total = sum(v for k, v in per.items() if len(k) == 1)
    top = (total[1] + 1) / (total[0] + 2)

    def rates(keys, parent):
        v, e_, ns, b, j = 0.0, 0.0, [], [], 0
        for k in keys:
            n, good = per[k][:2]
            if n:
                v, e_, j = v + n * (good / n - parent(k)) ** 2, e_ + parent(k) * (1 - parent(k)), j + 1
                ns.append(n), b.append(parent(k) * (1 - parent(k)))
        spread = sum(ns) - sum(n * n for n in ns) / sum(ns) if ns else 0
        s = 50.0 if j < 2 or spread <= 0 else min(max(sum(b) / j / max((v - e_) / spread, 1e-6) - 1, 1.0), 1e5)
        return {k: (per[k][1] + p.soft * per[k][3] + s * parent(k)) / (per[k][0] + p.soft * per[k][2] + s) for k in keys}

    hosts = rates([k for k in per if len(k) == 1], lambda k: top)
    paths = rates([k for k in per if len(k) == 2], lambda k: hosts[k[:1]])
    got = {(r["host"], r["path"]): r["path_rate"] for r in sites.collect()}
    assert got.keys() == paths.keys() and all(math.isclose(got[k], paths[k], rel_tol=1e-6) for k in got)
    out = {r["doc_id"]: r for r in quality.posterior(e, sites, m, p, "source", "lang").collect()}
    odds = lambda q: math.log(min(max(q, 1e-9), 1 - 1e-9) / (1 - min(max(q, 1e-9), 1 - 1e-9)))
    for r, q in zip(rows, p_doc, strict=True):
        want = 1 / (1 + math.exp(-(odds(q) - math.log(m.prior / (1 - m.prior)) + odds(paths[(r["source"], r["lang"])]))))
        assert math.isclose(out[r["doc_id"]]["posterior"], want, rel_tol=1e-6) and out[r["doc_id"]]["keep"] == (out[r["doc_id"]]["posterior"] >= 0.5)


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "big", "x", 0.5) for i in range(400)] + [(400, "tiny", "y", 0.5), (401, None, None, 0.5)]
    e = spark.createDataFrame(rows, "id long, host string, path string, p_doc double")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(401)], "doc_id long, quality int")
    r = {x["host"]: x["path_rate"] for x in quality.sites(e, labels, quality.QualityParams(), lambda c: F.lit(True)).collect()}
    assert abs(r["big"] - 0.9) < 0.03 and 0.3 < r["tiny"] < 0.95 and 0.5 < r[None] < 0.95


def test_quality_awkward(spark, awkward, no_rows):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    p = quality.QualityParams()
    for l in (labels, labels.limit(0)):
        m = quality.train(awkward, l, p, queries.learns(4, 2))
        e = quality.with_evidence(awkward.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.col("lang").alias("path"), "text"), m)
        out = quality.posterior(e, quality.sites(e, l, p, queries.learns(4, 2)), m, p)
        assert out.count() == len(AWKWARD) and out.where("posterior between 0 and 1").count() == len(AWKWARD)
    assert quality.train(no_rows, labels, p, queries.learns(4, 2)).prior == 0.5


def test_language_of_long_texts_only(spark):
    long = {"aa": "omu kalu tesi ravo ", "bb": "stirb wrank dolf gruzz "}
    rows = [(i, " ".join(f"{w}{j}" for j in range(900) for w in long[v].split()), v, "s") for i in range(12) for v in ("aa" if i % 2 else "bb",)]
    assert min(len(t) for _, t, _, _ in rows) > 20_000
    d = spark.createDataFrame(rows, DOC)
    found = lang_id.learn(d, lang_id.LanguageParams(), queries.learns(3, 1))
    assert set(found) == {"aa", "bb"}
    assert all(r["lang_pred"] == r["lang"] for r in lang_id.predict(d, found).collect())


# ---- media, neighbours, mixing, licences -------------------------------------------------------


def test_media_formats():
    rng = np.random.default_rng(3)
    grey, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6 3 4 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n# note\n7 5\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert media.decode(b"P1\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]] == media.decode(b"P4\n2 2\n\x80\x40").tolist()
    for bad in (b"", b"P5\n9 9\n255\nx", b"BM", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)
    assert np.allclose(media.resize(grey, 1, 1), grey.mean()) and np.allclose(media.resize(grey, 5, 7), grey)
    fine = np.kron(grey, np.ones((3, 3)))
    assert np.allclose(media.resize(fine, 5, 7), grey)


def plain_resize(pixels, height, width):
    """Exact area means by way of an image large enough for both sizes."""
    h, w = pixels.shape
    return np.kron(pixels.astype(float), np.ones((height, width))).reshape(height, h, width, w).mean((1, 3))


def test_resize_of_tall_images(monkeypatch):
    x = np.random.default_rng(4).integers(0, 256, (37, 64), dtype=np.uint8)
    for strip in (1, 5, 36, 4096):
        monkeypatch.setattr(media, "STRIP", strip)
        for size in ((8, 9), (1, 1), (37, 64), (50, 70)):
            assert np.allclose(media.resize(x, *size), plain_resize(x, *size))


def test_media_texts(spark, awkward):
    side, rows = 16, media.store_texts(awkward, side=16)
    texts = {(r["pgm"], r["npy"]): r["text"] for r in rows.collect()}
    for (pgm, npy), text in texts.items():  # the stored forms: a lossless image, and a tile of exact means
        b = (text or "").encode()
        pixels = media.decode(pgm)
        assert pixels.tobytes()[: len(b)] == b and not any(pixels.tobytes()[len(b) :])
        assert (np.load(io.BytesIO(npy)) == np.rint(plain_resize(pixels, side, side))).all() if pixels.shape[0] < 99 else True
    for r in media.digests(rows).collect():
        b = (r["text"] or "").encode()
        payload = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and r["npy_sha256"] in {hashlib.sha256(n).hexdigest() for _, n in texts}
        if len(payload) < 6400:
            small = np.round(plain_resize(np.frombuffer(payload, np.uint8).reshape(-1, 64), 8, 9), 6)
            assert r["feature"] == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    assert media.digests(media.store_texts(awkward.limit(0))).count() == 0
    d = spark.createDataFrame([(media.encode_bmp(np.eye(9, dtype=np.uint8) * 200),), (None,), (b"x",)], "m binary")
    t = media.tiles(d, "m").collect()
    assert t[0]["height"] == 9 and t[0]["npy"][:6] == b"\x93NUMPY" and t[1]["dhash"] is None and t[2]["npy"] is None


def test_ann_recall_and_order(spark):
    sf = "/root/testdata/sf0.1"
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = defaultdict(list)
    for r in queries.op5_one_bit_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        mine = got[ids[i]]
        assert len(mine) == 20 and all(math.isclose(v, float(s[list(ids).index(k)]), abs_tol=1e-12) for k, v in mine[:3])
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        found += len({ids[j] for j in order} & {k for k, _ in mine})
        total += 20
    assert found / total > 0.99


def test_ann_awkward(spark):
    nan = float("nan")
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (40, None)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(d, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.search(d.limit(0), lambda c: c % 20 == 0).count() == 0
    many = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(400)], "vec_id long, embedding array<double>")
    r = ann.search(many, lambda c: c % 20 == 0, ann.AnnParams(sample=50, query_block=8)).collect()
    assert len(r) == 400 and {x["vec_id"] for x in r if x["query_id"] == 0} == set(range(1, 21))  # all tie at 1
    assert {x["vec_id"] for x in r if x["query_id"] == 20} == set(range(6, 147, 7)) - {20}


@pytest.mark.parametrize("scale", [1e-200, 1e-20, 1e15, 1e20, 1e160, 1e307])
def test_ann_of_any_scale(spark, scale):
    x = np.random.default_rng(8).standard_normal((600, 16)) + 0.5
    want = {i: [int(j) for j in np.lexsort((np.arange(600), -(x @ x[i]))) if j != i][:20] for i in range(0, 600, 20)}
    d = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(d, lambda c: c % 20 == 0, ann.AnnParams(sample=64)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        assert not math.isnan(r["score"])
    assert sum(len(set(want[i]) & set(got[i])) for i in want) > 0.99 * 20 * len(want)


def test_ann_of_mixed_scales_and_repeated_ids(spark):
    rows = [(i, [10.0 ** (i % 40 * 7 - 140), float(i)]) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(d, lambda c: c % 20 == 0, ann.AnnParams(sample=64)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    x = np.array([v for _, v in rows])
    for i in range(0, 200, 20):
        assert got[i] == [j for j in np.lexsort((np.arange(200), -(x @ x[i]))) if j != i][:20]
    # rows of one id: each is a query, and a candidate for the others; columns that clash are left alone
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vec", "uid", "u", "q")})
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.search(twice, lambda c: c % 20 == 0).collect()]
    assert sorted(got) == [(0, 0, 2.0), (0, 0, 2.0), (0, 1, 3.0), (0, 1, 6.0)]


def test_mixing_meets_marginals(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(50, 900))) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens long")
    rows = mixing.rake(cells, mixing.MixingParams(sweeps=20)).collect()
    total = sum(r["tokens"] for r in rows)
    for d in mixing.DIMS:
        now, own = defaultdict(float), defaultdict(float)
        for r in rows:
            now[r[d]] += r["tokens"] * r["weight"] / total
            own[r[d]] += r["tokens"] / total
        norm = sum(x**0.7 for x in own.values())
        assert all(math.isclose(now[v], own[v] ** 0.7 / norm, rel_tol=1e-4) for v in own)
    given = spark.createDataFrame([("l0", 0.5), ("l1", 0.5)], "value string, share double")
    kept = mixing.rake(cells, mixing.MixingParams(targets={"lang": given})).collect()
    assert all((r["weight"] == 0) == (r["lang"] == "l2") for r in kept)


def test_mixing_awkward(awkward, no_rows):
    out = mixing.mix(awkward)
    assert out.count() == len(AWKWARD) and out.where("sampled is null").count() == 0
    assert [c.lower() for c in out.columns].count("weight") == 1
    assert {r["mix_tokens"] for r in out.where("doc_id in (1, 2, 3)").collect()} == {0}
    assert mixing.mix(no_rows).count() == 0


def test_mixing_samples_meet_targets(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "source", "lang")
    # a third of all rows from one source
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    for d in (docs, hot):
        rows = mixing.mix(d).select("mix_source", "mix_lang", "mix_topic", "mix_tokens", "probability", "sampled").collect()
        total, expected, kept = (sum(f(r) for r in rows) for f in (lambda r: r["mix_tokens"], lambda r: r["mix_tokens"] * r["probability"], lambda r: r["mix_tokens"] * r["sampled"]))
        assert max(r["probability"] for r in rows) <= 1 and kept > 0.2 * total
        for dim in mixing.DIMS:
            own, want, got = defaultdict(float), defaultdict(float), defaultdict(float)
            for r in rows:
                v = r["mix_" + dim]
                own[v] += r["mix_tokens"] / total
                want[v] += r["mix_tokens"] * r["probability"] / expected
                got[v] += r["mix_tokens"] * r["sampled"] / kept
            norm = sum(x**0.7 for x in own.values())
            for v in own:
                goal = own[v] ** 0.7 / norm
                assert math.isclose(want[v], goal, rel_tol=1e-3) and abs(got[v] - goal) < 0.01 + 0.1 * goal


def test_mixing_reports_targets(spark):
    d = spark.createDataFrame([(i, "word " * 20, "en", "ab"[i % 2]) for i in range(40)], DOC)
    p = mixing.MixingParams(targets={"source": spark.createDataFrame([("a", 0.3), ("b", 0.3), ("gone", 0.4)], "value string, share double")})
    met = {r["value"]: (r["met"], round(r["expected"], 6)) for r in mixing.report(mixing.weights(mixing.with_cells(d), p), p).where("dim = 'source'").collect()}
    assert met == {"a": (False, 0.5), "b": (False, 0.5), "gone": (False, 0.0)}
    p = mixing.MixingParams(targets={"source": spark.createDataFrame([("a", 0.2), ("b", 0.8)], "value string, share double")})
    assert all(r["met"] for r in mixing.report(mixing.weights(mixing.with_cells(d), p), p).collect())
    # 800 of a, 160 of b, 40 of c: in half of all, b and c are kept whole and named as missed
    d = spark.createDataFrame([(i, "word " * 20, "en", "c" if i % 25 == 0 else "b" if i % 25 < 5 else "a") for i in range(50)], DOC)
    third = spark.createDataFrame([(v, 1 / 3) for v in "abc"], "value string, share double")
    p = mixing.MixingParams(targets={"source": third}, least=0.5)
    got = {r["value"]: (round(r["expected"], 6), r["met"]) for r in mixing.report(mixing.weights(mixing.with_cells(d), p), p).where("dim = 'source'").collect()}
    assert got == {"a": (0.6, False), "b": (0.32, False), "c": (0.08, False)}


def brute_licenses(rows, p=licenses.LicenseParams()):
    anchor = re.compile("(?i)\\b(" + "|".join(licenses.ANCHORS) + ")\\b")
    heads = {i: [licenses.terms(x) for x in re.split(r"\r?\n", t or "") if anchor.search(x)] for i, _, t in rows}
    vocab = {w for g in licenses.TEMPLATES.values() for t in g for w in licenses.terms(t)}
    df = Counter(w for h in heads.values() for w in {w for x in h for w in x} & vocab)
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in vocab}

    def vec(ws):
        v = {w: (1 + math.log(n)) * idf.get(w, max(idf.values())) for w, n in Counter(ws).items()}
        s = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / s for w, x in v.items()}

    own, files = {}, {}
    for i, path, t in rows:
        best, inside = None, 0
        for ws in heads[i]:
            if ws:
                a = vec(ws)
                c = min((-round(sum(x * b.get(w, 0) for w, x in a.items()), 9), name) for name, g in licenses.TEMPLATES.items() for s in g for b in [vec(licenses.terms(s))])
                if -c[0] >= p.min_cosine:
                    best, inside = min(best or c, c), inside + len(ws)
        own[i] = best
        if best and path is not None and inside >= p.file_share * len(licenses.terms(t or "")):
            d = path.rpartition("/")[0]
            files[d] = min(files.get(d, best), best)
    out = {}
    for i, path, _ in rows:
        d, got = (path.rpartition("/")[0] if path is not None else None), None
        while d is not None and got is None:
            got = files.get(d)
            d = None if d == "" else d.rpartition("/")[0]
        out[i] = (own[i][1], "own") if own[i] else (got[1], "inherited") if got else (None, "none")
    return out


def test_licenses(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "src/a.c", "int x;"), (3, "src/gpl/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "src/gpl/deep/er/b.c", "code"), (5, "src/c.c", "code\nLicensed under the Apache License, Version 2.0.\n" + "more " * 50), (6, None, "x"), (7, "x/y", None), (8, "src/d", "my driving license was lost with no trace of it anywhere"), (9, "src/gpl/e.c", "")]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == brute_licenses(rows)
    assert got[4] == ("GPL-3.0", "inherited") and got[2] == ("MIT", "inherited") and got[5] == ("Apache-2.0", "own") and got[6] == (None, "none")
    docs = [(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in read(spark, SF, "documents").collect()]
    assert {r["doc_id"]: (r["license"], r["origin"]) for r in queries.op1_license_scan(spark, SF).collect()} == brute_licenses(docs)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_licenses_of_deep_directories(spark):
    deep = "/".join(f"d{i}" for i in range(70))
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "LICENSE", mit), (2, f"{deep}/LICENSE", gpl), (3, f"{deep}/a.c", "int x;"), (4, f"{deep}/e/a.c", "int x;"), (5, deep + ".c", "int x;")]
    got = {r["doc_id"]: (r["license"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[3] == got[4] == ("GPL-3.0", deep) and got[5] == ("MIT", "")


def test_full_license_texts_are_inherited(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    full = {f.stem: f.read_text() for f in folder.glob("*.txt")}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "Apache-2.0"} <= set(full)
    # a holder's line, other line ends and other wrapping than the template's
    texts = {name: "Copyright (c) 2019-2024 Jo Doe and others\r\n\r\n" + textwrap.fill(t, 100).replace("\n", "\r\n") for name, t in full.items()}
    rows = [(2 * k, f"{name}/LICENSE", t) for k, (name, t) in enumerate(texts.items())] + [(2 * k + 1, f"{name}/src/deep/a.c", "int x;") for k, name in enumerate(texts)]
    # the licence as a comment of a program is a header, not a licence file
    rows += [(100, "code/a.c", texts["MIT"] + " int main() { return call(a, b); }" + " ".join(f"name{i} = value{i};" for i in range(300))), (101, "code/b.c", "x")]
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_file"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, name in enumerate(texts):
        assert got[2 * k] == (name, "own", True) and got[2 * k + 1] == (name, "inherited", False)
    assert not got[100][2] and got[101] == (None, "none", False)


def test_queries_equal_their_sql(spark):
    import duckdb

    from sparkloom.llm import queries as llm_queries
    from sparkloom.llm import sql as llm_sql

    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    for name, text in llm_sql.SQL.items():
        got = llm_queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        want = con.sql(text)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
