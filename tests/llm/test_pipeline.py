"""Each stage of the pipeline against what it must drop, keep or place."""

import zlib
from collections import defaultdict

import corpus_pipeline as cp
from sparkloom.llm import mixing
from sparkloom.llm.queries import byte_bpe
from sparkloom.llm.shared import read
from tests.llm.test_operators import brute_components, check_pieces

SF = "/root/testdata/sf0.01"


def check_shares(before, new):
    """Expected shares are nearer to the targets than own ones in each dimension; the sample is within 5 standard deviations of them."""
    p = mixing.MixingParams(least=0.5)
    celled = cp.table(mixing.with_cells(before), "celled")
    cells = cp.table(mixing.weights(celled, p), "cells")
    rate = {tuple(r[d] for d in mixing.DIMS): r["probability"] for r in cells.collect()}
    rows = [(r, r["mix_tokens"], rate[tuple(r[f"mix_{d}"] for d in mixing.DIMS)]) for r in celled.drop("text").collect()]
    total, kept = sum(n * q for _, n, q in rows), sum(n for r, n, _ in rows if r["doc_id"] in new)
    off = defaultdict(lambda: [0.0, 0.0])
    for g in mixing.report(cells, p).collect():
        if g["own"] or g["target"]:
            off[g["dim"]][0] += abs(g["own"] - g["target"])
            off[g["dim"]][1] += abs(g["expected"] - g["target"])
        inside = lambda r: r[f"mix_{g['dim']}"] == g["value"]  # noqa: B023, E731
        real = sum(n for r, n, _ in rows if r["doc_id"] in new and inside(r)) / kept
        deviation = sum(q * (1 - q) * (n * (inside(r) - g["expected"])) ** 2 for r, n, q in rows) ** 0.5 / total
        assert abs(real - g["expected"]) <= 5 * deviation + 1e-9
    assert all(expected < 0.6 * own for own, expected in off.values()) and off.keys() == set(mixing.DIMS)


def test_stages(spark):
    docs = read(spark, SF, "documents").select(*cp.COLUMNS)
    labels = {r["doc_id"]: r for r in read(spark, SF, "labels").collect()}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.table(stage(spark, docs, SF), name)
        old, new = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} if "text" in x.columns else None for x in (before, docs))
        if name == "toxicity":
            gone = [labels[i] for i in old.keys() - new.keys() if i in labels]
            assert gone and sum(r["toxic"] for r in gone) / len(gone) > 0.8
        elif name == "quality":
            clean = [i for i in old if i in labels and labels[i]["quality"] == 1]
            assert sum(i in new for i in clean) / len(clean) > 0.97 and len(new) < len(old)
        elif name == "near_dedup":
            groups = brute_components(list(old.items()), 5)
            assert set(new) == set(groups.values())
        elif name == "mixing":
            assert 0.5 < len(new) / len(old) < 1
            check_shares(before, new)
        else:
            check_pieces(docs.collect(), old, 1024, byte_bpe())
        if new is not None:
            assert docs.columns == list(cp.COLUMNS) and all(old[i] == t for i, t in new.items())


def test_result_is_stable(spark):
    rows = lambda: sorted(tuple(r)[:5] for r in cp.run(spark, "/root/testdata/sf0.001").collect())
    assert rows() == rows()


def test_mixing_keeps_by_hash(spark):
    d = read(spark, SF, "documents").select(*cp.COLUMNS)
    a, b = ({r["doc_id"] for r in cp.mix_sources(spark, x, SF).collect()} for x in (d, d.repartition(7)))
    assert a == b and defaultdict and zlib
