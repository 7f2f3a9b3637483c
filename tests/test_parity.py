"""Every query of the code-intelligence operators against its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from sparkloom import queries, source_queries  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    g = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    names = want.columns
    w = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert len(g) == len(w)
    assert g == w


def test_embeddings_of_awkward_texts_equal_their_sql(spark, tmp_path):
    """Words whose signs cancel, texts without ASCII letters or digits, blank and null texts, as documents."""
    import hashlib

    def place(w):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        return h % 64, h >> 63

    seen, pair = {}, None
    for k in range(1000):
        at, sign = place(f"w{k}")
        if (at, 1 - sign) in seen:
            pair = f"{seen[at, 1 - sign]} w{k}"
            break
        seen[at, sign] = f"w{k}"
    texts = [pair, pair + " " + pair, "plain words", "", "  \n", "_", "日本語", "é 7", "!?", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["P27_embeddings"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == sorted(con.sql(queries.SQL["P27_embeddings"]).fetchall())
