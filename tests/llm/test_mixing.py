import duckdb

from plotline.llm import mixing as M
from plotline.llm.sql import MIXING_SQL

SCHEMA = "doc_id long, text string, source string, size string, taken string"


def result(df, **more):
    return [r.asDict() for r in M.mix_sources(df, **more).collect()]


def test_targets_by_resharing(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 500, "é": 3}
    df = spark.createDataFrame(list(sizes.items()), "_source string, _size long")
    got = {r["_source"]: r["_target"] for r in M.source_targets(df).collect()}
    order = ["a", "b", "c", "é", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:  # reshare what is above a cap until nothing is
        rest = [s for s in order if s not in fixed]
        share = (budget - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * share > 2 * sizes[s]]
        if not over:
            break
        fixed |= {s: 2.0 * sizes[s] for s in over}
    want = fixed | {s: weight[s] * share for s in rest}
    assert all(abs(got[s] - want[s]) < 1e-9 for s in order)


def test_against_sql_with_small_cells(spark, tiny, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 3)
    monkeypatch.setattr(M, "SLOTS", 4)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({MIXING_SQL})").fetchall()}
    got = {r["doc_id"]: (r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in result(docs)}
    assert got == want


def test_edges(spark):
    rows = [(i, "w " * (i % 7), "s" if i % 3 else None) for i in range(60)] + [(None, "a b", "t"), (None, "a b", "t"), (None, None, "t"), (99, "z " * 50_000, "u"), (100, "", "empty")]
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)
    got, again = result(df), result(df)
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) <= 1.5 * total
    assert result(df.limit(0)) == []
    assert [r["taken"] for r in result(df.where("doc_id = 100"))] == [0]
