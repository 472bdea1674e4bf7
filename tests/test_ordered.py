"""Blocked scans give what a plain loop gives, whatever the block size."""

import random

import pytest
from pyspark.sql import functions as F

from proseloom.operators import ordered


def _rows():
    rnd = random.Random(7)
    # Key 0 holds most rows and has gaps in its index.
    sizes = {0: 300, 1: 40, 2: 1}
    return [
        (k, i * (3 if k == 0 else 1), rnd.choice([None, rnd.randint(-5, 9)]))
        for k, n in sizes.items()
        for i in range(n)
    ]


@pytest.mark.parametrize("block_rows", [8, 32, 1000])
def test_running_and_neighbours(spark, block_rows):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(3)
    how = {"block_rows": block_rows}
    got = ordered.running(
        df,
        ["k"],
        "i",
        {
            "total": ("sum", F.coalesce("v", F.lit(0))),
            "seen": ("last", F.col("v")),
            "top": ("max", F.col("v")),
            "n": ("count", F.lit(1)),
        },
        **how,
    )
    got = ordered.running(got, ["k"], "i", {"ahead": ("last", F.col("v"))}, reverse=True, **how)
    got = ordered.neighbours(got, ["k"], "i", prev={"p": F.col("i")}, next={"q": F.col("i")}, cut=True, **how)
    got = {(r.k, r.i): r for r in got.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        values = [v for _, _, v in mine]
        for pos, (k, i, _) in enumerate(mine):
            r, past = got[(k, i)], [v for v in values[: pos + 1] if v is not None]
            later = [v for v in values[pos:] if v is not None]
            assert r.total == sum(past) and r.n == pos + 1
            assert r.seen == (past[-1] if past else None) and r.top == (max(past) if past else None)
            assert r.ahead == (later[0] if later else None)
            assert r.p == (mine[pos - 1][1] if pos else None)
            assert r.q == (mine[pos + 1][1] if pos + 1 < len(mine) else None)


@pytest.mark.parametrize("block_rows", [1, 3, 8, 1000])
def test_lags(spark, block_rows):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(3)
    got = ordered.lags(df, ["k"], "i", {f"v{n}": (F.col("v"), n) for n in (1, 2, 3)}, block_rows=block_rows)
    got = {(r.k, r.i): r for r in got.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for pos, (k, i, _) in enumerate(mine):
            for n in (1, 2, 3):
                assert got[k, i][f"v{n}"] == (mine[pos - n][2] if pos >= n else None)


@pytest.mark.parametrize("block_rows", [8, 1000])
def test_rerank(spark, block_rows):
    # One row has more pieces than any packed number would leave room for.
    rows = [(1, i, j) for i in (0, 4, 9, 200) for j in range(i % 3 + 1)] + [(1, 50, j) for j in range(1500)]
    df = spark.createDataFrame(rows, "k int, i int, j int")
    got = ordered.rerank(df, ["k"], ["i", "j"], "pos", block_rows=block_rows).collect()
    assert sorted((r.i, r.j, r.pos) for r in got) == [(i, j, n) for n, (_, i, j) in enumerate(sorted(rows))]


def test_fold_blocks_carries_state(spark):
    rows = [(k, i, (i * 7 + k) % 11) for k in range(3) for i in range(k * 25 + 5)]
    df = spark.createDataFrame(rows, "k bigint, i int, v int")

    def step(pdf, carried):
        total = carried.get("total")
        total = 0 if total is None or total != total else int(total)
        out = []
        for r in pdf.itertuples(index=False):
            total = (total * 3 + r.v) % 1009
            out.append(total)
        return pdf[["k", "i"]].assign(total=out)

    args = (df, ["k"], "i", step, "k bigint, i int, total int", ["total"])
    whole = {tuple(r) for r in ordered.fold_blocks(*args).collect()}
    cut = {tuple(r) for r in ordered.fold_blocks(*args, block_rows=8).collect()}
    dense = {tuple(r) for r in ordered.fold_blocks(*args, block_rows=8, dense=True).collect()}
    assert whole == cut == dense and len(whole) == len(rows)
    # Gaps make no further rounds.
    wide = df.withColumn("i", F.col("i") * 1_000_000)
    sparse = ordered.fold_blocks(wide, *args[1:], block_rows=8).collect()
    assert {(r.k, r.i // 1_000_000, r.total) for r in sparse} == whole
