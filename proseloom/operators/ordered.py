"""Ordered scans that never put an unbounded key into one task.

``idx`` is an integer column, unique within the key; gaps are allowed. Each key is
cut into blocks of ``block_rows`` index values: a row is scanned inside its block,
one summary row per block is scanned per key, and the summary of the earlier blocks
is joined back. There is one plan for tables of every size.

``cut`` writes the input of a scan to the checkpoint folder first, because the scan
reads it twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import checkpoint_dir

BLOCK_ROWS = 65_536
_BLK = "__blk"


def _with_block(df: DataFrame, idx: str, block_rows: int) -> DataFrame:
    return df.withColumn(_BLK, F.floor(F.col(idx) / F.lit(block_rows)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read to the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    aggs: Mapping[str, tuple[str, Column]],
    *,
    reverse: bool = False,
    cut: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running aggregates from the first row of the key up to the current row.

    ``aggs`` maps an output column to ``(kind, value)`` with kind ``sum``,
    ``count``, ``max``, ``min`` or ``last`` (latest non-null value). With
    ``reverse`` the scan starts at the last row.
    """
    keys = list(keys)

    def order(name: str) -> Column:
        return F.col(name).desc() if reverse else F.col(name).asc()

    def scan(kind: str, value: Column, window) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](value).over(window)

    kept = [F.col(c) for c in df.columns if c not in aggs]
    inputs = {name: f"__v_{name}" for name in aggs}
    rows = _with_block(df, idx, block_rows).select(
        "*", *[value.alias(inputs[name]) for name, (_, value) in aggs.items()]
    )
    rows = cut_lineage(rows) if cut else rows
    in_block = (
        W.partitionBy(*keys, _BLK).orderBy(order(idx)).rowsBetween(W.unboundedPreceding, 0)
    )
    before = W.partitionBy(*keys).orderBy(order(_BLK)).rowsBetween(W.unboundedPreceding, -1)

    local, summary, carry = [], [], []
    for name, (kind, _) in aggs.items():
        v, c = F.col(inputs[name]), f"__c_{name}"
        local.append(scan(kind, v, in_block).alias(f"__l_{name}"))
        if kind == "last":
            newest = F.min_by if reverse else F.max_by
            summary.append(newest(v, F.when(v.isNotNull(), F.col(idx))).alias(c))
            carry.append(F.last(F.col(c), ignorenulls=True).over(before).alias(c))
        else:
            fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
            summary.append(fn(v).alias(c))
            carry.append(_MERGE[kind](F.col(c)).over(before).alias(c))

    carried = (
        rows.groupBy(*keys, _BLK)
        .agg(*summary)
        .select(*keys, _BLK, *carry)
        .where(" OR ".join(f"`__c_{n}` IS NOT NULL" for n in aggs))
    )
    joined = rows.select("*", *local).join(carried, [*keys, _BLK], "left")

    out = []
    for name, (kind, _) in aggs.items():
        here, past = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "last":
            merged = F.coalesce(here, past)
        elif kind in ("sum", "count"):
            merged = F.when(past.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + past)
        else:
            merged = (F.greatest if kind == "max" else F.least)(here, past)
        out.append(merged.alias(name))
    return joined.select(*kept, *out)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    *,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,  # noqa: A002 - reads well at the call site
    cut: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of the row before (``prev``) and after (``next``) in index order."""
    keys, prev, next = list(keys), dict(prev or {}), dict(next or {})
    kept = [F.col(c) for c in df.columns if c not in {**prev, **next}]
    rows = _with_block(df, idx, block_rows).select(
        "*",
        *[v.alias(f"__p_{n}") for n, v in prev.items()],
        *[v.alias(f"__n_{n}") for n, v in next.items()],
    )
    rows = cut_lineage(rows) if cut else rows
    in_block = W.partitionBy(*keys, _BLK).orderBy(idx)
    across = W.partitionBy(*keys).orderBy(_BLK)

    columns = [F.col(c) for c in rows.columns]
    summary, carry, present = [], [], []
    if prev:
        tail = F.struct(*[F.col(f"__p_{n}").alias(n) for n in prev])
        columns.append(F.lag(tail).over(in_block).alias("__lag"))
        summary.append(F.max_by(tail, F.col(idx)).alias("__tail"))
        carry.append(F.lag("__tail").over(across).alias("__lag_c"))
        present.append("__lag_c IS NOT NULL")
    if next:
        head = F.struct(*[F.col(f"__n_{n}").alias(n) for n in next])
        columns.append(F.lead(head).over(in_block).alias("__lead"))
        summary.append(F.min_by(head, F.col(idx)).alias("__head"))
        carry.append(F.lead("__head").over(across).alias("__lead_c"))
        present.append("__lead_c IS NOT NULL")

    carried = (
        rows.groupBy(*keys, _BLK)
        .agg(*summary)
        .select(*keys, _BLK, *carry)
        .where(" OR ".join(present))
    )
    joined = rows.select(*columns).join(carried, [*keys, _BLK], "left")
    out = [F.coalesce(F.col("__lag"), F.col("__lag_c"))[n].alias(n) for n in prev]
    out += [F.coalesce(F.col("__lead"), F.col("__lead_c"))[n].alias(n) for n in next]
    return joined.select(*kept, *out)


def lags(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    values: Mapping[str, tuple[Column, int]],
    *,
    cut: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of earlier rows: each output column takes ``(value, n)``, the value ``n`` rows before.

    Inside a block a plain window serves. Only the first rows of a block look into
    earlier ones, so the first and last rows of all blocks of a key are scanned
    together: what comes before a first row is among them.
    """
    keys, depth = list(keys), max(n for _, n in values.values())
    kept = [F.col(c) for c in df.columns if c not in values]
    rows = _with_block(df, idx, block_rows).select("*", *[v.alias(f"__v_{n}") for n, (v, _) in values.items()])
    rows = cut_lineage(rows) if cut else rows
    in_block = W.partitionBy(*keys, _BLK).orderBy(idx)
    from_end = W.partitionBy(*keys, _BLK).orderBy(F.col(idx).desc())
    whole = W.partitionBy(*keys).orderBy(idx)
    ends = rows.select(
        *keys, idx, _BLK, *[f"__v_{n}" for n in values],
        F.row_number().over(in_block).alias("__first"), F.row_number().over(from_end).alias("__last"),
    )
    ends = ends.where((F.col("__first") <= depth) | (F.col("__last") <= depth))
    edge = ends.select(
        *keys, F.col(idx).alias("__at"), _BLK, "__first", *[F.lag(f"__v_{n}", k).over(whole).alias(f"__e_{n}") for n, (_, k) in values.items()]
    )
    # Rows of the first block of the index have nothing before them.
    edge = edge.where((F.col("__first") <= depth) & (F.col(_BLK) > 0)).drop("__first", _BLK)
    local = rows.select("*", F.row_number().over(in_block).alias("__n"), *[F.lag(f"__v_{n}", k).over(in_block).alias(f"__l_{n}") for n, (_, k) in values.items()])
    joined = local.join(edge.withColumnsRenamed({k: f"__k_{k}" for k in keys}), [local[k].eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [local[idx] == F.col("__at")], "left")
    taken = [F.when(F.col("__n") > k, F.col(f"__l_{n}")).otherwise(F.col(f"__e_{n}")).alias(n) for n, (_, k) in values.items()]
    return joined.select(*kept, *taken)


def renumber(
    df: DataFrame, keys: Sequence[str], idx: str, name: str, start: int = 0, **how
) -> DataFrame:
    """Dense position of each row in its key, counted from ``start``."""
    out = running(df, keys, idx, {name: ("count", F.lit(1))}, **how)
    return out.withColumn(name, F.col(name) + F.lit(start - 1))


def rerank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Dense position for rows ordered by ``order[0]`` (source position) and then by
    ``order[1]`` (piece of it), for rows made by splitting or adding to others.

    The pieces of one source row are few. They are counted per source row, and only
    the counts take part in the scan.
    """
    keys = list(keys)
    outer, inner = order
    sizes = df.groupBy(*keys, outer).agg(F.count(F.lit(1)).alias("__n"))
    offsets = running(
        sizes, keys, outer, {"__end": ("sum", F.col("__n"))}, block_rows=block_rows
    ).select(*keys, outer, (F.col("__end") - F.col("__n")).alias("__base"))
    piece = W.partitionBy(*keys, outer).orderBy(inner)
    return (
        df.withColumn("__rn", F.row_number().over(piece) - 1)
        .join(offsets, [*keys, outer])
        .withColumn(name, F.col("__base") + F.col("__rn"))
        .drop("__base", "__rn")
    )


def fold_blocks(
    rows: DataFrame,
    keys: Sequence[str],
    idx: str,
    step,
    out_schema: str,
    state: Sequence[str],
    *,
    side: DataFrame | None = None,
    dense: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sequential scan per key with a small carried state, one block at a time.

    ``step(pdf, carried)`` gets the rows of one block in index order and a dict
    with the row of ``side`` for the key, if given, and the state after the
    block before (missing or null at the start of a key). It returns a frame
    with ``out_schema``, which holds the state columns as they are after each
    row. All keys advance together, so the number of rounds is the number of
    blocks of the longest key: one for keys of up to ``block_rows`` rows. Blocks
    are cut by the position of a row; ``dense`` tells that ``idx`` counts the rows
    of the key, or of a wider one in which the key's rows follow each other.
    """
    import pandas as pd

    keys, names = list(keys), list(state)
    fields = [field.split()[0] for field in out_schema.split(", ")]
    at = idx
    if not dense:
        rows, at = renumber(rows, keys, idx, "__pos"), "__pos"
    blocked = _with_block(rows, at, block_rows)
    blocked = blocked if dense else blocked.drop("__pos")

    def alone(pdf):
        return step(pdf.sort_values(idx), {})

    def beside(pdf, other):
        if pdf.empty:
            return pd.DataFrame(columns=fields)
        return step(pdf.sort_values(idx), other.iloc[0].to_dict() if len(other) else {})

    def apply(part: DataFrame, other: DataFrame | None) -> DataFrame:
        grouped = part.drop(_BLK).groupBy(*keys)
        if other is None:
            return grouped.applyInPandas(alone, out_schema)
        # Fresh column identities: both sides may come from the same table.
        other = other.select(*[F.col(c).alias(c) for c in other.columns])
        return grouped.cogroup(other.groupBy(*keys)).applyInPandas(beside, out_schema)

    blocked = cut_lineage(blocked)
    longest = blocked.agg(F.max(_BLK)).first()[0] or 0
    done = latest = None
    for block in range(int(longest) + 1):
        other = side
        if latest is not None:
            other = latest if side is None else side.join(latest, keys, "left")
        out = apply(blocked.where(F.col(_BLK) == block), other)
        if block < longest:
            out = cut_lineage(out)
            # A key that goes on has rows in this block: only their last state is carried.
            latest = (
                out.groupBy(*keys)
                .agg(F.max_by(F.struct(*names), F.col(idx)).alias("__s"))
                .select(*keys, *[F.col(f"__s.{n}").alias(n) for n in names])
            )
        done = out if done is None else done.unionByName(out)
    return done
