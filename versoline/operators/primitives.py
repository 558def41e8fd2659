"""Skew-safe building blocks over ordered groups.

A plain ``Window.partitionBy(book)`` puts a whole book on one task, and one book may hold a third of
all rows.  Every ordered operator of this package is therefore built on ``scan``: the group is sliced
into buckets along its own order, each bucket is processed on its own task, and one pre-aggregated
row per bucket carries the state from bucket to bucket.  Only those summaries meet on one task.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versoline.session import ensure_checkpoint_dir

BUCKET = "__bucket"


@dataclass(frozen=True)
class Op:
    """One running value: ``kind`` says which rows it looks at, ``expr`` what it takes from them."""

    kind: str
    expr: Column


def running_sum(expr: Column) -> Op:
    """Sum up to and including the current row."""
    return Op("sum_to", expr)


def row_index() -> Op:
    """0-based position inside the group."""
    return Op("index", F.lit(1).cast("bigint"))


def max_before(expr: Column) -> Op:
    return Op("max_before", expr)


def max_to(expr: Column) -> Op:
    return Op("max_to", expr)


def min_after(expr: Column) -> Op:
    return Op("min_after", expr)


def previous(expr: Column) -> Op:
    """Value of the row just before (null at the start of the group)."""
    return Op("prev", expr)


def following(expr: Column) -> Op:
    """Value of the row just after (null at the end of the group)."""
    return Op("next", expr)


def last_known(expr: Column) -> Op:
    """Last non-null value at or before the current row."""
    return Op("last_to", expr)


def next_known(expr: Column) -> Op:
    """First non-null value strictly after the current row."""
    return Op("first_after", expr)


_FORWARD = {"min_after", "next", "first_after"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    bucket: Column,
    ops: dict[str, Op],
    in_ranges: bool = False,
) -> DataFrame:
    """Add running values over ``keys`` in ``order`` without gathering a group on one task.

    With ``in_ranges`` buckets are ranges of (keys, order): at most two groups a range go on in another, so what is carried is broadcast.
    ``bucket`` must never decrease along ``order`` (e.g. ``floor(audio_ms / width)``), so that buckets
    are consecutive slices of the group.  ``order`` must be total, or ties give arbitrary neighbours.
    """
    ordering = [_col(c) for c in order]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ordering)])
    sliced = [*keys, BUCKET]
    df = df.withColumn(BUCKET, bucket)
    for c in sliced:
        df = df.filter(F.col(c).isNotNull())
    df = df.repartition(*sliced)

    # One row per bucket.  Rows and summaries both come out of the one exchange above: the fingerprint
    # makes the summaries read the same columns, so the planner sees one shuffle and reuses it.
    parts = [F.max(F.xxhash64(*df.columns)).alias("__seen")]
    for name, op in ops.items():
        if op.kind in ("sum_to", "index"):
            part = F.sum(op.expr)
        elif op.kind in ("max_before", "max_to"):
            part = F.max(op.expr)
        elif op.kind == "min_after":
            part = F.min(op.expr)
        elif op.kind == "prev":
            part = F.max_by(F.struct(op.expr.alias("v")), rank)
        elif op.kind == "next":
            part = F.min_by(F.struct(op.expr.alias("v")), rank)
        elif op.kind == "last_to":
            part = F.max_by(F.struct(op.expr.alias("v")), F.when(op.expr.isNotNull(), rank))
        elif op.kind == "first_after":
            part = F.min_by(F.struct(op.expr.alias("v")), F.when(op.expr.isNotNull(), rank))
        else:
            raise ValueError(op.kind)
        parts.append(part.alias(f"__s_{name}"))
    summaries = df.groupBy(*sliced).agg(*parts)

    before = Window.partitionBy(*keys).orderBy(F.col(BUCKET).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, op in ops.items():
        s, w = F.col(f"__s_{name}"), after if op.kind in _FORWARD else before
        if op.kind in ("sum_to", "index"):
            c = F.sum(s).over(w)
        elif op.kind in ("max_before", "max_to"):
            c = F.max(s).over(w)
        elif op.kind == "min_after":
            c = F.min(s).over(w)
        else:
            c = F.last(s, ignorenulls=True).over(w)
        carried.append(c.alias(f"__c_{name}"))
    carries = summaries.filter("__seen is not null").select(*sliced, *carried)

    if in_ranges:
        group = Window.partitionBy(*keys)
        carries = carries.withColumn("__cut", F.min(BUCKET).over(group) < F.max(BUCKET).over(group)).filter("__cut").drop("__cut")
        joined = df.join(F.broadcast(carries), sliced, "left")
    else:
        joined = df.join(carries, sliced)

    up = Window.partitionBy(*sliced).orderBy(*[c.asc() for c in ordering])
    down = Window.partitionBy(*sliced).orderBy(*[c.desc() for c in ordering])
    to_here = up.rowsBetween(Window.unboundedPreceding, 0)
    before_here = up.rowsBetween(Window.unboundedPreceding, -1)
    after_here = down.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for name, op in ops.items():
        carry, v = F.col(f"__c_{name}"), F.struct(op.expr.alias("v"))
        if op.kind == "sum_to":
            r = F.coalesce(F.sum(op.expr).over(to_here), F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif op.kind == "index":
            r = F.row_number().over(up) - 1 + F.coalesce(carry, F.lit(0))
        elif op.kind == "max_before":
            r = F.greatest(F.max(op.expr).over(before_here), carry)
        elif op.kind == "max_to":
            r = F.greatest(F.max(op.expr).over(to_here), carry)
        elif op.kind == "min_after":
            r = F.least(F.min(op.expr).over(after_here), carry)
        elif op.kind == "prev":
            r = F.coalesce(F.lag(v).over(up), carry)["v"]
        elif op.kind == "next":
            r = F.coalesce(F.lead(v).over(up), carry)["v"]
        elif op.kind == "last_to":
            known = F.when(op.expr.isNotNull(), v)
            r = F.coalesce(F.last(known, ignorenulls=True).over(to_here), carry)["v"]
        else:
            known = F.when(op.expr.isNotNull(), v)
            r = F.coalesce(F.last(known, ignorenulls=True).over(after_here), carry)["v"]
        out.append(r.alias(name))
    kept = [F.col(c) for c in df.columns if c != BUCKET and c not in ops]
    return joined.select(*kept, *out)


def sliced_by_rank(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "__range") -> DataFrame:
    """Stage ``df`` with the number of the range of (keys, order) a row falls into, for orders that no arithmetic cuts evenly.

    Spark samples the splitters, so a group's ranges follow its own rows however much of its names' beginnings they share; only rows
    equal in all of ``keys`` and ``order`` stay together.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordering = [_col(c).asc_nulls_first() for c in order]
    return stage(df.repartitionByRange(ranges, *[F.col(k) for k in keys], *ordering).withColumn(name, F.spark_partition_id()))


def scan_ranges(df: DataFrame, keys: list[str], order: list[Column | str], ops: dict[str, Op]) -> DataFrame:
    """``scan`` over ranges with sampled splitters: one carried row per range and group, whatever the order is made of."""
    return scan(sliced_by_rank(df, keys, order), keys, order, F.col("__range"), ops, in_ranges=True).drop("__range")


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write an intermediate to the shared checkpoint folder once and go on from the written copy, in a directory per value of ``by``.

    Scans read their input twice; without a cut, nested scans would plan their inputs 2^depth times.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def stage_buckets(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``stage`` in buckets of ``by``, as many as a shuffle has partitions, sorted by ``order``: what groups or joins by it reads them without a shuffle.

    Spark knows buckets of tables only: the table's name is taken back at once, its files stay.  ``df`` comes dealt by ``by``.
    """
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(shuffle_partitions(spark), by).sortBy(by, *order).saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    spark.sql(f"drop table {name}")
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows over all shuffle partitions, for work that is heavy per row and light per byte.

    A stated partition count keeps adaptive execution from merging small partitions into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def slice_of(position: Column | str, width: int) -> Column:
    return F.floor(_col(position) / F.lit(width))


def bracket(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    on: str,
    cols: list[str],
    width: int,
    lo: str = "lo",
    hi: str = "hi",
) -> DataFrame:
    """As-of join both ways: add ``lo`` (last right row with ``on <= at``) and ``hi`` (first with ``on > at``).

    ``right`` is unique per (keys, on); positions are integers.  Right rows become segments between
    neighbours, each listed under every bucket of ``width`` it touches, so a lookup is an equi-join on
    (keys, bucket) with a residual range check.  The left side is read once, is never sorted as a group,
    and a hot bucket of lookups is an ordinary skewed join that adaptive execution splits.  Lookups
    outside the outermost right rows are answered from one row per key.
    """
    row = F.struct(F.col(on).cast("bigint").alias(on), *[F.col(c) for c in cols if c != on])
    r = right.select(*keys, F.col(on).cast("bigint").alias("__on"), row.alias("__r"))
    ends = r.groupBy(*keys).agg(F.min_by("__r", "__on").alias("__first"), F.max_by("__r", "__on").alias("__final"))
    segments = scan(r, keys, ["__on"], slice_of("__on", width * 64), {"__n": following(F.col("__r"))}).filter(
        "__n is not null")
    segments = segments.select(
        *keys, "__on", F.col(f"__n.{on}").alias("__end"), F.col("__r").alias("__lo"), F.col("__n").alias("__hi"),
        F.explode(F.sequence(slice_of("__on", width), slice_of(F.col(f"__n.{on}") - 1, width))).alias("__b"))
    p = F.col(at).cast("bigint")
    first, final = F.col(f"__first.{on}"), F.col(f"__final.{on}")
    asked = left.join(ends, keys, "left").withColumn(
        "__b", F.when((p >= first) & (p < final), slice_of(p, width))).withColumn("__p", p)
    hit = asked.alias("q").join(
        segments.alias("s"),
        _all_equal("q", "s", [*keys, "__b"]) & (F.col("q.__p") >= F.col("s.__on")) & (F.col("q.__p") < F.col("s.__end")),
        "left")
    p, first, final = F.col("q.__p"), F.col(f"q.__first.{on}"), F.col(f"q.__final.{on}")
    low = F.when(p >= final, F.col("q.__final")).otherwise(F.col("s.__lo"))
    high = F.when(p < first, F.col("q.__first")).otherwise(F.col("s.__hi"))
    return hit.select(*[F.col(f"q.{c}").alias(c) for c in left.columns], low.alias(lo), high.alias(hi))


def _all_equal(a: str, b: str, cols: list[str]) -> Column:
    out = F.col(f"{a}.{cols[0]}") == F.col(f"{b}.{cols[0]}")
    for c in cols[1:]:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def at_or_after(on: str, at: str, lo: str = "lo", hi: str = "hi") -> Column:
    """First right row with ``on >= at`` out of a bracket."""
    return F.when(F.col(f"{lo}.{on}") == F.col(at), F.col(lo)).otherwise(F.col(hi))


def nearest(on: str, at: str, lo: str = "lo", hi: str = "hi") -> Column:
    """Nearest right row out of a bracket; the earlier one on equal distance."""
    below = F.col(at) - F.col(f"{lo}.{on}")
    above = F.col(f"{hi}.{on}") - F.col(at)
    return F.when(below.isNull() | (above < below), F.col(hi)).otherwise(F.col(lo))


def on_path(nodes: DataFrame, keys: list[str], at: str, to: str) -> DataFrame:
    """(keys, at) of the nodes met on the way from each group's first node, jump by jump, without walking a group in order.

    ``nodes`` has one row per (keys, at); ``to`` is the ``at`` a node jumps to, further on, or null.  Jumps are doubled until none is
    left; then the marked nodes are spread by the longest jumps first, so a way of n jumps takes log n joins.
    """
    jumps = stage(nodes.filter(F.col(to).isNotNull()).select(*keys, F.col(at).alias("__from"), F.col(to).alias("__to")))
    levels = []
    while not jumps.isEmpty():
        levels.append(jumps)
        more = jumps.select(*keys, F.col("__to").alias("__end"), F.col("__from").alias("__to"))
        jumps = stage(jumps.join(more, [*keys, "__to"]).select(*keys, "__from", F.col("__end").alias("__to")))
    marked = stage(nodes.groupBy(*keys).agg(F.min(at).alias("__from")))
    for jumps in reversed(levels):
        marked = stage(marked.unionByName(marked.join(jumps, [*keys, "__from"]).select(*keys, F.col("__to").alias("__from"))))
    return marked.withColumnRenamed("__from", at)


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """Order-dependent fold per group, streamed batch by batch with constant state.

    ``step`` makes a fresh folding object per group; calling it with a batch returns its output rows.  No group is held in memory: Arrow batches arrive in order and leave as they are folded.
    Many small groups share one batch, so a group costs no call into Spark.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folding, last = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            own, pdf = pdf["__group"].to_numpy(), pdf[names]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), len(pdf)]
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                if folding is None or own[a] != last:
                    folding, last = step(), own[a]
                parts.append(folding(pdf.iloc[a:b]))
            yield pd.concat(parts)

    # The keys with their nulls as one number: neighbouring groups differ in it.
    group = F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]).alias("__group")
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names, group)
    return ordered.mapInPandas(run, schema)


def keep_in_groups(df: DataFrame, keys: list[str], order: list[str], choose) -> DataFrame:
    """Keep the rows ``choose`` marks in each group of ``keys``, rows sorted by ``order``.

    For solvers no SQL expression can state.  ``choose`` gets a dict of NumPy columns and returns a
    boolean mask.  Many small groups share one Arrow batch, so a group costs no call into Spark.
    Callers reduce groups first: a group is held whole by its task.
    """
    schema = df.schema
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            changes = np.flatnonzero(_changes(pdf, keys))
            same = held and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)
            if same and not len(changes):
                held.append(pdf)
                continue
            cut = changes[-1] + 1 if len(changes) else 0
            ready = pd.concat([*held, pdf.iloc[:cut]]) if held else pdf.iloc[:cut]
            held = [pdf.iloc[cut:]]
            if len(ready):
                yield _chosen(ready, keys, choose)
        if held:
            yield _chosen(pd.concat(held), keys, choose)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema).select(*names)


def _changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True at row i when row i + 1 belongs to another group."""
    out = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
    for k in keys:
        v = pdf[k].to_numpy()
        out |= v[1:] != v[:-1]
    return out


def _chosen(pdf: pd.DataFrame, keys: list[str], choose) -> pd.DataFrame:
    starts = [0, *(np.flatnonzero(_changes(pdf, keys)) + 1), len(pdf)]
    columns = {c: pdf[c].to_numpy() for c in pdf.columns}
    mask = np.zeros(len(pdf), dtype=bool)
    for a, b in zip(starts, starts[1:]):
        mask[a:b] = choose({c: v[a:b] for c, v in columns.items()})
    return pdf[mask]
