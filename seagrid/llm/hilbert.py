"""Sharding along a Hilbert curve.

Metadata columns are quantised into 2**bits cells each, a cell's place on the Hilbert curve is its
index, and the rows in curve order are cut into runs whose counts are at most one apart. A run is a
compact region of the metadata space, so min/max statistics of every dimension prune whole shards.

Boundaries of the cells: quantiles over all rows for numbers, evenly spaced distinct values for
strings (from at most `distinct_bound` values, those of the smallest hash; only the balance of the
cells depends on it). Rows of one cell are dealt to groups by a hash of their id and text, so many that
a group has about GROUP_ROWS rows at most even if all rows share a cell; exact positions come from counts
per (index, group), so no window spans more than one group and no task sees all rows.

The law is `rows`, so equal texts are no unit: copies may be in different shards.

Defined cases: a null in a dimension is in its lowest cell; a null text has no bytes; null ids come
first in their group; repeated rows take neighbouring slots; an empty table gives an empty result;
fewer rows than shards leave the last shards empty. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 4
GROUPS, GROUP_ROWS = 64, 1 << 18
DISTINCT_BOUND = 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points of shape (n, dimensions), by the transform of Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def boundaries(docs: DataFrame, column: str, cells: int, distinct_bound: int = DISTINCT_BOUND) -> list:
    """At most cells - 1 ascending values; a row's cell is the number of them at or below its value."""
    if isinstance(docs.schema[column].dataType, T.NumericType):
        at = [i / cells for i in range(1, cells)]
        cut = docs.agg(F.percentile_approx(column, at, 10_000)).first()[0] or []
        return sorted(set(cut))
    seen = docs.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    values = sorted((r[0] for r in seen.orderBy(F.xxhash64("v"), "v").limit(distinct_bound).collect()), key=lambda v: v.encode())
    if len(values) <= cells:
        return values[1:]
    return [values[len(values) * i // cells] for i in range(1, cells)]


def _cell(column: Column, cut: list, kind: str) -> Column:
    if not cut:
        return F.lit(0)
    limits = F.array(*[F.lit(v) for v in cut]).cast(f"array<{kind}>")
    return F.when(column.isNull(), 0).otherwise(F.size(F.filter(limits, lambda v: v <= column)))


def curve_index(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> tuple[Column, DataFrame]:
    """The column that numbers a row's cell, and the table (cell, curve) of all cells: 2**(bits * dimensions) rows, 65,536 at most."""
    if bits * len(dimensions) > 16:
        raise ValueError("at most 16 bits of curve index")
    cell = F.lit(0)
    for d in dimensions:
        kind = docs.schema[d].dataType
        kind = kind.simpleString() if isinstance(kind, T.NumericType) else "string"
        cell = cell * (1 << bits) + _cell(F.col(d).cast(kind), boundaries(docs, d, 1 << bits), kind)
    grid = np.indices([1 << bits] * len(dimensions)).reshape(len(dimensions), -1).T
    curve = hilbert_index(grid, bits)
    rows = docs.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(curve)], "cell int, curve int")
    return cell.cast("int"), rows


def hilbert_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve; then, if columns are named, `carried`, a struct of them.

    size is the UTF-8 bytes of the text plus 8; the law is `rows`; slots are gapless from 0 in each shard.
    """
    cell, cells = curve_index(docs, dimensions, bits)
    n_groups = max(GROUPS, -(-docs.count() // GROUP_ROWS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(id_col, text), F.lit(n_groups)).cast("int").alias("part"),
        cell.alias("cell"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    keyed = rows.join(F.broadcast(cells), "cell").drop("cell")

    counts = keyed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    whole = counts.groupBy("curve").agg(F.sum("n").alias("n"))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per cell
    whole = whole.select("curve", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("curve_from"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("curve", "part", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("part_from")).join(F.broadcast(whole), "curve")
    offsets = offsets.select("curve", "part", (F.col("curve_from") + F.col("part_from")).alias("group_from"), "total")

    order = Window.partitionBy("curve", "part").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    ranked = keyed.withColumn("nth", F.row_number().over(order) - 1).join(offsets, ["curve", "part"])
    at, base, extra = F.col("group_from") + F.col("nth"), F.expr(f"total div {n_shards}"), F.col("total") % n_shards
    ranked = ranked.withColumns({"at": at, "base": base, "extra": extra})
    long_part = F.col("extra") * (F.col("base") + 1)
    early = F.col("at") < long_part
    shard = F.when(early, F.expr("at div (base + 1)")).otherwise(F.expr("extra + (at - extra * (base + 1)) div nullif(base, 0)"))
    slot = F.when(early, F.expr("at % (base + 1)")).otherwise(F.expr("(at - extra * (base + 1)) % nullif(base, 0)"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *(["carried"] if carry else [])
    )


def write_hilbert_shards(docs: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write all columns as Parquet, a folder for each shard, rows in curve order; statistics then prune shards.

    A column `shard` of the documents gives way to the new one.
    """
    out = hilbert_shards(docs, n_shards, carry=tuple(docs.columns), **options)
    out = out.repartition("shard", (F.col("slot") / 1_000_000).cast("int")).sortWithinPartitions("shard", "slot")
    kept = [c for c in docs.columns if c != "shard"]  # the folder has the name
    out.select("shard", *[F.col("carried").getField(c).alias(c) for c in kept]).write.partitionBy("shard").parquet(path)
