"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of the digests names the few that may be very frequent. Their exact counts
and winners, at most `counters` rows, are broadcast, so copies of a hot text are settled where they
are read; every other digest has a bounded share of the rows and goes through an ordinary shuffle.

Defined cases: a null text counts as empty; texts are equal when identical after deleting the six
ASCII white-space characters; of equal texts the one with the most code points stays, then the
smallest doc_id (null ids last); of fully repeated rows exactly one stays; an empty table gives an
empty result. Only the named id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seagrid.llm.common import SPACES, materialise, ready_workers

COUNTERS = 1024


def digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary"), 256)


def _trim(counts: pd.Series, counters: int) -> pd.Series:
    """The Misra-Gries reduction: at most `counters` entries, each lowered by the largest one that goes."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False)
    counts = counts.iloc[:counters] - counts.iloc[counters]
    return counts[counts > 0]


def summary(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Rows (digest, n): a merged Misra-Gries summary of at most `counters` digests.

    Holds every digest that makes up more than 2 / counters of the rows.
    """

    def one_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = _trim(held.add(batch["digest"].value_counts(), fill_value=0), counters)
        yield pd.DataFrame({"digest": held.index.astype(str), "n": held.to_numpy().astype("int64")})

    ready_workers(digests.sparkSession)
    parts = digests.select("digest").mapInPandas(one_part, "digest string, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)


def _rank() -> Column:
    return F.struct((-F.col("n_cp")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


def heavy_winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact (digest, group_size, best) of the frequent digests: at most `counters` rows."""
    named = F.broadcast(summary(rows, counters).select("digest"))
    exact = rows.join(named, "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_rank()).alias("best"))
    n = rows.agg(F.count("*").alias("n_rows"))
    return exact.crossJoin(F.broadcast(n)).where(F.col("group_size") * counters > F.greatest("n_rows", F.lit(counters))).drop("n_rows")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"),
            digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    heavy = materialise(heavy_winners(rows, counters), "heavy")
    split = rows.join(F.broadcast(heavy), "digest", "left")
    # The row's place decides between repeated rows, so the winner of a hot text is known where it is read.
    hot = split.where(F.col("best").isNotNull()).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (_rank() == F.col("best")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    order = group.orderBy(F.desc("n_cp"), F.asc_nulls_last("doc_id"), "row")
    light = split.where(F.col("best").isNull()).select(
        "doc_id",
        F.first("doc_id").over(order).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
        "digest",
    )
    return hot.unionByName(light).withColumnRenamed("digest", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """docs without the copies, all columns kept. Losers of hot texts go where they are read, without a shuffle."""
    key = F.struct((-F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("longest"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), digest(F.col(text_col)).alias("digest"), key.alias("key"))
    slim = materialise(keyed.select("digest", (-F.col("key.longest")).alias("n_cp"), F.col("key.doc_id").alias("doc_id"), F.lit(0).alias("row")), "digests")
    heavy = materialise(heavy_winners(slim, counters), "heavy")
    best = F.struct("best.longest", "best.no_id", "best.doc_id")
    rest = keyed.join(F.broadcast(heavy.select("digest", "best")), "digest", "left").where(F.col("best").isNull() | (F.col("key") == best))
    # Repeated rows of a winner are alike; partial aggregation leaves one of each task before the shuffle.
    return rest.groupBy("digest").agg(F.min_by("row", "key").alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
