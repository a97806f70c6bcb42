"""SimHash near-deduplication by the generalised pigeonhole principle.

If thresholds t_i of a partition of the 64 bits have sum(t_i + 1) = t + 1, two fingerprints that
differ in at most t bits differ in at most t_i bits of some part i. Correlated bits are put in the
same part, so that the parts are as independent as they can be. Each fingerprint chooses its own
thresholds, -1 for a part it leaves out, by dynamic programming on the numbers of candidates that a
fixed-size table of counts estimates. It probes the values within t_i bits of its own part i in an
index of all fingerprints, and what it meets is verified.

The estimates never fall below the true numbers. A fingerprint whose cheapest choice is estimated
above `most` (a dense neighbourhood) is not probed; two such fingerprints within two bits have a
64-bit value within one bit of both, so each is filed under itself and its 64 neighbours and every
file is linked to its smallest member. The work is at most `most` or 65 rows per fingerprint, no
link is lost, and nothing is capped.

Works on distinct fingerprints; documents come in again by an equi-join. Defined cases: a null or
wordless text has fingerprint zero, linked like any other; fewer words than a shingle give one
shingle; null ids keep their row and never name a component unless all ids are null; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seagrid.llm.common import ready_workers, connected_components, materialise

SEED = 42
SHINGLE = 3
DISTANCE = 2
PARTS = 3
MOST = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BINS = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - shingle + 1)
    ends = starts[shingle:] if len(words) > shingle else [len(line) + 1]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        some = slice(at, min(at + 65536, n))
        h = np.fromiter((digest(line[a : b - 1], seed) for a, b in zip(starts[some], ends[some], strict=True)), "<u8", some.stop - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (the 64 bits as a signed long), text_hash."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    ready_workers(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), of(text).alias("fp"), F.xxhash64(text).alias("text_hash"))


def correlated_parts(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The 64 bits in groups of nearly equal size, correlated ones together. Only 64 x 64 sums reach the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pd.DataFrame({"pos": np.arange(4097), "n": np.append(total.ravel(), n)})

    sums = fps.select("fp").mapInPandas(moments, "pos int, n long").groupBy("pos").agg(F.sum("n").alias("n")).orderBy("pos").collect()
    got = np.array([r["n"] for r in sums], float) if sums else np.zeros(4097)
    n = max(got[4096], 1.0)
    both = got[:4096].reshape(64, 64) / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(64)), []
    for i in range(parts):
        want = -(-len(left) // (parts - i))
        group = [max(left, key=lambda b: (tied[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < want:
            group.append(max(left, key=lambda b: (tied[b, group].mean(), -b)))
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of one part of each fingerprint."""
    fps = fps.view(np.uint64)
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def flips(width: int, within: int) -> np.ndarray:
    """All masks of at most `within` ones."""
    return np.array([sum(1 << b for b in c) for k in range(within + 1) for c in itertools.combinations(range(width), k)], np.uint64)


def _bin(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def allocate(costs: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (rows, parts) of least total cost with sum(t + 1) = distance + 1, and that cost.

    costs[i, u] is each row's cost of spending u on part i, that is of threshold u - 1.
    """
    parts, _, n = costs.shape
    best = np.full((distance + 2, n), np.inf)
    best[0] = 0
    picks = np.zeros((parts, distance + 2, n), np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for total in range(distance + 2):
            for spent in range(total + 1):
                c = best[total - spent] + costs[i, spent]
                better = c < new[total]
                new[total] = np.where(better, c, new[total])
                picks[i, total] = np.where(better, spent, picks[i, total])
        best = new
    thresholds = np.empty((n, parts), np.int64)
    left = np.full(n, distance + 1)
    for i in range(parts - 1, -1, -1):
        spent = picks[i, left, np.arange(n)]
        thresholds[:, i] = spent - 1
        left = left - spent
    return thresholds, best[distance + 1]


def links(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `fp` that connect all those within `distance` bits, which is 2."""
    if distance != 2:
        raise ValueError("dense neighbourhoods are linked over one value between, which fits a distance of 2 only")
    ready_workers(nodes.sparkSession)
    groups = correlated_parts(nodes, parts)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((parts, _BINS), np.int64)
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for i, bits in enumerate(groups):
                counts[i] += np.bincount(_bin(gather(fps, bits)), minlength=_BINS)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"pos": at, "n": flat[at]})

    # A table of parts x 65,536 counts, whatever the number of fingerprints.
    table = np.zeros(parts * _BINS, np.float32)
    got = nodes.select("fp").mapInPandas(bins, "pos long, n long").groupBy("pos").agg(F.sum("n").alias("n")).toPandas()
    table[got["pos"].to_numpy(np.int64)] = got["n"]
    held = nodes.sparkSession.sparkContext.broadcast(table.reshape(parts, _BINS))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                fps = batch["fp"].to_numpy(np.int64)[at : at + 2048]
                values = [gather(fps, bits) for bits in groups]
                costs = np.zeros((parts, distance + 2, len(fps)), np.float32)
                for i, bits in enumerate(groups):
                    for t in range(distance + 1):
                        near = values[i][:, None] ^ flips(len(bits), t)[None, :]
                        costs[i, t + 1] = held.value[i][_bin(near)].sum(1)
                thresholds, cost = allocate(costs, distance)
                dense = cost - (thresholds >= 0).sum(1) > most
                own = fps[dense].view(np.uint64)
                mid = own[:, None] ^ flips(64, 1)[None, :]
                yield pd.DataFrame({"fp": np.repeat(fps[dense], 65), "part": -1, "value": mid.ravel().view(np.int64)})
                for i, bits in enumerate(groups):
                    for t in range(distance + 1):
                        use = ~dense & (thresholds[:, i] == t)
                        if use.any():
                            near = values[i][use][:, None] ^ flips(len(bits), t)[None, :]
                            yield pd.DataFrame({"fp": np.repeat(fps[use], near.shape[1]), "part": i, "value": near.ravel().view(np.int64)})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for i, bits in enumerate(groups):
                yield pd.DataFrame({"x": fps, "part": i, "value": gather(fps, bits).view(np.int64)})

    probes = materialise(nodes.select("fp").mapInPandas(probe, "fp long, part int, value long"), "probes")
    indexed = nodes.select("fp").mapInPandas(index, "x long, part int, value long")
    met = probes.where("part >= 0").join(indexed, ["part", "value"]).where("fp <> x")
    close = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("x"))) <= distance)
    verified = close.select(F.least("fp", "x").alias("a"), F.greatest("fp", "x").alias("b")).distinct()
    filed = probes.where("part = -1").select("value", "fp")
    least = filed.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = filed.join(least, "value").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    return verified.unionByName(stars)


def near_duplicate_groups(rows: DataFrame, distance: int = DISTANCE, parts: int = PARTS, most: int = MOST) -> DataFrame:
    """Rows (fp, component_id, keeper): each fingerprint's component and the struct (doc_id, text_hash) that stays.

    rows: fingerprints(). The component is named by its smallest doc_id, which is also the one that stays.
    """
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = materialise(rows.groupBy("fp").agg(F.min(best).alias("best")), "nodes")
    edges = materialise(links(nodes.select("fp"), distance, parts, most), "links")
    comps = connected_components(edges)
    named = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "best", F.coalesce("component", "fp").alias("component"))
    named = materialise(named, "named")
    joined = named.groupBy("component").agg(F.min("best").alias("keeper"))
    return named.join(joined, "component").select("fp", F.col("keeper.doc_id").alias("component_id"), F.struct("keeper.doc_id", "keeper.text_hash").alias("keeper"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = near_duplicate_groups(rows, distance)
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each component, the one of the smallest id, all columns kept.

    Whole rows are shuffled once; of rows equal in id and text one is left by each task before that.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    keeper = near_duplicate_groups(rows, distance).select("keeper.*").distinct()
    named = lambda i, h: [i.isNull().alias("no_id"), F.coalesce(i, F.lit(0)).cast("long").alias("own"), h.alias("hash")]
    keepers = keeper.select(*named(F.col("doc_id"), F.col("text_hash")))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *named(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    kept = keyed.groupBy("no_id", "own", "hash").agg(F.first("row").alias("row")).join(keepers, ["no_id", "own", "hash"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
