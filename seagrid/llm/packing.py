"""Best-fit packing of documents into sequences of a fixed capacity, with large-item matching.

Documents are encoded where they are read; longer ones are cut into pieces of the whole capacity, the
first piece taking the rest. Pieces are alike if they have the same length, so the packing is decided
on how many pieces there are of each length, at most `capacity` numbers whatever the table's size:

* Pieces above a third of the capacity stand at most two in a sequence. Those above a half, from the
  longest down, are each matched with the longest other one that fits, which matches as many as can be;
  what is left pairs among itself.
* Smaller pieces, from the longest down, go into the smallest gap that takes them, and into new
  sequences when there is none.

A decision moves all sequences of one kind at once: pieces of a length with ranks in a range go into
sequences with numbers in a range. A sequence that takes a length is left with less than half its gap
or the length has run out, so there are some tens of thousands of decisions at most (`capacity` decides), the
size bound of what is broadcast. Each piece finds its decision by its length and rank. Ranks need no
sort: the tasks that encode number the pieces of each length, and counts by task and length give where
each task's numbers start.

The sequences are then put together by one shuffle of the ids and written; a sequence is a row of
`capacity` ids at most with the pieces it holds, and readers take a piece's ids from there.

Defined cases: a null text is empty and has only the end id; null and repeated doc_ids are documents like any
other; a text of any length is encoded whole; an empty table gives an empty result. Only the id and
text columns are read, so other columns never clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import materialise, new_path, ready_workers
from seagrid.llm.token_files import encoder_of, in_slices

CAPACITY = 2048
_RANK_BITS = 48


class _Plan:
    """Sequences in ranges of consecutive numbers that are filled alike, by the gap they have left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c}
        self.rank: dict[int, int] = defaultdict(int)  # pieces of a length that have their place
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: list[int] = []  # ascending
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap: (first number, how many)
        self.n_sequences = 0

    def _put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        """The next n pieces of a length, `each` to a sequence, behind `offset` ids."""
        at = self.rank[length]
        self.rows.append((length, at, at + n, sequence, each, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _keep(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in self.open:
                self.open[gap] = []
                insort(self.gaps, gap)
            self.open[gap].append((first, n))

    def _new(self, n: int) -> int:
        self.n_sequences += n
        return self.n_sequences - n

    def _fill(self, length: int, gap: int, first: int, n: int) -> None:
        """Pieces of a length into n sequences alike, as many as each takes, until the pieces or the sequences run out."""
        each, offset = gap // length, self.capacity - gap
        full, rest = divmod(min(self.left[length], n * each), each)
        if full:
            self._put(length, full * each, first, each, offset)
            self._keep(gap - each * length, first, full)
        if rest:
            self._put(length, rest, first + full, rest, offset)
            self._keep(gap - rest * length, first + full, 1)
        used = full + (rest > 0)
        self._keep(gap, first + used, n - used)

    def match_large(self) -> None:
        large = sorted(n for n in self.left if 3 * n > self.capacity)
        for a in reversed(large):
            while 2 * a > self.capacity and a in self.left:
                partners = [b for b in large if b in self.left and a + b <= self.capacity]
                n = min(self.left[a], self.left[partners[-1]]) if partners else self.left[a]
                first = self._new(n)
                self._put(a, n, first, 1, 0)
                if partners:
                    self._put(partners[-1], n, first, 1, a)
                self._keep(self.capacity - a - (partners[-1] if partners else 0), first, n)
        while some := [n for n in large if n in self.left]:
            a = some[-1]
            if self.left[a] > 1:
                n = self.left[a] // 2
                first = self._new(n)
                self._put(a, 2 * n, first, 2, 0)
                self._keep(self.capacity - 2 * a, first, n)
            else:
                first = self._new(1)
                self._put(a, 1, first, 1, 0)
                if len(some) > 1:
                    self._put(some[-2], 1, first, 1, a)
                self._keep(self.capacity - a - (some[-2] if len(some) > 1 else 0), first, 1)

    def fill_gaps(self) -> None:
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    each = self.capacity // length
                    n = -(-self.left[length] // each)
                    self._fill(length, self.capacity, self._new(n), n)
                    continue
                gap = self.gaps[at]
                first, n = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
                self._fill(length, gap, first, n)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, sequence, each, offset) from how many pieces there are of each length.

    The piece of rank r stands in sequence + (r - from_rank) div each, (r - from_rank) mod each pieces behind offset.
    """
    made = _Plan(counts, capacity)
    made.match_large()
    made.fill_gaps()
    return made.rows


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, part, nth): ids packed little-endian; nth counts the pieces of a length in the task `part`."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        width, part = encoder.width, TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            texts, keys = batch["text"].tolist(), pd.array(batch["doc_id"], "Int64")
            keys[batch["no_id"].to_numpy()] = pd.NA
            for a, b in in_slices(texts):
                rows, ids = [], []
                for i, raw in enumerate(encoder.encode(texts[a:b], end), a):
                    start, total, piece = 0, len(raw) // width, 0
                    while start < total:
                        n = (total - start - 1) % capacity + 1
                        rows.append((i, piece, start, n, seen[n]))
                        ids.append(raw[start * width : (start + n) * width])
                        seen[n] += 1
                        start, piece = start + n, piece + 1
                at, piece, start, length, nth = np.array(rows, "int64").T
                yield pd.DataFrame({"doc_id": keys.take(at), "piece": piece, "start": start, "length": length, "ids": ids, "part": part, "nth": nth})

    ready_workers(docs.sparkSession)
    # Null ids travel as a mark of their own: pandas would make floats of a column that has some.
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInPandas(encode, "doc_id long, piece int, start long, length int, ids binary, part int, nth long")


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with `at`, their sequence_id and offset."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")  # a row for each task
    starts = materialise(counts.select("length", "part", "n", before.alias("before")), "starts")
    totals = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = sorted(plan(totals, capacity))
    shared = spark.sparkContext.broadcast(np.array(rows, "int64").reshape(-1, 6).T)

    @F.pandas_udf("sequence_id long, offset int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks, _, sequence, each, offset = shared.value
        n, r = length.to_numpy("int64"), rank.to_numpy()
        found = np.searchsorted((lengths << _RANK_BITS) + ranks, (n << _RANK_BITS) + r, "right") - 1
        here = r - ranks[found]
        return pd.DataFrame({"sequence_id": sequence[found] + here // each[found], "offset": offset[found] + here % each[found] * n})

    # Starts grow with the number of tasks, so that Spark decides from their stored size how they are joined.
    ranked = cut.join(starts.drop("n"), ["length", "part"])
    return ranked.select("doc_id", "piece", "start", "length", "ids", place("length", F.col("before") + F.col("nth")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write rows (sequence_id, ids, pieces) under `path`: ids packed little-endian, pieces with offset, doc_id, piece, start and length in order."""
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    names = ["doc_id", "piece", "start", "length"]
    of = F.struct(F.col("at.offset").alias("offset"), *names, "ids")
    held = placed(cut, capacity).groupBy(F.col("at.sequence_id").alias("sequence_id")).agg(F.array_sort(F.collect_list(of)).alias("of"))  # at most `capacity` ids
    joined = F.unhex(F.array_join(F.transform("of", lambda p: F.hex(p["ids"])), ""))
    slim = F.transform("of", lambda p: F.struct(*[p[c].alias(c) for c in ["offset", *names]]))
    held.select("sequence_id", joined.alias("ids"), slim.alias("pieces")).write.option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece of the written sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset; the checksum is of ids of four bytes, little-endian."""

    @F.pandas_udf("long")
    def checksum(raw: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{len(x) // k}").astype("<u4").tobytes()) for x, k in zip(raw, n, strict=True)], dtype="int64")

    table = spark.read.parquet(path)
    held = F.aggregate("pieces", F.lit(0), lambda n, p: n + p["length"])
    rows = table.withColumn("width", F.expr("length(ids)") / held).select("sequence_id", "ids", F.col("width").cast("int").alias("width"), F.explode("pieces").alias("p"))
    raw = F.substring("ids", F.col("p.offset") * F.col("width") + 1, F.col("p.length") * F.col("width"))
    return rows.select("p.doc_id", "p.piece", "p.start", F.col("p.length").cast("long").alias("length"), checksum(raw, "p.length").alias("ids_crc32"), "sequence_id", F.col("p.offset").cast("long").alias("offset"))


def pack_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack into the shared folder and describe each piece from what was written."""
    path = new_path(docs.sparkSession, "packed")
    pack(docs, tokenizer, path, end_id, capacity)
    return read_packed(docs.sparkSession, path)
