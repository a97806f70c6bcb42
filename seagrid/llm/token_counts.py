"""Exact token counts of every prefix of a text, by dynamic programming over its prefixes.

The last piece of a prefix's encoding gives its count: one more than that of the prefix before the
piece (see `pieces`). Pieces do not cross the start of a run of spaces, so the counts of a text are
those of its units end to end, and the steps of a unit, what each further character adds, are
remembered in a memory of bounded size. One table of steps then answers, without encoding again, how
many tokens any prefix has and which is the longest prefix within a budget.

Defined cases: a null text is empty and has no tokens; very long texts without spaces take time in
proportion to their length; an empty table gives an empty result; only the id and text columns are
read, repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm.common import ready_workers
from seagrid.llm.pieces import Paths, Pieces, UnitMemory, load

LIMIT = 4096


class PrefixCounter:
    def __init__(self, pieces: Pieces):
        self.memory = UnitMemory(pieces, Paths.steps, pieces.steps_of_unit)

    def steps(self, texts: list[str]) -> Iterator[np.ndarray]:
        """What each code point of a text adds to its count; their running sum is the count of each prefix."""
        for raw in self.memory.of(texts):
            out = np.frombuffer(raw, np.int8)
            if len(out):
                out = out.copy()
                out[1] += out[0]  # the added space counts with the first code point
                out = out[1:]
            yield out


def tokens_at(steps: bytes, prefix: int) -> int:
    """Tokens of the first `prefix` code points."""
    return int(np.frombuffer(steps, np.int8)[:prefix].sum(dtype=np.int64))


def longest_within(steps: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix that has at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}


def prefix_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_steps: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, fit_chars, steps.

    fit_chars is the length in code points of the longest prefix with at most `limit` tokens; steps
    (null unless asked for) has one signed byte per code point.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model not in _counters:
            _counters[model] = PrefixCounter(load(model))
        counter = _counters[model]
        for batch in batches:
            totals, fits, kept = [], [], []
            texts = batch["text"].tolist()
            for text, steps in zip(texts, counter.steps(texts), strict=True):
                n = int(steps.sum(dtype=np.int64))
                totals.append(n)
                fits.append(len(text) if n <= limit and (steps >= 0).all() else longest_within(steps, limit))
                kept.append(steps.tobytes() if with_steps else None)
            batch["n_tokens"], batch["fit_chars"], batch["steps"] = totals, fits, kept
            yield batch[["doc_id", "no_id", "n_bytes", "n_tokens", "fit_chars", "steps"]]

    ready_workers(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    rows = slim.mapInPandas(count, "doc_id long, no_id boolean, n_bytes long, n_tokens long, fit_chars long, steps binary")
    return rows.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars", "steps")


def truncated(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text cut to its longest prefix within the limit; doc_id must be unique in both.

    Rows without an id, and those whose id `counts` lacks, keep their text.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    cut = rows.join(counts.select("doc_id", "fit_chars"), F.col(f"row.{id_col}") == F.col("doc_id"), "left")
    text = F.col("row").getField(text_col)
    short = F.substring(text, F.lit(1), F.coalesce("fit_chars", F.length(text)))
    return cut.select(*[(short if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
