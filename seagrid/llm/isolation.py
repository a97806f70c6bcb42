"""Quality rules with an isolation forest on the statistics of the rules.

Each document has a few counts (words, symbols, repeated lines, repeated 3-word windows and their
like). An isolation forest (Liu, Ting, Zhou 2008) splits the space of their ratios at random; a
document that few splits set apart is anomalous. The forest and the threshold come from labelled
rows, a documented sample of at most `sample` of them, those of the smallest hash of their id: the
threshold is the score that best tells quality 0 from 1, among those that reject at most `false_share`
of the good ones. The forest is small (trees x 2 * samples per tree numbers) and goes to the tasks
with the function; every document is scored.

Defined cases: a null text has no words; without labelled rows of both kinds the base rules decide
alone; repeated rows get equal verdicts; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm.common import SPACES, ready_workers

TREES = 128
PER_TREE = 256
SAMPLE = 8192
FALSE_SHARE = 0.002
SEED = 11
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lone long"
#: What the base rules judge by themselves, repeats, is left out: it is spread wide among good documents.
FEATURES = ("symbol_share", "upper_share", "mark_share", "word_length", "lone_share")


def counts_of(text: str) -> tuple[int, ...]:
    """The base counts of the contract, then upper-case letters, exclamation marks, and words of one character."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return n, chars, symbols, len(lines) - len(set(lines)), _in_repeats(words), upper, text.count("!"), sum(len(w) == 1 for w in words)


def _in_repeats(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def features(c: pd.DataFrame) -> np.ndarray:
    chars, words = np.maximum(c["word_chars"], 1), np.maximum(c["n_words"], 1)
    return np.stack([c["n_symbols"] / chars, c["n_upper"] / chars, c["n_marks"] / words, np.minimum(c["word_chars"] / words, 50), c["n_lone"] / words], axis=1).astype(np.float64)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), split, left child (the right one follows), depth at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.per_tree = min(per_tree, len(x))
        limit = int(np.ceil(np.log2(max(self.per_tree, 2)))) + 4
        self.trees = [self._grow(x[rng.choice(len(x), self.per_tree, replace=False)], limit, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, split, child, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            node, own, level = todo.pop()
            wide = np.flatnonzero(own.max(0) > own.min(0)) if len(own) else []
            if level >= limit or len(own) <= 1 or not len(wide):
                depth[node] = level + float(_average_path(len(own)))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(own[:, f].min(), own[:, f].max())
            feature[node], split[node], child[node] = f, cut, len(feature)
            for part in (own[own[:, f] < cut], own[own[:, f] >= cut]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1)
                split.append(0.0)
                child.append(0)
                depth.append(0.0)
        return np.array(feature), np.array(split), np.array(child), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for anomalies, about 0.5 for the rest."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, depth in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, child[node] + right, node)
            total += depth[node]
        return 2 ** (-total / len(self.trees) / max(float(_average_path(self.per_tree)), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, false_share: float = FALSE_SHARE) -> float:
    """The score from which documents are rejected: the most bad ones for at most `false_share` of the good ones."""
    if not good.any() or good.all():
        return float("inf")
    ranked = np.sort(scores[good])[::-1]
    most = int(false_share * len(ranked))
    least = np.nextafter(ranked[most], np.inf)
    above = np.sort(scores[~good & (scores >= least)])
    if not len(above):
        return float("inf")
    # Half way down the gap between the allowed good scores and the bad ones, so that the cut is not on a sample's own score.
    return float((least + above[0]) / 2)


class QualityModel:
    def __init__(self, counts: pd.DataFrame, quality: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, false_share: float = FALSE_SHARE, seed: int = SEED):
        x = features(counts)
        good = quality == 1
        self.forest = IsolationForest(x, trees, per_tree, seed) if len(x) else None
        passed = ~base_failed(counts) if len(x) else np.zeros(0, bool)
        self.limit = threshold(self.forest.score(x[passed]), good[passed], false_share) if passed.any() else float("inf")

    def score(self, counts: pd.DataFrame) -> np.ndarray:
        return self.forest.score(features(counts)) if self.forest else np.zeros(len(counts))


def base_failed(c: pd.DataFrame) -> np.ndarray:
    return ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).to_numpy()


def _counts(texts: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return pd.DataFrame([counts_of(t) for t in texts], columns=names, dtype="int64")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **options) -> QualityModel:
    """Fit on at most `sample` labelled ids, those of the least hash. labels: rows (doc_id, quality).

    Of documents that share an id the one of the least counts is taken, so that a rerun fits the same model.
    """
    ready_workers(docs.sparkSession)
    counts = F.pandas_udf(_counts, COUNTS)
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "quality").limit(sample)
    met = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    got = met.select("__id", "quality", counts("text").alias("c")).groupBy("__id", "quality").agg(F.min("c").alias("c")).select("__id", "quality", "c.*").toPandas()
    got = got.sort_values(["__id", "n_words", "word_chars", "quality"], ignore_index=True)
    return QualityModel(got, got["quality"].to_numpy(), **options)


def judged(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """Rows (row, q): each document whole, and its counts, base_failed, score, kept."""

    @F.pandas_udf(COUNTS + ", base_failed boolean, score double, kept boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        c = _counts(texts)
        score, failed = model.score(c), base_failed(c)
        return c.assign(base_failed=failed, score=score, kept=~failed & (score < model.limit))

    ready_workers(docs.sparkSession)
    return docs.select(F.struct(*docs.columns).alias("row"), judge(F.coalesce(F.col(text_col), F.lit(""))).alias("q"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, score, kept."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    return judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).select("row.doc_id", "q.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that are rejected, all columns kept; nothing is shuffled."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    kept = judged(docs, model, text_col).where("q.kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
