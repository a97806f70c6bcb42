"""Packing, whitening and the Merkle manifest, each against a brute-force version on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seagrid.llm import merkle, packing, queries, token_files, whitening
from tests.llm.corpus import empty, frame
from tests.oracle import SF, assert_same, connect

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


# 11


def _best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def _placed(counts, capacity):
    """(sequence, offset, length) of every piece by the plan."""
    got = []
    for length, a, b, sequence, each, offset in packing.plan(counts, capacity):
        got += [(sequence + k // each, offset + k % each * length, length) for k in range(b - a)]
    return got


@pytest.mark.parametrize("seed", range(12))
def test_plan_fills_sequences_without_gaps_and_as_well_as_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 64, 200])
    shape = rng.choice(["any", "large", "small", "mid"])
    low, high = {"any": (1, capacity), "large": (capacity // 3 + 1, capacity), "small": (1, capacity // 4), "mid": (capacity // 4, capacity // 2 + 1)}[shape]
    lengths = [rng.randint(max(1, low), high) for _ in range(rng.choice([1, 40, 400]))] + [max(1, low)] * rng.choice([0, 150])
    got = _placed(Counter(lengths), capacity)
    assert Counter(n for *_, n in got) == Counter(lengths)
    by = defaultdict(list)
    for s, at, n in got:
        by[s].append((at, n))
    for held in by.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= capacity
        assert sum(3 * n > capacity for _, n in held) <= 2
    assert len(by) <= _best_fit_decreasing(lengths, capacity) + 1


def test_large_pieces_are_matched_as_often_as_they_can_be():
    got = _placed({60: 5, 55: 5, 45: 4, 40: 6}, 100)
    assert len({s for s, *_ in got}) == 10  # each of 40 beside a 60, each of 45 beside a 55, a pair of 40 and 55


def test_plan_of_a_hot_length_stays_small():
    counts = {n: 10**9 + n for n in range(1, 2049)} | {1: 10**13, 2048: 10**13}
    made = packing.plan(counts)
    assert len(made) < 60_000 and sum(b - a for _, a, b, *_ in made) == sum(counts.values())


def test_pieces_read_back_from_sequences(spark, docs, rows):
    got = packing.pack_and_read(docs, BYTES, capacity=256).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= 256
    assert len(by) <= _best_fit_decreasing([r["length"] for r in got], 256)
    assert packing.pack_and_read(empty(spark), BYTES).count() == 0


# 12


def _whitened(vectors):
    """By numpy: {vector: (n, deviation, projections)} and the eigenvalues' shares."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = {f: [n * a - s for a, s in zip(f, sums, strict=True)] for f in fit}
    centred = np.array([exact[f] for f in fit]) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    z = {f: np.array(exact[f]) / n @ axes / np.sqrt(np.abs(values)) for f in fit}
    return x, n, {f: sum(d * d for d in exact[f]) for f in fit}, z, values / values.sum()


VECTORS = "vec_id long, embedding array<float>, x int, z int, idx int, n int, component int"


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5))).astype("float32").tolist()
    base += [base[0]] * 40 + [base[1], [c + 1e-4 for c in base[2]]]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0, 0.0, 0.0]]
    table = [(i, v, 1, 1, 1, 1, 1) for i, v in enumerate(base)] + [(1000 + i, v, 2, 2, 2, 2, 2) for i, v in enumerate(odd)] + [(None, base[3], 0, 0, 0, 0, 0), (7, base[7], 1, 1, 1, 1, 1)]
    kept = [(k, v) for k, v, *_ in table if k is None or k < 1000]
    x, n, deviation, z, shares = _whitened([v for _, v in kept])
    got = whitening.whiten(spark.createDataFrame(table, VECTORS).repartition(3), 4, block_rows=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((k, c) for k, _ in kept for c in (1, 2, 3, 4))
    signs: dict = {}
    for (key, _), f in zip(kept, x, strict=True):
        for c in (1, 2, 3, 4):
            for r in by[key, c]:
                assert (r["n"], r["deviation"]) == (n, deviation[f]) and r["explained"] == pytest.approx(shares[c - 1], rel=1e-9) and r["identity_error"] < 1e-9
                sign = signs.setdefault(c, np.sign(z[f][c - 1] * r["whitened"]))
                assert r["whitened"] == pytest.approx(sign * z[f][c - 1], abs=1e-8)


def test_whitening_of_few_vectors(spark):
    def whiten(*vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, 0, 0, 0, 0, 0) for i, v in enumerate(vectors)], VECTORS)).collect()

    assert whiten() == [] and whiten([1.0, 2.0]) == [] and whiten([1.0, 2.0], [1.0, 2.0]) == []
    line = whiten([1.0, 2.0], [2.0, 4.0], [3.0, 6.0])  # one component has all the variance
    assert {r["component"] for r in line} == {1} and len(line) == 3 and line[0]["explained"] == pytest.approx(1.0)
    assert sorted(abs(r["whitened"]) for r in line) == pytest.approx([0.0, 1.5**0.5, 1.5**0.5])


# 13


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _climbed(digests):
    """The root of a list of digests, and of each the siblings (before, after) on its way."""
    ways, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, held = [], []
        for a in range(0, len(digests), 8):
            run = digests[a : a + 8]
            for j in range(len(run)):
                for i in under[a + j]:
                    ways[i].append((run[:j], run[j + 1 :]))
            above.append(_sha("".join(run)))
            held.append([i for u in under[a : a + 8] for i in u])
        digests, under = above, held
    return digests[0], ways


def _audited(rows):
    def leaf(r, text):
        return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r["text"] or "", r))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _climbed([leaf_ for _, _, leaf_, *_ in sorted(groups[g], key=lambda t: t[:4])]) for g in keys}
    root, upper = _climbed([trees[g][0] for g in keys])
    out = []
    for g, rest in zip(keys, upper, strict=True):
        for (*_, own, _, r), way in zip(sorted(groups[g], key=lambda t: t[:4]), trees[g][1], strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = text.translate({i: i + 32 for i in range(65, 91)})
            folded, siblings = leaf(r, text), ""
            for before, after in way + rest:
                folded = _sha("".join(before) + folded + "".join(after))
                siblings += "".join(before) + "".join(after)
            out.append((r["doc_id"], own, trees[g][0], root, _sha(siblings), folded, folded == root))
    return Counter(out)


def _audit(df):
    return Counter(map(tuple, merkle.audit(df, shown={"text": merkle.tampered_text()}).collect()))


def test_merkle(spark, docs, rows):
    capitals = [r | {"text": None if r["text"] is None else r["text"] + " Ä B"} for r in rows]
    got = _audit(docs.withColumn("text", F.concat("text", F.lit(" Ä B"))))
    assert got == _audited(capitals) and {r[-1] for r in got} == {True, False}


def test_merkle_of_few_rows_and_of_many_groups(spark):
    def some(n, lang):
        return [{"doc_id": i, "source": "s", "lang": lang(i), "n_chars": None, "text": f"Row {i} Ä"} for i in range(n)]

    for table in (some(1, lambda i: None), some(2, lambda i: "en"), some(9, lambda i: "en"), some(65, lambda i: "en"), some(200, lambda i: f"l{i % 73}"), some(3, lambda i: f"l{i}")):
        df = spark.createDataFrame([tuple(r.values()) for r in table], "doc_id long, source string, lang string, n_chars long, text string")
        assert _audit(df) == _audited(table)
    assert merkle.audit(empty(spark)).count() == 0


def test_merkle_same_as_sql(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert_same(queries.op13(spark, SF), queries.OP13_SQL, connect())
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# Hot keys


@pytest.mark.parametrize("hot", [None, 7])
def test_one_id_of_most_rows_is_split(spark, hot):
    """Rows without an id, or of one id, make several parts of the token files."""
    rows = [(hot, f"text {i % 500} of the hot id " * 3) for i in range(3000)] + [(i, f"other {i}") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    try:
        got = token_files.encode_and_read(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).cache()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r["part"]: r["count"] for r in got.where(f"doc_id <=> {'null' if hot is None else hot}").groupBy("part").count().collect()}
    assert len(parts) > 1 and max(parts.values()) < 0.6 * 3000
    starts = got.orderBy("start").collect()
    assert [r["start"] for r in starts] == [0, *np.cumsum([r["n_tokens"] for r in starts])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in starts]
    assert ids == sorted(ids)
