"""Each stage of the pipeline against a brute-force version, on what the stage before kept."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from seagrid.llm import isolation
from tests.llm.corpus import SCHEMA, empty, frame
from tests.llm.test_operators import WORD, _components, _plain, _print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{i}")
        last, docs = docs.columns, spark.read.parquet(f"{at}/{i}")
        assert docs.columns == last or i == len(corpus_pipeline.STAGES) - 1
        out.append(docs.collect())
    return out


def test_order():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, steps):
    before, after = steps[0], steps[1]
    verdicts = isolation.quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in after} == {r.doc_id for r in verdicts if r.kept}
    for r in before:
        words = WORD.findall(r.text)
        assert len(words) >= 50 or r not in after
    assert len(after) > 0.7 * sum(not v.base_failed for v in verdicts)


def test_exact(steps):
    groups = defaultdict(list)
    for r in steps[1]:
        groups[_plain(r.text)].append(r)
    assert Counter(steps[2]) == Counter(min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values())


def test_near(steps):
    prints = {r.doc_id: _print(r.text) for r in steps[2]}
    ids = sorted(prints)
    comp = _components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert sorted(r.doc_id for r in steps[3]) == sorted(set(comp.values()))


def test_mixture(steps):
    size, most, taken = Counter(), Counter(), Counter()
    for r in steps[3]:
        n = len(re.findall(WORD, r.text))
        size[r.source] += n
        most[r.source] = max(most[r.source], n)
    for r in steps[4]:
        taken[r.source] += len(re.findall(WORD, r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= sum(most.values()) / 2
    assert all(taken[s] <= 2 * size[s] for s in size)
    assert set(r.doc_id for r in steps[4]) <= set(r.doc_id for r in steps[3])
    assert max(Counter(r.doc_id for r in steps[4]).values()) <= 2


def test_encoded(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in steps[5]) == Counter((r.doc_id, tuple(library.encode(r.text))) for r in steps[4])


def test_run_gives_the_same(spark, steps):
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in steps[5])


def _folder(at, docs, labels):
    docs.coalesce(2).write.parquet(f"{at}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null ids, texts, sources and other columns, empty and very long texts, repeated rows, copies that differ in white space."""
    rows = frame(spark).collect()
    words = [f"w{i}" for i in range(30_000)]
    long = (900, " ".join(words), None, None, None, -1, "fp", 99, "d")
    again = (None, " ".join(words[:80]), "en", "src1", None, 0, "", 0, "")
    copy = (901, "  ".join(words[:80]), None, "src1", 1, 0, "", 0, "")
    docs = spark.createDataFrame([tuple(r) for r in rows] + [long, long, again, again, copy], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    sf = _folder(tmp_path / "in", docs, labels)
    out, now = [docs.collect()], spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{i}")
        last, now = now.columns, spark.read.parquet(f"{tmp_path}/{i}")
        assert now.columns == last or i == 4
        out.append(now.collect())
    text = lambda r: r["text"] or ""
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)

    verdicts = Counter((r["doc_id"], r["n_words"], r["word_chars"]) for r in isolation.quality_verdicts(docs, labels).where("kept").collect())
    key = lambda r: (r["doc_id"], len(WORD.findall(text(r))), sum(map(len, WORD.findall(text(r)))))
    assert Counter(map(key, out[1])) == verdicts and {900, 901, None} <= {r["doc_id"] for r in out[1]}

    groups = defaultdict(list)
    for r in out[1]:
        groups[_plain(r["text"])].append(r)
    assert Counter(out[2]) == Counter(min(g, key=lambda r: (-len(text(r)), *order(r))) for g in groups.values())

    prints = [_print(r["text"]) for r in out[2]]
    comp = _components(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    kept = {}
    for i, r in enumerate(out[2]):
        kept[comp[i]] = min(kept.get(comp[i], r), r, key=order)
    assert Counter(r["doc_id"] for r in out[3]) == Counter(r["doc_id"] for r in kept.values())

    copies, size = Counter(out[4]), lambda r: len(WORD.findall(text(r)))
    assert set(copies) <= set(out[3]) and max(copies.values()) <= 2
    total = sum(map(size, out[3]))
    assert abs(sum(map(size, out[4])) - 1.5 * total) <= sum(max(size(r) for r in out[3] if r["source"] == s) for s in {r["source"] for r in out[3]})

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out[5]) == Counter((r["doc_id"], tuple(library.encode(text(r)))) for r in out[4])


def test_an_empty_table_runs_through(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, _folder(tmp_path / "none", empty(spark), labels)).count() == 0
