"""Mixing sources to target weights by pivotal dependent rounding, in native expressions only.

A source's target over its size is the number of copies each of its documents should have; the whole
part is certain, the rest is a probability. Documents of a source meet in pairs. Words, not
probabilities, move between the two: one's probability falls by what the other's rises, times the
inverse of their sizes, until one of them is 0 or 1; the direction is drawn so that no expectation
changes. The one still open meets the next. So a source keeps its expected number of words exactly
until one document is left open, which is rounded to the nearer side: a source misses its target
by half of one document at most.

The pairing is a reduction tree: the documents of a source are dealt by hash into groups of about
`fan_in`, each group is folded to one open document, the open ones are grouped again, and so on. No
group is larger than a small multiple of `fan_in`, whatever the source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and takes nothing; fully repeated rows (equal id, source and text) are
counted together and their whole part of the extra copies is dealt out exactly; an empty table gives
an empty result. Only the id, text and source columns are read. Draws are hashes of the document and
the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seagrid.llm.common import WORD, materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
FAN_IN = 64
SEED = 7
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Rows (source, source_size, n_docs, target) from rows (source, source_size, n_docs), one per source.

    Weights repeat along the sources in code-point order, null last. A target stops at `limit` times
    the source's size and what is over goes to the others by weight: sorted by size over weight, the
    sources that stop come first, so the level of the rest follows from running sums. The windows run
    over one row per source.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * limit)
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.col("cap") / F.col("w"))).over(every)
    rows = rows.withColumn("first", first)
    at = F.max(F.when(F.col("open") & (F.col("cap") / F.col("w") == F.col("first")), F.col("level"))).over(every)
    rows = rows.withColumn("at", at)
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("w")))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def _fold(items: Column, seed: int, key_type: str) -> Column:
    """Pivotal rounding along an array of structs (key, p, s): struct (open, done), done with p of 0 or 1."""
    item = f"struct<key:{key_type},p:double,s:double>"
    none, done = F.lit(None).cast(item), F.array().cast(f"array<{item}>")

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        up = F.least((1 - a["p"]) * a["s"], b["p"] * b["s"])  # words that a may gain from b
        down = F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"])
        u = F.pmod(F.xxhash64(F.lit(seed), a["key"], b["key"]), F.lit(1 << 40)) / float(1 << 40)
        moved = F.when(u * (up + down) < down, up).otherwise(-down)
        a2 = F.struct(a["key"].alias("key"), (a["p"] + moved / a["s"]).alias("p"), a["s"].alias("s"))
        b2 = F.struct(b["key"].alias("key"), (b["p"] - moved / b["s"]).alias("p"), b["s"].alias("s"))

        def closed(x: Column) -> Column:
            return (x["p"] < _EPS) | (x["p"] > 1 - _EPS)

        pair = F.array(a2, b2)
        still = F.filter(pair, lambda x: ~closed(x))
        over = F.transform(F.filter(pair, closed), lambda x: F.struct(x["key"].alias("key"), F.round(x["p"]).alias("p"), x["s"].alias("s")))
        met = F.struct(F.get(still, F.lit(0)).alias("open"), F.concat(acc["done"], over).alias("done"))
        first = F.struct(b.alias("open"), acc["done"].alias("done"))
        return F.when(a.isNull(), first).otherwise(met)

    return F.aggregate(items, F.struct(none.alias("open"), done.alias("done")), step)


def pivotal_round(items: DataFrame, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """Rows (source, key, taken) with taken 0 or 1 from rows (source, key, p, s), 0 < p < 1, s > 0."""
    kind = items.schema["key"].dataType.simpleString()
    counts = items.groupBy("source").agg(F.count("*").alias("m"))
    most = counts.agg(F.max("m")).first()[0] or 0
    groups = F.greatest(F.ceil(F.col("m") / fan_in), F.lit(1)).cast("long")
    counts = counts.select(F.col("source").alias("of"), groups.alias("groups"))  # one row per source
    level = items.join(counts, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "key", "p", "s", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("groups")).alias("g"), "groups"
    )
    out = None
    while True:
        gathered = level.groupBy("source", "g", "groups").agg(F.sort_array(F.collect_list(F.struct("s", "key", "p"))).alias("items"))
        items_in = F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["p"].alias("p"), x["s"].alias("s")))
        folded = materialise(gathered.select("source", "g", "groups", _fold(items_in, seed, kind).alias("r")), "pivot")
        done = folded.select("source", F.explode("r.done").alias("x")).select("source", "x.key", F.col("x.p").cast("int").alias("taken"))
        out = done if out is None else out.unionByName(done)
        level = folded.where("r.open is not null").select("source", "r.open.key", "r.open.p", "r.open.s", "g", "groups")
        most = -(-most // fan_in)  # groups that were folded, for the largest source
        if most <= 1:
            last = level.select("source", "key", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("taken"))
            return out.unionByName(last)
        fewer = F.greatest(F.ceil(F.col("groups") / fan_in), F.lit(1)).cast("long")
        level = level.select("source", "key", "p", "s", F.pmod(F.col("g"), fewer).alias("g"), fewer.alias("groups"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, source, text_hash, m, size, source_size, target, whole, extra).

    One row for each distinct (doc_id, source, text), which stands for m equal rows: each has `whole`
    copies in the mix, and `extra` of the m have one more.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), word_count(text).alias("size"))
    rows = materialise(rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("m")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
    targets = materialise(source_targets(sizes, weights, share, limit), "targets")
    named = rows.join(targets.drop("n_docs").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = named.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + _EPS).cast("long"))
    part = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    named = named.withColumn("sure", F.floor(part * F.col("m") + _EPS).cast("long"))
    named = named.withColumn("p", F.greatest(part * F.col("m") - F.col("sure"), F.lit(0.0)))
    # Two hashes, so that rows of a source don't share a key.
    named = named.withColumn("key", F.struct(*[F.xxhash64(F.lit(seed + i), "doc_id", "text_hash", "size").alias(f"h{i}") for i in range(2)]))
    open_ = (F.col("size") > 0) & (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    taken = pivotal_round(named.where(open_).select("source", "key", "p", F.col("size").cast("double").alias("s")), fan_in, seed)
    taken = taken.select(F.col("key").alias("k"), F.col("source").alias("of"), "taken")
    got = named.join(taken, (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("of")), "left")
    extra = F.col("sure") + F.coalesce("taken", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    return got.select("doc_id", "source", "text_hash", "m", "size", "source_size", "target", "whole", extra.alias("extra"))


def taken_words(mixed: DataFrame) -> DataFrame:
    """One row per input row of mix(): doc_id, size, source_size, target, taken, source, copies."""
    each = mixed.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept; rows taken 0 times go."""
    key = ["no_id", "own", "no_source", "of", "hash"]

    def named(i: Column, source: Column, h: Column) -> list[Column]:
        parts = [i.isNull(), F.coalesce(i, F.lit(0)).cast("long"), source.isNull(), F.coalesce(source, F.lit("")), h]
        return [c.alias(k) for c, k in zip(parts, key, strict=True)]

    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    mixed = mixed.select(*named(F.col("doc_id"), F.col("source"), F.col("text_hash")), "whole", "extra")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *named(F.col(id_col), F.col(source_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    met = keyed.join(mixed, key)  # the window has the join's key, so whole rows are shuffled once
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    copies = F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    each = met.withColumn("nth", nth).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).where("copy > 0")
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
