"""A Merkle tree over a dataset's rows, stored as parent-linked nodes and climbed by a recursive query.

Every row is a leaf: the SHA-256 of its fields. In each group (a language) the leaves ascend by id, and
runs of eight nodes become their parent until one node is left, the group's subroot. The subroots, in
the order of their groups, become the root in the same way. A stored node holds the digests of its
children, its parent and its place there, so whoever has a row and the nodes on its way can tell
whether the row is the one that the root vouches for.

At scale: texts are read once and never shuffled, only digests are. Places come from a range sort of
slim rows and one count a partition. A node's id is worked out from the place of its first leaf, so
links need no join. Each level is an eighth of the one below and a group gathers eight digests. The few
nodes near the top, which all leaves pass, are repeated for every `SPREAD` leaves below them, so that no key
of the climb's joins has more rows than that. A leaf's siblings are rows of their own until the end, so that
a level shuffles a leaf's digest and no more.

Defined cases: a null field is written as `-`; a null group is a group and comes first; null ids come
first in their group; rows of one id are ordered by their digest, and equal rows have equal digests, so
their order is of no effect; a lone leaf is its group's subroot, a lone subroot the root, and the proof
of a lone row is the digest of nothing; an empty table gives an empty result. Only the named columns
are read, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.llm.common import materialise, new_path

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # of monotonically_increasing_id, for the row in its partition
_LEVEL_BITS = 6
SPREAD = 4096
_FILE_NODES = 100_000
_UPPER = 32  # levels of the tree over the groups count from here
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def leaf_digest(fields: list[Column]) -> Column:
    """Of each field `-` if it is null, else its UTF-8 byte count, a colon and itself."""
    texts = [c.cast("string") for c in fields]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Where every character is one byte the library's own function does the same, and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def numbered(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """df with `no`, the place of each row in the order of the keys, from 0 without gaps."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, label)
    part = F.shiftright("at", _ROW_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a partition
    starts = F.broadcast(counts.select("part", before.alias("before")))
    return placed.withColumn("part", part).join(starts, "part").withColumn("no", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("at", "part", "before")


def _node(first: Column, level: int) -> Column:
    """The id of a node: the place of its first leaf, and its level."""
    return F.shiftleft(first, _LEVEL_BITS).bitwiseOR(F.lit(level).cast("long"))


def _levels(spark: SparkSession, nodes: DataFrame, path: str, base: int, n_rows: int, biggest: int, above: tuple[Column, Column]) -> DataFrame:
    """Write the levels of the trees over `nodes` (tree, start, size, first, lo, hi, digest) and return (tree, lo, hi, digest) of their tops.

    `start` and `size` are the place of a tree's first leaf and how many it has, lo and hi the first and the last row below a node;
    `above` are the parent and the place of a tree's top.
    """
    level, span = 0, 1
    tops = nodes.where("size = 1").select("tree", "lo", "hi", "digest")
    while span < biggest:
        level += 1
        wide = span * FAN
        nth = F.expr(f"(first - start) div {wide}")
        runs = nodes.where(F.col("size") > span).groupBy("tree", "start", "size", nth.alias("nth")).agg(F.array_sort(F.collect_list(F.struct("first", "digest"))).alias("kids"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        runs = runs.withColumn("first", F.col("start") + F.col("nth") * wide).withColumn("hex", F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), ""))
        inner = F.col("size") > wide
        parent = F.when(inner, _node(F.col("start") + F.expr(f"nth div {FAN}") * (wide * FAN), base + level + 1)).otherwise(above[0])
        place = F.when(inner, F.col("nth") % FAN).otherwise(above[1]).cast("int")
        stored = runs.select("tree", "start", "size", "first", "lo", "hi", _node(F.col("first"), base + level).alias("node"), parent.alias("parent"), place.alias("place"), F.unhex("hex").alias("kids"), F.unhex(sha(F.col("hex"))).alias("digest"))
        folder = f"{path}/level={base + level}"
        # Few files for the few nodes of the upper levels; a level has at most an eighth of the one below and one for each tree.
        stored.coalesce(max(1, -(-n_rows // (wide * _FILE_NODES)))).write.option("compression", "zstd").parquet(folder)
        nodes = spark.read.schema(stored.schema).parquet(folder)
        tops = tops.union(nodes.where((F.col("size") > span) & (F.col("size") <= wide)).select("tree", "lo", "hi", "digest"))
        span = wide
    return tops


@dataclass
class Manifest:
    """leaves (no, doc_id, leaf, shown, node, place, tree), nodes (node, parent, place, kids, ...), subroots (tree, digest); digests are binary but for the root."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", shown: dict[str, Column] | None = None) -> Manifest | None:
    """The manifest of docs; None if there are no rows. `shown` gives fields as a reader was shown them, whose leaves `climb` will test."""
    spark, shown = docs.sparkSession, shown or {}
    leaf = leaf_digest([F.col(c) for c in fields])
    seen = leaf_digest([shown.get(c, F.col(c)) for c in fields])
    changed = F.lit(False)
    for c, other in shown.items():
        changed = changed | ~other.eqNullSafe(F.col(c))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(group).alias("grp"), F.unhex(leaf).alias("leaf"), F.when(changed, F.unhex(seen)).alias("other"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    rows = numbered(materialise(slim, "leaves"), order, "sorted")
    groups = rows.groupBy("grp").agg(F.min("no").alias("start"), F.count("*").alias("size"))
    trees = materialise(numbered(groups, [F.asc("start")], "groups").withColumnRenamed("no", "tree").withColumnRenamed("grp", "g"), "trees")
    n_trees, n_rows, biggest = trees.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    if not n_trees:
        return None
    top_node = _node(F.expr(f"tree div {FAN}") * FAN, _UPPER + 1) if n_trees > 1 else F.lit(None).cast("long")
    above = (top_node, F.col("tree") % FAN)
    # Without a hint: a table of many groups is shuffled, and hot groups are then split.
    met = rows.join(trees, rows.grp.eqNullSafe(trees.g))
    within = F.col("no") - F.col("start")
    alone = F.col("size") == 1
    node = F.when(alone, above[0]).otherwise(_node(F.col("start") + F.floor(within / FAN) * FAN, 1))
    place = F.when(alone, above[1]).otherwise(within % FAN).cast("int")
    leaves = materialise(met.select("no", "doc_id", "leaf", F.coalesce("other", "leaf").alias("shown"), "tree", "start", "size", node.alias("node"), place.alias("place")), "placed")
    path = new_path(spark, "nodes")
    lowest = leaves.select("tree", "start", "size", *[F.col("no").alias(c) for c in ("first", "lo", "hi")], F.col("leaf").alias("digest"))
    subroots = materialise(_levels(spark, lowest, path, 0, n_rows, biggest, above), "subroots")
    nothing = (F.lit(None).cast("long"), F.lit(None).cast("int"))
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("start"), F.lit(n_trees).cast("long").alias("size"), F.col("tree").alias("first"), "lo", "hi", "digest")
    root = _levels(spark, upper, path, _UPPER, n_trees, n_trees, nothing).select(_hex(F.col("digest"))).first()[0]
    stored = "tree long, start long, size long, first long, lo long, hi long, node long, parent long, place int, kids binary, digest binary"
    nodes = spark.read.schema(stored).parquet(path) if max(biggest, n_trees) > 1 else spark.createDataFrame([], stored)
    return Manifest(leaves, nodes, subroots, root)


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (no, folded, proof_sha256): the digest that each leaf's `shown` leads to at the root, and the digest of its siblings on the way.

    The recursive query has a row for each leaf and level. It runs here, into a table, as its bound on rows is a setting of the session.
    """
    spark = leaves.sparkSession
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        steps = spark.sql(
            """
            WITH RECURSIVE climb(no, level, node, place, folded, siblings) AS (
              SELECT no, 0, node, place, shown, X'' FROM {leaves}
              UNION ALL
              SELECT c.no, c.level + 1, n.parent, n.place,
                     unhex(sha2(CAST(lower(hex(concat(substring(n.kids, 1, 32 * c.place), c.folded, substring(n.kids, 32 * c.place + 33)))) AS BINARY), 256)),
                     concat(substring(n.kids, 1, 32 * c.place), substring(n.kids, 32 * c.place + 33))
              FROM climb c JOIN {nodes} n ON c.node = n.node AND c.no div {spread} = n.part)
            SELECT no, level, folded, siblings FROM climb
            """,
            leaves=leaves.select("no", "node", "place", "shown"),
            nodes=nodes.select("node", "parent", "place", "kids", F.explode(F.sequence(F.expr(f"lo div {SPREAD}"), F.expr(f"hi div {SPREAD}"))).alias("part")),
            spread=SPREAD,
        )
        way = F.array_sort(F.collect_list(F.struct("level", "siblings")))  # a row for each level
        folded = steps.groupBy("no").agg(F.max_by("folded", "level").alias("folded"), way.alias("way"))
        proof = sha(F.array_join(F.transform("way", lambda s: _hex(s["siblings"])), ""))
        return materialise(folded.select("no", _hex(F.col("folded")).alias("folded"), proof.alias("proof_sha256")), "climbed")
    finally:
        spark.conf.set(key, before)


def audit(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", shown: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, and folded_root and verified of what was shown."""
    made = build(docs, fields, group, id_col, shown)
    if made is None:
        return docs.sparkSession.createDataFrame([], _RESULT)
    subroots = made.subroots.select("tree", _hex(F.col("digest")).alias("subroot"))
    rows = made.leaves.select("no", "doc_id", _hex(F.col("leaf")).alias("leaf"), "tree").join(climb(made.leaves, made.nodes), "no").join(subroots, "tree")
    return rows.select("doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == made.root).alias("verified"))


def tampered_text(every: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with A-Z in lower case where `every` divides the CRC-32 of the decimal id; a null id leaves it alone."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(hit, lower_ascii(F.col(text_col))).otherwise(F.col(text_col))
