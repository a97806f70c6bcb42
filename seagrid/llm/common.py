"""What several corpus operators share: reading, durable intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import seagrid

#: The white space that separates words in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None
_shipped: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only in local mode, where the session names none."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="seagrid-")
    return _own_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/seagrid-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables of `materialise` that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        jvm, conf = session._jvm, session._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/seagrid-" in folder:
                at = jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(conf).delete(at, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of the edges; component is the smallest node reachable.

    Alternates large-star and small-star steps until no edge changes. Every step is made of
    grouped minima and equi-joins: a node's neighbours are never gathered into a row, and the join
    on a node with very many edges is one that Spark splits. Self-loops are ignored except that they name a node; null ends are dropped; an empty
    input gives an empty result.
    """
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = materialise(
        start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    now = now.where("u <> v")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.where("u <> v"), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = materialise(small, "small")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("m")), nodes.node == F.col("u"), "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )


def ready_workers(spark: SparkSession, rows: int = 512) -> None:
    """Prepare for functions that run in Python workers.

    The package goes to the workers, once for a Spark context, as they may not have it on their path.
    Rows with whole texts go over in small batches, so that long texts don't add up in a worker's memory.
    """
    global _shipped
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    context = spark.sparkContext
    if _shipped != context.applicationId:
        package = Path(seagrid.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="seagrid-")) / "seagrid.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped = context.applicationId
