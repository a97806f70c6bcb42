"""PCA whitening of embeddings with MLlib's BlockMatrix.

Vectors become integers, x = floor(64 c) + 1000000, so counts, sums and deviations are exact. The fit
list is each distinct vector once. Its centred rows, indexed without gaps, become a BlockMatrix; the
transpose times itself is the scatter, whose parts are added up in the tasks that hold the blocks.
The driver takes the eigenvectors of that one matrix of dims x dims, and a second multiplication, by
the whitening matrix, projects the rows. Each row of the table then takes the projection of its vector.

At scale: blocks are `block_rows` x dims and stay distributed. The driver sees the positions of blocks,
one matrix of dims x dims and one of components x components, and no vectors. Copies meet in partial
aggregation; the join that gives copies their projection is an ordinary one on two 64-bit hashes of the
vector, which Spark splits where a vector is hot.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries or some too large
for 64 bits, are left out, and so are rows whose number of entries is not the commonest one (of ties,
the greatest); null and repeated vec_ids are rows like any other; components without variance (as many
as the fit list leaves without, all for a single vector) have no rows; `deviation` is null where it
needs more than 38 digits; an empty table gives an empty result. Only the named columns are read, so
other columns never clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seagrid.llm.common import materialise, ready_workers

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 8192
BLOCK_COLUMNS = 1024
_PART_BLOCKS = 8
_ROW_BITS = 33  # of monotonically_increasing_id, for the row in its partition
_LIMIT = 2.0**62
_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, x) of the vectors that can be used."""
    c = F.transform(vector_col, lambda v: v.cast("double") * SCALE)
    fine = F.forall("c", lambda v: F.coalesce(F.abs(v) < _LIMIT, F.lit(False)))  # also false for NaN, which is above all numbers
    rows = vectors.select(F.col(id_col).alias("vec_id"), c.alias("c")).where((F.size("c") > 0) & fine)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v) + SHIFT).alias("x"))


def indexed(rows: DataFrame, label: str) -> DataFrame:
    """rows with `idx` from 0 without gaps, by their place in the stored table: no sort and no shuffle of the rows."""
    kept = materialise(rows.withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", _ROW_BITS)
    counts = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a partition
    starts = F.broadcast(counts.select("part", before.alias("before")))
    return kept.withColumn("part", part).join(starts, "part").withColumn("idx", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("at", "part", "before")


def _key() -> list[Column]:
    return [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")]


def _doubles(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("double"))


def block_matrix(rows: DataFrame, vector: Column, n: int, dims: int, block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """The matrix of n rows whose column `idx` gives the place; vectors become MLlib's in the JVM."""
    table = MLUtils.convertVectorColumnsFromML(rows.select("idx", array_to_vector(vector).alias("v")), "v")
    return IndexedRowMatrix(table, n, dims).toBlockMatrix(block_rows, min(dims, BLOCK_COLUMNS))


def gram(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. The rows' blocks are dealt to parts of a few each, so that no task holds them all.

    Only the JVM's `multiply` takes the number of parts; without it all blocks would meet in the task of the one block of the product.
    """
    parts = max(1, -(-matrix.numRows() // (matrix.rowsPerBlock * _PART_BLOCKS)))
    flat = matrix.transpose()
    product = flat._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, flat.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _rows_of(matrix: BlockMatrix) -> DataFrame:
    return matrix.toIndexedRowMatrix().rows.map(lambda r: (r.index, r.vector.toArray().tolist())).toDF("idx long, z array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ready_workers(spark)
    rows = materialise(integers(vectors, id_col, vector_col), "integers")
    usual = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return spark.createDataFrame([], _RESULT)
    dims = usual["dims"]
    rows = rows.where(F.size("x") == dims)
    fit = indexed(rows.select("x").distinct(), "fit")
    # Sums of integers, worked out where the rows are; one row of dims numbers.
    n, *sums = fit.agg(F.count("*"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(dims)]).first()
    total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    exact = F.zip_with("x", total, lambda v, s: F.lit(n).cast("decimal(19,0)") * v.cast("decimal(19,0)") - s)  # n x - S
    fit = fit.withColumn("exact", exact).withColumn("centred", F.transform("exact", lambda v: v.cast("double") / n))
    squares = F.aggregate("exact", F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v, v).cast("decimal(38,0)")).cast("decimal(38,0)"))
    fit = materialise(fit.select("idx", *_key(), squares.alias("deviation"), "centred"), "centred")

    centred = block_matrix(fit, F.col("centred"), n, dims, block_rows)
    covariance = gram(centred) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[: min(components, dims)] > max(values[0], 0.0) * dims * np.finfo(float).eps).sum())
    if not kept:
        return spark.createDataFrame([], _RESULT)
    axes = axes[:, :kept] / np.sqrt(values[:kept])
    explained = values[:kept] / np.trace(covariance)
    step = min(dims, BLOCK_COLUMNS)
    blocks = [((i // step, 0), DenseMatrix(len(b := axes[i : i + step]), kept, b.ravel(order="F").tolist())) for i in range(0, dims, step)]
    whitener = BlockMatrix(spark.sparkContext.parallelize(blocks, 1), step, kept, dims, kept)
    projected = materialise(_rows_of(centred.multiply(whitener)), "projected")

    # The error is measured on the projected rows themselves, centred again before they are multiplied.
    means = projected.agg(*[F.avg(F.get("z", F.lit(i))) for i in range(kept)]).first()
    level = F.array(*[F.lit(float(m)) for m in means])
    spread = gram(block_matrix(projected, F.zip_with("z", level, lambda v, m: v - m), n, kept, block_rows)) / n
    error = float(np.abs(spread - np.eye(kept)).max())

    known = fit.select("idx", "h1", "h2", "deviation").join(projected, "idx").drop("idx")
    met = rows.select("vec_id", *_key()).join(known, ["h1", "h2"])
    shares = F.array(*[F.lit(float(e)) for e in explained])
    each = met.select("vec_id", "deviation", F.posexplode(F.arrays_zip("z", shares.alias("e"))).alias("k", "of"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("of.z").alias("whitened"), F.col("of.e").alias("explained"), F.lit(error).alias("identity_error"))
