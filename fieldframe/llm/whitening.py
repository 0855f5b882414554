"""Whitening of vectors with distributed block matrices.

Valid vectors become rows of integers, centred exactly: with n rows and sums S a row x is held as n*x - S. Each
input partition packs its rows into dense blocks, the last one filled up with rows of zeros, and numbers them; no shuffle is
needed for that, and the written blocks keep the numbers fixed when tasks are repeated. Blocks are worked on in groups of
bounded number, since planning a product of block matrices lists their indices on the driver. For each group

* the blocks stacked on each other, transposed and multiplied with themselves, give the scatter; the long middle dimension
  is split, so that a task multiplies a bounded number of blocks and only sums of (dimension x dimension) travel on;
* after the eigenvectors of the whole scatter were found on the driver, the blocks laid out as a square of blocks are
  multiplied with the whitening matrix repeated along a block diagonal, which spreads the products over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldframe.llm.common import shared_folder, staged

#: A block has about this many bytes, a task multiplies blocks of about so many; columns of a block; blocks of a group.
BLOCK_BYTES, TASK_BYTES, BLOCK_COLUMNS, GROUP_BLOCKS = 1 << 22, 1 << 26, 512, 1 << 16
#: Entries become integers as floor(1024 * c) + 100000.
SCALE, SHIFT = 1024.0, 100_000
_INDEX = T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])
_MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                     ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors with no null or non-finite entry, as integers; null and empty vectors are left out."""
    entries = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entries, lambda c: F.floor(c * SCALE) + SHIFT)
    # kept inside a branch, as an optimizer may test x before other filters
    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.when((F.size(entries) > 0) & finite, whole).alias("x")).filter("x IS NOT NULL")


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum in each dimension; rows of several lengths raise."""
    found = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count("x").alias("n"), F.sum("x").alias("s")).orderBy("at").collect()
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors have different lengths")
    return (found[0]["n"] if found else 0), [r["s"] for r in found]


def _deviations(centred: np.ndarray, x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exact: in 64 bits where they suffice, else in integers of any size."""
    if float(np.abs(centred.astype(np.float64)).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
        return pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0))


def _packer(n: int, sums: list[int], height: int, width: int, partitions: int):
    """Blocks of ``height`` rows and ``width`` columns from the rows of each partition."""
    s = np.array(sums, np.int64)
    columns = -(-len(sums) // width)

    def blocks(part: int, sequence: int, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        centred = n * x - s
        full = np.zeros((height, columns * width))
        full[:len(x), :len(sums)] = centred
        number = sequence * partitions + part
        matrices = [{"type": 1, "numRows": height, "numCols": width, "colPtrs": None, "rowIndices": None, "isTransposed": True,
                     "values": np.ascontiguousarray(full[:, j * width:(j + 1) * width]).ravel()} for j in range(columns)]
        nothing = [None] * (columns - 1)
        listed = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids)
        deviations = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), _deviations(centred, x, n, s))
        return pa.RecordBatch.from_arrays(
            [pa.array([number // GROUP_BLOCKS] * columns, pa.int32()),
             pa.array([number % GROUP_BLOCKS] * columns, pa.int64()), pa.array(range(columns), pa.int64()), pa.array(matrices, _MATRIX),
             pa.concat_arrays([listed, pa.array(nothing, listed.type)]), pa.concat_arrays([deviations, pa.array(nothing, deviations.type)])],
            names=["group", "row", "column", "matrix", "ids", "deviations"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, sequence, part = [], 0, 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = batch.column("part")[0].as_py()
            waiting.append(batch)
            held += batch.num_rows
            while held >= height:
                table = pa.Table.from_batches(waiting).combine_chunks()
                head, rest = table.slice(0, height), table.slice(height)
                yield blocks(part, sequence, *_arrays(head, len(sums)))
                sequence, held = sequence + 1, held - height
                waiting = rest.to_batches()
        if held:
            yield blocks(part, sequence, *_arrays(pa.Table.from_batches(waiting).combine_chunks(), len(sums)))
    return run


def _arrays(table: pa.Table, size: int) -> tuple[pa.Array, np.ndarray]:
    flat = pa.concat_arrays([c.flatten() for c in table.column("x").chunks])
    ids = table.column("id").combine_chunks()
    return (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids), flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def _block_matrix(blocks: DataFrame, row: Column, column: Column, height: int, width: int, rows: int, columns: int) -> BlockMatrix:
    indexed = blocks.select(F.struct(row.cast("long").alias("_1"), column.cast("long").alias("_2")).alias("index"), "matrix")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", indexed, height, width, rows, columns), height, width)


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with its middle dimension dealt to ``splits`` tasks for each part of the result."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(blocks: DataFrame, height: int, width: int, columns: int, rows: int, size: int) -> np.ndarray:
    tall = _block_matrix(blocks, F.col("row"), F.col("column"), height, width, rows * height, columns * width)
    splits = max(1, rows * height * width * 8 // TASK_BYTES)
    return _multiply(tall.transpose(), tall, splits).toLocalMatrix().toArray()[:size, :size]


def _project(blocks: DataFrame, directions: np.ndarray, height: int, width: int, columns: int, rows: int) -> DataFrame:
    """(row, matrix) of the blocks times ``directions``."""
    side, kept = math.isqrt(rows - 1) + 1, directions.shape[1]
    padded = np.zeros((columns * width, kept))
    padded[:len(directions)] = directions
    square = _block_matrix(blocks, F.floor(F.col("row") / side), F.col("row") % side * columns + F.col("column"), height, width,
                           side * height, side * columns * width)
    diagonal = [((b * columns + j, b), DenseMatrix(width, kept, padded[j * width:(j + 1) * width].ravel("F").tolist()))
                for b in range(side) for j in range(columns)]
    weights = BlockMatrix(blocks.sparkSession.sparkContext.parallelize(diagonal), width, kept, side * columns * width, side * kept)
    found = callMLlibFunc("getMatrixBlocks", _multiply(square, weights, 1)._java_matrix_wrapper._java_model)
    return found.toDF("index", "product").select((F.col("index._1") * side + F.col("index._2")).cast("long").alias("row"), "product")


def _plain(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table and read it with its matrices as plain structs."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    kind = MatrixUDT.sqlType()
    schema = T.StructType([T.StructField(f.name, kind if isinstance(f.dataType, MatrixUDT) else f.dataType) for f in df.schema])
    return df.sparkSession.read.schema(schema).parquet(path)


def _component(matrix: str, k: int, kept: int) -> Column:
    """Column k of a dense matrix as an array over its rows."""
    values, rows = F.col(f"{matrix}.values"), F.col(f"{matrix}.numRows")
    across = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.element_at(values, i * kept + k + 1))
    return F.when(F.col(f"{matrix}.isTransposed"), across).otherwise(F.slice(values, rows * k + 1, rows))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per valid vector and component: id, component, n, deviation (decimal(38, 0)), whitened, explained, identity_error.

    Vectors that are null, empty, or hold a null or non-finite entry give no rows and do not count; vectors of
    different lengths raise ValueError, integers beyond 64 bits an overflow error. There are as many components as dimensions at
    most. Repeated rows and null ids stay rows of their own, further columns are ignored, an empty table gives no rows.
    A component without variance (one row, equal rows, dependent dimensions) has whitened 0 and explained 0 and stays out of
    ``identity_error``, which is 0 if no component varies. The driver receives sums of one row a dimension and the scatter.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType
    n, sums = _sums(rows)
    if not n:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind)])).selectExpr(
            f"`{id_col}`", "0 AS component", "0L AS n", "CAST(0 AS DECIMAL(38, 0)) AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    size, partitions = len(sums), rows.rdd.getNumPartitions()
    columns = -(-size // BLOCK_COLUMNS)
    width = -(-size // columns)
    height = max(1, min(BLOCK_BYTES // (8 * columns * width), -(-n // partitions)))
    schema = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("column", T.LongType()),
                           T.StructField("matrix", MatrixUDT()), T.StructField("ids", T.ArrayType(kind)),
                           T.StructField("deviations", T.ArrayType(T.DecimalType(38, 0)))])
    packed = rows.select("id", "x", F.spark_partition_id().alias("part")).mapInArrow(_packer(n, sums, height, width, partitions), schema)
    blocks = staged(packed, "whitening-blocks")
    groups = {r["group"]: r["rows"] for r in blocks.groupBy("group").agg((F.max("row") + 1).alias("rows")).orderBy("group").collect()}

    shape = {"height": height, "width": width, "columns": columns}
    scatter = sum(_scatter(blocks.filter(F.col("group") == g), rows=r, size=size, **shape) for g, r in groups.items())
    covariance = (scatter + scatter.T) / 2 / n / n / n
    values, axes = np.linalg.eigh(covariance)
    kept = min(components, size)
    values, axes = values[::-1][:kept], axes[:, ::-1][:, :kept]
    varies = values > max(np.trace(covariance), 0.0) * size * np.finfo(float).eps
    directions = np.where(varies, axes / (n * np.sqrt(np.where(varies, values, 1.0))), 0.0)
    explained = np.where(varies, values / (np.trace(covariance) or 1.0), 0.0)

    result = None
    for g, r in groups.items():
        of = blocks.filter(F.col("group") == g)
        found = _plain(_project(of, directions, rows=r, **shape), "whitening-products")
        listed = of.filter(F.col("column") == 0).select("row", "ids", "deviations").join(found, "row")
        one = listed.select(F.explode(F.arrays_zip(
            "ids", "deviations", *[F.slice(_component("product", k, kept), 1, F.size("ids")).alias(f"w{k}") for k in range(kept)])).alias("r")).select("r.*")
        result = one if result is None else result.unionAll(one)
    result = staged(result, "whitened")
    alive = [k for k in range(kept) if varies[k]]
    pairs = [(a, b) for i, a in enumerate(alive) for b in alive[i:]]
    error = 0.0
    if pairs:
        covered = result.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
        error = max(abs(covered[i] - (a == b)) for i, (a, b) in enumerate(pairs))
    each = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(float(explained[k])).alias("explained")) for k in range(kept)])
    return (result.select(F.col("ids").alias(id_col), "deviations", F.explode(each).alias("c"))
            .select(F.col(f"`{id_col}`"), "c.component", F.lit(n).cast("long").alias("n"), F.col("deviations").alias("deviation"),
                    "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error")))
