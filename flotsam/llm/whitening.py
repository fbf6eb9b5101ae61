"""Whitening of embeddings by a covariance over distinct vectors with weights.

Vectors become whole numbers, equal ones are grouped, and the fit works on each distinct vector once with its count (or one)
as weight: exact sums, then a centred matrix product a partition, whose partial sums Spark adds up.  The driver sees numbers
of the order of dimensions squared.  Every distinct vector is projected once; rows look up their vector's projection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join

#: Rows of one matrix product.
BLOCK = 8192


def whole_vector(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * entry) + shift of every entry, as double before the floor."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift)


def is_finite(vector: Column) -> Column:
    """True where a vector has entries and none of them is null, NaN or infinite; never null."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """The vectors of each block as a matrix of long, their weights, and the block's rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            x = some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
            yield x, some.column("weight").to_numpy(), some


def _added(distinct: DataFrame, part, cells: str, value: str) -> list:
    """The rows (cell, sum) of what ``part`` gives for the blocks of each partition, added up over partitions."""
    columns = [c.split()[0] for c in cells.split(",")]
    rows = distinct.select("x", "weight").mapInArrow(part, f"{cells}, v {'string' if value == 'decimal(38,0)' else value}")
    return rows.groupBy(*columns).agg(F.sum(F.col("v").cast(value)).alias("v")).collect()


def _sums(distinct: DataFrame, d: int) -> list[int]:
    """The weighted sum of each dimension, exact."""

    def part(batches):
        total = np.zeros(d, object)
        for x, w, _ in _blocks(batches):
            small = int(np.abs(x).max()) * int(w.sum()) < 1 << 62
            total += (w @ x if small else w.astype(object) @ x.astype(object)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(v) for v in total])], names=["i", "v"])

    found = {r["i"]: int(r["v"]) for r in _added(distinct, part, "i int", "decimal(38,0)")}
    return [found[i] for i in range(d)]


def _covariance(distinct: DataFrame, d: int, n: int, centred, column: str = "x") -> np.ndarray:
    """The weighted covariance, divisor n, of the centred vectors."""
    upper = np.triu_indices(d)

    def part(batches):
        gram = np.zeros((d, d))
        for x, w, _ in _blocks(batches):
            c = centred(x)
            gram += (c * w[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(gram[upper])], names=["i", "j", "v"])

    out = np.zeros((d, d))
    for r in _added(distinct.select(F.col(column).alias("x"), "weight"), part, "i int, j int", "double"):
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the entry of largest size being positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def whiten(rows: DataFrame, components: int = 8, weights: str = "count", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) for every row whose vector is whole and finite.

    ``whitened`` and ``explained`` are arrays with an entry for each component, of which there are as many as dimensions at
    most.  ``weights`` is "count" (every row counts in the fit) or "one" (every distinct vector counts once); n and the
    sums behind ``deviation``, a decimal, follow it.  Null vectors, empty ones and vectors with null or non-finite entries
    are left out; ids may be null or repeat.  Where the vectors span fewer dimensions, the components beyond have null for
    ``whitened`` and stay out of the identity's error; if all vectors are equal, ``explained`` is null too.  No vectors
    give an empty result.  Vectors of several lengths are an error.  Other columns are ignored.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"weights are count or one, not {weights}")
    scratch = Scratch(rows.sparkSession)
    whole = rows.where(is_finite(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), whole_vector(F.col(vector_col), scale, shift).alias("x"))
    # two hashes of different seeds stand for a vector in the join back
    key = [F.xxhash64(F.lit(seed), "x").alias(f"h{seed}") for seed in (1, 2)]
    grouped = whole.groupBy("x").agg(F.count("*").alias("copies")).select(*key, "x", "copies", (F.col("copies") if weights == "count" else F.lit(1).cast("long")).alias("weight"))
    distinct, seen = scratch.measured("distinct", grouped, n=F.sum("weight"), rows=F.sum("copies"), least=F.min(F.size("x")), most=F.max(F.size("x")))
    schema = f"vec_id {dict(whole.dtypes)['vec_id']}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if not seen["n"]:
        scratch.delete()
        return rows.sparkSession.createDataFrame([], schema)
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors have from {seen['least']} to {seen['most']} entries")
    n, d = seen["n"], seen["most"]
    k = min(components, d)
    sums = _sums(distinct, d)
    floor, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    share = np.array([r / n for r in rest])
    centred = lambda x: (x - floor).astype(float) - share  # noqa: E731  exact up to the last subtraction
    covariance = _covariance(distinct, d, n, centred)
    values, vectors = principal(covariance, k)
    trace = float(np.trace(covariance))
    live = values > values[0] * d * np.finfo(float).eps
    basis = vectors[:, live] / np.sqrt(values[live])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, some in _blocks(batches):
            low = x - floor
            small = (n * (int(np.abs(low).max()) + 1)) ** 2 * d < 1 << 63
            apart = low * n - np.array(rest) if small else low.astype(object) * n - np.array(rest, object)
            z = centred(x) @ basis
            flat = pa.ListArray.from_arrays(pa.array(range(0, z.size + 1, max(1, z.shape[1])) if z.shape[1] else [0] * (len(z) + 1), pa.int32()), pa.array(z.ravel()))
            kept = [some.column(c) for c in ("h1", "h2", "copies", "weight")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([str(v) for v in (apart * apart).sum(1)]), flat], names=["h1", "h2", "copies", "weight", "deviation", "z"])

    projected = scratch.table("projected", distinct.mapInArrow(project, "h1 long, h2 long, copies long, weight long, deviation string, z array<double>"))
    error = None
    if live.any():
        wide = int(live.sum())
        mean = np.zeros(wide)
        for r in projected.select("weight", F.posexplode("z").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("weight")) / n).alias("m")).collect():
            mean[r["i"]] = r["m"]
        error = float(np.abs(_covariance(projected, wide, n, lambda z: z - mean, "z") - np.eye(wide)).max())
    places = iter(range(int(live.sum())))
    whitened = F.array(*(F.get("z", F.lit(next(places))) if is_live else F.lit(None).cast("double") for is_live in live))
    explained = F.array(*(F.lit(float(v / trace)) if trace else F.lit(None).cast("double") for v in values))
    back = spread_join(whole.select("vec_id", *key), projected, ["h1", "h2"], ["vec_id"], seen["rows"], sizes=distinct.select("h1", "h2", F.col("copies").alias("n")))
    out = back.select("vec_id", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), whitened.alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    return scratch.last(out)


def component_rows(whitened: DataFrame) -> DataFrame:
    """A row for each component of the rows of ``whiten``; a deviation too large for a long is null."""
    each = whitened.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "identity_error")
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
