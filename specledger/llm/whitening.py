"""Whitening of embeddings with weighted multiplicity covariance (operator 11).

Entries become whole numbers, identical vectors are grouped with their number of copies, and everything after that works on the distinct vectors: the weighted
mean, the weighted covariance (centred first, then one matrix product per Arrow batch), and the projection. Tasks send
sums and one triangle of a matrix each; only the sums over all tasks reach the driver, which finds the components of a matrix as wide as one vector.
The whitened vectors are joined back to the rows (``copies.join_copies``).

Defined results: rows with a null vector, or with null or non-finite entries, are dropped; repeated rows come out as often
as they occur, and so do rows with a null id. Vectors of different lengths are whitened apart, each length with its own fit; an empty vector has no
component and gives no row. Entries are clipped at 2^53 in size. Components without variance (up to rounding) have a null ``whitened``, and are left out of
``identity_error``; where nothing varies ``explained`` is null. A ``deviation`` that a long cannot hold is null. Equal eigenvalues are in any
order, the same for all rows. An empty table gives an empty one. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specledger.llm.copies import join_copies
from specledger.session import stage_table

GRID, SHIFT, LIMIT = 64, 1_000_000, float(1 << 53)
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
ROWS = "vec_id long, packed binary"
CELLS = "dim int, i int, j int, v double"
WHITE = "packed binary, copies long, weight long, dim int, deviation long, white array<double>"


def pack(x: np.ndarray) -> list[bytes]:
    """Each row of integers as bytes: the narrowest width that holds it, then the entries. Equal rows and only those have equal bytes."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.zeros(len(x), np.int64)
    for k, kind in enumerate(WIDTHS[:-1]):
        width[(low < np.iinfo(kind).min) | (high > np.iinfo(kind).max)] = k + 1
    out = np.empty(len(x), object)
    for k, kind in enumerate(WIDTHS):
        rows = np.flatnonzero(width == k)
        out[rows] = [bytes([k]) + r.tobytes() for r in x[rows].astype(kind)]
    return out.tolist()


def unpack(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and rows of integers, for each length of the vectors."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(packed):
        groups.setdefault((b[0], len(b)), []).append(i)
    by_dim: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for (k, size), rows in groups.items():
        x = np.frombuffer(b"".join(packed[i][1:] for i in rows), WIDTHS[k]).reshape(len(rows), -1).astype(np.int64)
        by_dim.setdefault(x.shape[1], []).append((np.array(rows), x))
    for parts in by_dim.values():
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        # An empty vector has nothing to whiten; a null one counts as empty here.
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            x = values[starts[rows][:, None] + np.arange(size)]
            fit = np.isfinite(x).all(axis=1)
            y = np.clip(np.floor(x[fit] * GRID), -LIMIT, LIMIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[fit])), pa.array(pack(y), pa.binary())], ["vec_id", "packed"])


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the vector of whole numbers (less ``SHIFT``, which no covariance sees), packed."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        _pack_rows, ROWS)


def weighted_sums(distinct: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors (with weights) and sum of each entry, exact, for each length of vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for rows, x in unpack(batch.column(0).to_pylist()):
                w = weights[rows]
                if int(np.abs(x).max()) * int(w.sum()) >= 1 << 63:  # whole numbers of any size
                    x, w = x.astype(object), w.astype(object)
                # Entry 0 is the number of vectors.
                sums = np.concatenate(([w.sum()], (x * w[:, None]).sum(axis=0))).astype(object)
                total[x.shape[1]] = total.get(x.shape[1], 0) + sums
        cells = [(d, i, str(v)) for d, sums in total.items() for i, v in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["dim", "i", "s"])

    found = distinct.select("packed", "weight").mapInArrow(partial, "dim int, i int, s string").groupBy("dim", "i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = {d: np.zeros(d + 1, object) for d in {r["dim"] for r in found}}
    for r in found:
        out[r["dim"]][r["i"]] = int(r["s"])
    return {d: (int(s[0]), s[1:]) for d, s in out.items()}


def _triangle_cells(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    columns = [[np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0)]]
    for d, gram in total.items():
        i, j = np.triu_indices(len(gram))
        for column, part in zip(columns, (np.full(len(i), d, np.int32), i.astype(np.int32), j.astype(np.int32), gram[i, j])):
            column.append(part)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["dim", "i", "j", "v"])


def _collect_matrices(cells: DataFrame, widths: dict[int, int]) -> dict[int, np.ndarray]:
    out = {d: np.zeros((w, w)) for d, w in widths.items()}
    for r in cells.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["dim"]][r["i"], r["j"]] = out[r["dim"]][r["j"], r["i"]] = r["v"]
    return out


def covariances(distinct: DataFrame, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Weighted sums of products of the centred vectors, for each length of vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for rows, x in unpack(batch.column(0).to_pylist()):
                centred = x - means[x.shape[1]]
                total[x.shape[1]] = total.get(x.shape[1], 0) + (centred * weights[rows][:, None]).T @ centred
        yield _triangle_cells(total)

    return _collect_matrices(distinct.select("packed", "weight").mapInArrow(partial, CELLS), {d: d for d in means})


def principal(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their unit vectors (as columns, the largest entry positive)."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n * x - S)^2 over the entries, exact, null where a long cannot hold it."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist()), default=0)
    if len(sums) * reach * reach < 1 << 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 16, weights: str = "one") -> DataFrame:
    """A row per row and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``copies``.

    ``weights`` is ``one`` (each distinct vector counts once in the fit) or ``count`` (as often as it occurs).
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is one or count")
    spark = vectors.sparkSession
    rows = quantised(vectors)
    weight = F.col("copies") if weights == "count" else F.lit(1).cast("long")
    distinct = stage_table(rows.groupBy("packed").agg(F.count(F.lit(1)).alias("copies")).select("packed", "copies", weight.alias("weight")), "distinct-vectors")
    totals = weighted_sums(distinct)
    means = {d: np.array([s / n for s in sums.tolist()]) for d, (n, sums) in totals.items()}
    fits = {}
    for d, gram in covariances(distinct, means).items():
        values, axes = principal(gram / totals[d][0], components)
        trace = float(np.trace(gram)) / totals[d][0]
        real = values > trace * d * np.finfo(float).eps
        fits[d] = values, trace, real, axes / np.sqrt(np.where(real, values, 1.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for at, x in unpack(packed):
                d = x.shape[1]
                white = (x - means[d]) @ fits[d][3]
                shape = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(at)) for c in batch.columns], pa.array(np.full(len(x), d, np.int32)),
                     pa.array(deviations(x, *totals[d]), pa.int64()), shape], ["packed", "copies", "weight", "dim", "deviation", "white"])

    white = stage_table(distinct.mapInArrow(project, WHITE), "whitened")
    errors = identity_errors(white, {d: len(f[0]) for d, f in fits.items()}, {d: n for d, (n, _) in totals.items()}, {d: f[2] for d, f in fits.items()})
    # One row for each length of vectors and component.
    facts = spark.createDataFrame(
        [(d, k + 1, totals[d][0], float(values[k] / trace) if trace > 0 else None, bool(real[k]), errors[d])
         for d, (values, trace, real, _) in fits.items() for k in range(len(values))],
        "dim int, component int, n long, explained double, real boolean, identity_error double")
    joined = join_copies(rows, white.select("packed", "copies", "dim", "deviation", "white"), "packed")
    out = joined.select("vec_id", "copies", "dim", "deviation", F.posexplode("white").alias("pos", "value")).withColumn("component", F.col("pos") + 1)
    return out.join(F.broadcast(facts), ["dim", "component"]).select(
        "vec_id", "component", "n", "deviation", F.when(F.col("real"), F.col("value")).alias("whitened"), "explained", "identity_error", "copies")


def identity_errors(white: DataFrame, widths: dict[int, int], counts: dict[int, int], real: dict[int, np.ndarray]) -> dict[int, float | None]:
    """Largest entry of the covariance of the whitened vectors less the identity, measured on them."""
    named = white.select("dim", "weight", F.posexplode("white").alias("i", "v"))
    means = {d: np.zeros(w) for d, w in widths.items()}
    for r in named.groupBy("dim", "i").agg(F.sum(F.col("v") * F.col("weight")).alias("s")).collect():
        means[r["dim"]][r["i"]] = r["s"] / counts[r["dim"]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                centred = batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1) - means[d]
                total[d] = total.get(d, 0) + (centred * weights[at][:, None]).T @ centred
        yield _triangle_cells(total)

    out: dict[int, float | None] = {}
    for d, gram in _collect_matrices(white.select("dim", "weight", "white").mapInArrow(partial, CELLS), widths).items():
        kept = np.flatnonzero(real[d])
        off = np.abs(gram[np.ix_(kept, kept)] / counts[d] - np.eye(len(kept)))
        out[d] = float(off.max()) if len(kept) else None
    return out
