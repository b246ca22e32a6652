"""Compression of vectors into codes of their parts' nearest codebook entries, searched with pivots (LAESA).

Components become integers, floor(``SCALE`` * x), so that sums, means and distances are exact. A vector is
cut into equal consecutive parts; each position has its own codebook, which starts as that part of the
vectors with the smallest ids. A round assigns every part to the nearest entry and replaces each entry by
the floor of its parts' mean; entries without parts stay.

The nearest entry is found with fixed pivots, the first codebook. The distances from each part to
the pivots of its position are computed once, in the pass that makes the integers, and stored with it. In
each round the distances from the pivots to the new entries, a few numbers, are sent with the codebooks. By
the triangle inequality the difference of the two distances to a pivot is a lower bound of the distance to the
entry. Entries are tried in the order of their bounds; one whose bound is above the best distance so far is
never evaluated. Distances that are evaluated are exact integers.

A task adds up its parts per position and entry, so a round sends positions x entries rows per task and
as many to the driver in all, whatever the number of vectors.

Defined results: rows are dropped whose vector is null or empty, holds a null or non-finite component, or one so large
that squared distances exceed a long (``limit_of``), or has another length than the finite vector with the smallest
id. Lengths that are no multiple of the number of parts give parts that differ by one component. Ties between equal ids are broken by the vectors; a null id comes last. Equal
rows each have their own result. Fewer vectors than entries give smaller codebooks, an empty table an
empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import floor, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import stored, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Labels with their sums that are sent to all tasks; more are joined by label.
SENT_LABELS = 100_000
# Distances are roots in double precision: bounds are lowered by this share of the numbers they come from.
SLACK = 1e-9

Codebooks = list[np.ndarray]  # per part: entries x components


def limit_of(size: int) -> int:
    """The largest absolute component whose squared distances over a whole vector surely fit in a long."""
    return isqrt((1 << 61) // max(size, 1)) // 2


def edges_of(size: int, parts: int) -> list[int]:
    return [size * p // parts for p in range(parts + 1)]


def nearest(values: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry, ties to the lower index, and the distances evaluated."""
    between = np.sqrt(((pivots[:, None, :] - entries[None, :, :]).astype(np.float64) ** 2).sum(axis=2))
    bound = np.zeros((len(values), len(entries)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - between[p]) - SLACK * (to_pivots[:, p, None] + between[p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(values), -1, np.int64)
    found = np.full(len(values), np.iinfo(np.int64).max)
    rows, tried = np.arange(len(values)), 0
    for turn in range(len(entries)):
        entry = order[rows, turn]
        # Bounds rise from turn to turn, so a row that stops here is done.
        rows_left = bound[rows, entry] <= np.sqrt(found[rows].astype(np.float64)) * (1 + SLACK)
        rows, entry = rows[rows_left], entry[rows_left]
        if not len(rows):
            break
        apart = values[rows] - entries[entry]
        squared = np.einsum("ij,ij->i", apart, apart)
        tried += len(rows)
        better = (squared < found[rows]) | ((squared == found[rows]) & (entry < best[rows]))
        found[rows[better]], best[rows[better]] = squared[better], entry[better]
    return best, found, tried


def _distances(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from each row to each pivot."""
    return np.sqrt(np.stack([((values - p) ** 2).sum(axis=1) for p in pivots], axis=1).astype(np.float64))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


_INTEGERS = "vec_id long, label {label}, parts array<long>, pivots array<double>"


def _integers(codebooks: Codebooks, edges: list[int], label_type: pa.DataType):
    """Integer components and the distances to the pivots of each part, part after part."""
    size, limit = edges[-1], limit_of(edges[-1])
    schema = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("parts", pa.list_(pa.int64())), ("pivots", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            right = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
            batch, vectors = batch.filter(right), vectors.filter(right)
            raw = _matrix(vectors, size).astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(raw * SCALE)
            good = (np.isfinite(scaled) & (np.abs(scaled) <= limit)).all(axis=1)
            batch, values = batch.filter(pa.array(good)), scaled[good].astype(np.int64)
            apart = [_distances(values[:, a:b], c) for a, b, c in zip(edges[:-1], edges[1:], codebooks)]
            lists = []
            for flat in (values, np.concatenate(apart, axis=1)):
                ends = pa.array(np.arange(len(values) + 1) * flat.shape[1], pa.int32())
                lists.append(pa.ListArray.from_arrays(ends, pa.array(flat.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *lists], schema=schema)

    return run


class Assigner:
    """Assigns the parts of a batch to the entries of codebooks."""

    def __init__(self, codebooks: Codebooks, pivots: Codebooks, edges: list[int]):
        self.codebooks, self.pivots, self.edges = codebooks, pivots, edges

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Part, its components, the nearest entries and the squared distances."""
        values = _matrix(batch.column("parts"), self.edges[-1])
        far = _matrix(batch.column("pivots"), sum(map(len, self.pivots)))
        at = 0
        for part, (entries, pivots) in enumerate(zip(self.codebooks, self.pivots)):
            own = values[:, self.edges[part] : self.edges[part + 1]]
            best, found, _ = nearest(own, far[:, at : at + len(pivots)], entries, pivots)
            at += len(pivots)
            yield part, own, best, found


def _sums(assign: Assigner):
    """Numbers of parts and sums of components per part and entry of a task: the place counts from the codebooks' start."""
    sizes = [len(c) for c in assign.codebooks]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(n, np.int64) for n in sizes]
        sums = [np.zeros(c.shape, object) for c in assign.codebooks]
        for batch in batches:
            for part, own, best, _ in assign(batch):
                counts[part] += np.bincount(best, minlength=sizes[part])
                added = np.zeros(sums[part].shape, np.int64)
                np.add.at(added, best, own)
                sums[part] += added
        rows = [(part, entry, -1, counts[part][entry]) for part, n in enumerate(sizes) for entry in range(n)]
        rows += [(p, *place, s) for p, some in enumerate(sums) for place, s in np.ndenumerate(some)]
        *places, totals = zip(*rows)
        columns = [*(pa.array(c, pa.int32()) for c in places), pa.array(map(int, totals), pa.decimal128(38))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total"])

    return run


def _updated(codebooks: Codebooks, vectors: DataFrame, pivots: Codebooks, edges: list[int]) -> Codebooks:
    """Entries replaced by the floor of their parts' mean."""
    sums = vectors.select("parts", "pivots").mapInArrow(_sums(Assigner(codebooks, pivots, edges)), "part int, entry int, place int, total decimal(38,0)")
    # As many rows as the codebooks have numbers and entries.
    totals = {(r.part, r.entry, r.place): int(r.total) for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()}
    new = [c.copy() for c in codebooks]
    for (part, entry, place), total in totals.items():
        n = totals[part, entry, -1]
        if place >= 0 and n:
            new[part][entry, place] = total // n
    return new


def _codes(assign: Assigner, label_type: pa.DataType):
    schema = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{n:02x}" for n in range(256)])
        for batch in batches:
            code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
            for _, _, best, found in assign(batch):
                code, error = code + digits[best].astype(object), error + found
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], schema=schema)

    return run


def codebooks_digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def _start(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Length and integers of the vectors with the smallest ids, ``ENTRIES`` rows at most."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    kept = vectors.filter((F.size("embedding") > 0) & finite)
    top = kept.orderBy(*order).select(F.size("embedding")).first()
    if top is None:
        return 0, np.zeros((0, 0), np.int64)
    size = top[0]
    limit = float(limit_of(size))
    fits = F.forall("embedding", lambda x: (x * SCALE >= -limit) & (x * SCALE < limit + 1))
    rows = kept.filter((F.size("embedding") == size) & fits).orderBy(*order).limit(ENTRIES).select("embedding").collect()
    return size, np.array([[floor(x * SCALE) for x in r[0]] for r in rows], np.int64).reshape(len(rows), size)


def compress(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of the rows of ``vectors(vec_id, embedding, label)``, stored, and the codebooks."""
    label = vectors.schema["label"].dataType.simpleString()
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    size, first = _start(given)
    edges = edges_of(size, parts)
    pivots = [first[:, a:b] for a, b in zip(edges[:-1], edges[1:])]
    if not len(first):
        nothing = given.filter("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return nothing, pivots
    label_type = given.select("label").limit(0).toArrow().schema.field("label").type
    whole = written(given.mapInArrow(_integers(pivots, edges, label_type), _INTEGERS.format(label=label)))
    codebooks = pivots
    for _ in range(rounds):
        codebooks = _updated(codebooks, whole, pivots, edges)
    coded = whole.mapInArrow(_codes(Assigner(codebooks, pivots, edges), label_type), f"vec_id long, label {label}, code string, error long")
    return stored(coded), codebooks


def decompress(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """The vectors that the codes stand for, as ``decoded``: integers, part after part."""
    tables = [F.array(*(F.array(*(F.lit(int(x)).cast("long") for x in e)).cast("array<long>") for e in c)) for c in codebooks]
    picked = [F.get(t, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")) for p, t in enumerate(tables)]
    return coded.withColumn("decoded", F.flatten(F.array(*picked)) if picked else F.array().cast("array<long>"))


def label_errors(coded: DataFrame) -> DataFrame:
    """Per row: the error summed over the rows with an equal label; rows without one are together."""
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own"))
    if sums.count() <= SENT_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, coded["label"].eqNullSafe(sums["own"])).drop("own")
