"""Vector codes: parts of a vector named by the nearest entry of a codebook, found by look-ups of integer values.

Components become integers, and vectors go into blocks that hold, for each dimension, the distinct integers and for each
vector the place of its own. For a codebook the squared difference of every distinct integer to every entry is
tabulated once per block; the distances of a part are then gathered from these tables and added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.columns import durable

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Most vectors in a block; their places in a dictionary then fit 16 bits.
BLOCK = 8192
#: Integers must be smaller, so that squared distances and their sums in a block are exact.
LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


@dataclass(frozen=True)
class Codebooks:
    """For each part an array of entries by component."""

    parts: tuple[np.ndarray, ...]

    @staticmethod
    def of(rows: np.ndarray) -> Codebooks:
        """Whole vectors, one a row, cut into equal consecutive parts."""
        cuts = [rows.shape[1] * p // PARTS for p in range(PARTS + 1)]
        return Codebooks(tuple(rows[:, a:b] for a, b in zip(cuts, cuts[1:])))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.parts for x in part.ravel().tolist()).encode()).hexdigest()


@dataclass(frozen=True)
class Block:
    """Vectors by dimension: its distinct integers, ascending, and the place of each vector's among them."""

    values: tuple[np.ndarray, ...]
    places: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray) -> Block:
        found = [np.unique(vectors[:, d], return_inverse=True) for d in range(vectors.shape[1])]
        places = np.array([p for _, p in found], np.uint16).reshape(vectors.shape[::-1])
        return Block(tuple(v for v, _ in found), places)

    @staticmethod
    def read(n: int, sizes: bytes, values: bytes, places: bytes) -> Block:
        cuts = np.cumsum(np.frombuffer(sizes, np.int32))[:-1]
        found = tuple(np.split(np.frombuffer(values, np.int64), cuts)) if len(sizes) else ()
        return Block(found, np.frombuffer(places, np.uint16).reshape(len(found), n))

    def assigned(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """(part, vector) the nearest entry, the lowest of several, and the squared distance to it."""
        n = self.places.shape[1]
        nearest, distance, first = [], [], 0
        for entries in books.parts:
            total = np.zeros((n, len(entries)), np.int64)
            for d in range(entries.shape[1]):
                table = (self.values[first + d][:, None] - entries[None, :, d]) ** 2
                total += table[self.places[first + d]]
            best = total.argmin(axis=1)
            nearest.append(best)
            distance.append(total[np.arange(n), best])
            first += entries.shape[1]
        return np.array(nearest).reshape(PARTS, n), np.array(distance).reshape(PARTS, n)

    def sums(self, books: Codebooks, nearest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the parts at each entry, by component, and the numbers of parts; both flat, in codebook order."""
        sums, counts, first = [], [], 0
        for entries, best in zip(books.parts, nearest):
            k, width = entries.shape
            each = np.zeros((k, width), np.int64)
            for d in range(width):
                values = self.values[first + d]
                held = np.bincount(best * len(values) + self.places[first + d], minlength=k * len(values)).reshape(k, -1)
                each[:, d] = held @ values
            sums.append(each.ravel())
            counts.append(np.bincount(best, minlength=k))
            first += width
        return np.concatenate(sums), np.concatenate(counts)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """4096 times each component, rounded down."""
    made = np.floor(SCALE * vectors)
    if made.size and np.abs(made).max() >= LIMIT:
        raise ValueError(f"components must lie between -{LIMIT // SCALE} and {LIMIT // SCALE}")
    return made.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def blocks(kept: DataFrame, width: int) -> DataFrame:
    """One row per block of (key, label, vector) rows: their keys and labels, and the dictionaries with the places."""
    key, label = (kept.schema[c].dataType for c in ("key", "label"))
    out = T.StructType().add("keys", T.ArrayType(key)).add("labels", T.ArrayType(label))
    out = out.add("sizes", T.BinaryType()).add("values", T.BinaryType()).add("places", T.BinaryType())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                made = Block.of(_integers(_matrix(part.column("vector"), width)))
                sizes = np.array([len(v) for v in made.values], np.int32).tobytes()
                values = b"".join(v.tobytes() for v in made.values)
                ends = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, part.column(c)) for c in ("key", "label")]
                bytes_ = [pa.array([b], pa.binary()) for b in (sizes, values, made.places.tobytes())]
                yield pa.RecordBatch.from_arrays([*lists, *bytes_], ["keys", "labels", "sizes", "values", "places"])

    return durable(kept.select("key", "label", "vector").mapInArrow(build, out))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, pa.Scalar, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys, parts = batch.column("keys")[i], (batch.column(c)[i].as_py() for c in ("sizes", "values", "places"))
            yield keys, batch.column("labels")[i], Block.read(len(keys), *parts)


def improved(table: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the mean, rounded down, of the parts nearest to it; entries without parts stay.

    Tasks add up their blocks; the sums that come to the driver are as many as the codebooks have components.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, block in _read(batches):
            sums, counts = block.sums(books, block.assigned(books)[0])
            made = np.concatenate([sums, counts])
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), "total": pa.array(total, pa.int64())})

    each = table.mapInArrow(add, "place int, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {row["place"]: int(row["total"]) for row in each.collect()}
    n_sums = sum(part.size for part in books.parts)
    parts, place, counted = [], 0, n_sums
    for part in books.parts:
        new = part.copy()
        for e in range(len(part)):
            n = found.get(counted + e, 0)
            if n:
                new[e] = [found[place + e * part.shape[1] + d] // n for d in range(part.shape[1])]
        parts.append(new)
        place, counted = place + part.size, counted + len(part)
    return Codebooks(tuple(parts))


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(key, label, code, error, label_error) of every vector, and the codebooks.

    Rows whose vector is null or holds a null or a component that is not finite are left out. Codebooks start as the
    parts of the ``ENTRIES`` smallest keys (nulls last, ties by vector and label; with fewer vectors there are fewer
    entries), and are improved ``rounds`` times over all vectors. ``code`` names the entry of each part in two hex
    digits, ``error`` is the squared distance to them, ``label_error`` its sum over rows of the same label, nulls
    together. Repeated rows are rows of their own. The width is that of the first vector; vectors of another one have a
    null code and error. Widths that 8 does not divide are cut as evenly as can be. Components must lie between -32768
    and 32768. An empty table gives no rows and codebooks without entries. Other columns play no part.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(finite(F.col("vector")))
    first = rows.orderBy(F.asc_nulls_last("key"), "vector", "label").limit(ENTRIES).collect()
    width = len(first[0]["vector"]) if first else 0
    start = [row["vector"] for row in first if len(row["vector"]) == width]
    books = Codebooks.of(_integers(np.array(start, np.float64).reshape(len(start), width)))
    table = blocks(rows.where(F.size("vector") == width), width)
    for _ in range(rounds if first else 0):
        books = improved(table, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, labels, block in _read(batches):
            nearest, distance = block.assigned(books)
            names = [bytes(x).hex() for x in nearest.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [keys.values, labels.values, pa.array(names, pa.string()), pa.array(distance.sum(axis=0), pa.int64())], ["key", "label", "code", "error"]
            )

    schema = T.StructType([rows.schema["key"], rows.schema["label"]]).add("code", "string").add("error", "long")
    other = rows.where(F.size("vector") != width).select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = durable(table.mapInArrow(code, schema).unionByName(other))
    sums = durable(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))  # of known size: small ones are broadcast
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error"), books
