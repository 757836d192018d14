"""Vectors as codes of part codebooks: nearest entries found along a trie of distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUES = 1 << 22  # components of the vectors whose parts make one trie
HELD = 1 << 20  # distances held along one path of blocks of the trie
LARGEST = 2.0**18  # components from here on count as not finite: squared distances would leave 64 bits


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, place]`` in whole steps, ``scale`` of them to a unit; ``width`` components a vector."""

    entries: np.ndarray
    width: int
    scale: int = 256

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_parts(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """Components in whole steps, (rows, parts, places); a width that ``parts`` does not divide is padded with zeros."""
    whole = np.floor(vectors * scale).astype(np.int64)
    places = max(1, -(-whole.shape[1] // parts))
    return np.pad(whole, ((0, 0), (0, places * parts - whole.shape[1]))).reshape(len(whole), parts, places)


def trie_nearest(ordered: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, nearest entry, distance) of the distinct rows of ``ordered``, which is in lexicographic order.

    A node of the trie stands for all rows that begin alike and holds the distances
    of that beginning to the same beginning of every entry; each child adds one
    place to them, so a common beginning is measured once. The walk goes depth
    first, in blocks of neighbouring nodes: one block for each place is held. At
    the leaves the least distance decides, ties go to the lower entry.
    """
    places = ordered.shape[1]
    opens = np.ones(ordered.shape, bool)  # opens[row, place]: the row starts a node that deep
    opens[1:] = np.logical_or.accumulate(ordered[1:] != ordered[:-1], axis=1)
    block = max(64, HELD // (places * max(1, len(entries))))

    def below(nodes: np.ndarray, end: int, held: np.ndarray, place: int):
        children = nodes[0] + np.flatnonzero(opens[nodes[0] : end, place])
        parent = np.searchsorted(nodes, children, "right") - 1
        for at in range(0, len(children), block):
            some = children[at : at + block]
            stop = int(children[at + block]) if at + block < len(children) else end
            gap = ordered[some, place][:, None] - entries[:, place]
            reached = held[parent[at : at + block]] + gap * gap
            if place + 1 < places:
                yield from below(some, stop, reached, place + 1)
            else:
                nearest = reached.argmin(axis=1)
                yield some, nearest, reached[np.arange(len(some)), nearest]

    if len(ordered):
        yield from below(np.zeros(1, np.int64), len(ordered), np.zeros((1, len(entries)), np.int64), 0)


def assign(parts: np.ndarray, entries: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) for the rows of one part position. ``sums`` (entries, places + 1), where
    given, gains the weighted sums: components of each entry's parts, and how many in the last column."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    chosen, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    waiting: list[tuple] = []

    def settle(upto: int) -> None:
        first, nearest, distance = waiting.pop()
        copies = np.diff(first, append=upto)
        chosen[order[first[0] : upto]] = np.repeat(nearest, copies)
        error[order[first[0] : upto]] = np.repeat(distance, copies)
        if sums is not None:
            np.add.at(sums, nearest, np.column_stack([ordered[first], np.ones(len(first), np.int64)]) * copies[:, None])

    for leaves in trie_nearest(ordered, entries):
        if waiting:
            settle(int(leaves[0][0]))
        waiting.append(leaves)
    if waiting:
        settle(len(parts))
    return chosen, error


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows and their vectors, many batches together as far as ``VALUES`` allows."""
    limit, held, count = max(1, VALUES // width), [], 0

    def made():
        table = pa.Table.from_batches(held)
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table, flat.reshape(-1, width)

    for batch in batches:
        for begin in range(0, batch.num_rows, limit):
            some = batch.slice(begin, limit)
            if held and count + some.num_rows > limit:
                yield made()
                held, count = [], 0
            held.append(some)
            count += some.num_rows
    if count:
        yield made()


def _adder(books: Codebooks):
    """Arrow mapper: vectors -> one row for each component of each entry that a task's parts chose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, places = books.entries.shape
        sums = np.zeros((parts, entries, places + 1), np.int64)
        for _, vectors in _matrices(batches, books.width):
            whole = whole_parts(vectors, parts, books.scale)
            for p in range(parts):
                assign(whole[:, p], books.entries[p], sums[p])
        part, entry = np.nonzero(sums[:, :, -1])
        used = sums[part, entry]
        columns = [np.repeat(part, places), np.repeat(entry, places), np.tile(np.arange(places), len(part)),
                   used[:, :-1].ravel(), np.repeat(used[:, -1], places)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total", "n"])

    return run


def _coder(books: Codebooks, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books.entries)
        for table, vectors in _matrices(batches, books.width):
            whole = whole_parts(vectors, parts, books.scale)
            codes, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p in range(parts):
                codes[:, p], distance = assign(whole[:, p], books.entries[p])
                error += distance
            data = codes.tobytes()
            out = table.select(columns).append_column(
                "code", pa.array([data[i : i + parts] for i in range(0, len(data), parts)], pa.binary())
            ).append_column("error", pa.array(error))
            yield from out.combine_chunks().to_batches()

    return run


def usable(rows: DataFrame, key: str, vector: str, carried: list[str]) -> DataFrame:
    """(id, vector as doubles, carried…) of the rows whose vector has finite components only."""
    named = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                        *[F.col(c).alias(f"_{i}") for i, c in enumerate(carried)])
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(LARGEST)))
    return named.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & sound)


def train(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of :func:`usable` rows, or None if there are none.

    They start as the parts of the first ``entries`` rows by id (null last, equal
    ids by vector); each round assigns all parts and moves every entry to the mean
    of its own, rounded down; entries without parts stay. A round reads the rows
    once and brings no more than one sum for each component of the codebooks to
    the driver, whatever the number of rows; whole numbers make it exact.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*order).limit(entries).collect()
    if not first:
        return None
    width = len(first[0].vector)
    if any(len(r.vector) != width for r in first):
        first = kept.filter(F.size("vector") == width).orderBy(*order).limit(entries).collect()
    start = whole_parts(np.array([r.vector for r in first]), parts, scale)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), width, scale)
    alike = kept.filter(F.size("vector") == width).select("vector")
    for _ in range(rounds):
        moved = books.entries.copy()
        added = alike.mapInArrow(_adder(books), "part long, entry long, place long, total long, n long")
        for r in added.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r.part, r.entry, r.place] = r.total // r.n
        books = Codebooks(moved, width, scale)
    return books


def encode(kept: DataFrame, books: Codebooks, carried: list[str]) -> DataFrame:
    """(id, ``carried``…, code, error) of :func:`usable` rows as wide as the codebooks."""
    names = ["id", *[f"_{i}" for i in range(len(carried))]]
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    coded = kept.filter(F.size("vector") == books.width).mapInArrow(_coder(books, names), schema)
    return coded.select("id", *[F.col(f"_{i}").alias(c) for i, c in enumerate(carried)], "code", "error")


def compress(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", carried: list[str] | None = None,
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
) -> tuple[DataFrame, Codebooks | None]:
    """(rows of id, ``carried``…, code, error; the codebooks). ``code`` has one byte per part.

    A component x counts as floor(scale * x). Rows whose vector is null, empty, of
    another width than the first row by key, or holds a null or non-finite
    component (or one of 2**18 and more) are left out. Where ``parts`` does not
    divide the width, zeros fill the last parts. Repeated keys and rows are rows of
    their own. Without a usable row the result is empty and the codebooks None.
    ``error`` is the squared distance to the entries, summed over the parts.
    """
    carried = carried or []
    kept = usable(rows, key, vector, carried)
    books = train(kept, parts, entries, rounds, scale)
    if books is None:
        return encode(kept.limit(0), Codebooks(np.zeros((parts, 1, 1), np.int64), parts, scale), carried), None
    return encode(kept, books, carried), books


def rebuild(coded: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """``coded`` with ``rebuilt``: the entries that the code names, as a vector of doubles."""
    wide = books.entries.astype(np.float64) / books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if c is None else np.frombuffer(c, np.uint8) for c in batch.column(code).to_pylist()]
            rows = [None if c is None else wide[np.arange(len(wide)), c].ravel()[: books.width] for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, "rebuilt"])

    kept = coded.drop("rebuilt")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("rebuilt", T.ArrayType(T.DoubleType()))]))
