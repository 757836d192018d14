"""Benchmark passages in documents: SimHash of item-sized windows, multi-index blocks, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.running import numbered
from loomlog.llm.words import hash_dictionary, mix, shingle_hashes, slices, split_words

SIZE, PERCENT = 5, 80
BLOCKS, BLOCK_RADIUS = 4, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1  # within it, one block of 16 bits differs in at most BLOCK_RADIUS bits
MAP_BITS = 22


def weighted(shingles: np.ndarray) -> np.ndarray:
    """Shingles with their repeats numbered: sets of these overlap as the weighted originals do."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(ranked))
    turn = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.where(turn > 0, mix(ranked ^ turn.astype(np.uint64), 21), ranked)


def simhash(shingles: np.ndarray) -> int:
    """64 signs of the sum of the shingles' bits, as a signed number."""
    bits = np.unpackbits(mix(shingles, 22).view(np.uint8).reshape(-1, 8), axis=1)
    signs = bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)
    return int(np.packbits(signs).view(np.int64)[0])


def _spots(shingles: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Places in the map of shingles known from items of ``length`` words; 0 stands for any length."""
    salt = mix(np.asarray(length, np.uint64).reshape(-1), 24)
    return (mix(shingles ^ salt, 23) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item", pa.int64()), ("words", pa.int64()), ("print", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in slices(batches, "text"):
        offsets, words = split_words(batch.column("text"))
        edges, grams = shingle_hashes(offsets, hash_dictionary(words), SIZE)
        out = [(i, int(offsets[r + 1] - offsets[r]), grams[edges[r] : edges[r + 1]]) for r, i in enumerate(batch.column("id").to_pylist())]
        out = [(i, n, simhash(g), weighted(g).view(np.int64)) for i, n, g in out if n]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)] if out else
                                         [pa.array([], f.type) for f in schema], schema=schema)


def _windows(bits: np.ndarray, lengths: list[int], kind: pa.DataType):
    """Mapper: windows of each length in ``lengths`` that can be similar enough to an item.

    Similarity of 80 % asks for as many of a window's shingles, repeats counted,
    among those of the items of its own length, the only ones it is compared with;
    ``bits`` tells which may be, and never misses one.
    """
    schema = pa.schema([("id", kind), ("start", pa.int64()), ("words", pa.int64()), ("print", pa.int64()),
                        ("shingles", pa.list_(pa.int64()))])

    def held(shingles: np.ndarray, length: int) -> np.ndarray:
        spot = _spots(shingles, length)
        return (bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1

    def candidates(grams: np.ndarray, known: np.ndarray):
        """(start, shingles, item length) of windows in one text, given the places of shingles any item may have."""
        for length in lengths:
            count = max(1, length - SIZE + 1)
            wide = min(count, len(grams))
            if min(wide, len(known)) * 100 < count * PERCENT:
                continue
            hit = np.zeros(len(grams) + 1, np.int64)
            hit[known[held(grams[known], length)] + 1] = 1
            sums = np.cumsum(hit)
            for start in np.flatnonzero((sums[wide:] - sums[:-wide]) * 100 >= count * PERCENT).tolist():
                yield start, wide, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, words = split_words(batch.column("text"))
            edges, grams = shingle_hashes(offsets, hash_dictionary(words), SIZE)
            hit = held(grams, 0)
            sums = np.concatenate([[0], np.cumsum(hit)])
            ids, out = batch.column("id"), []
            for row in np.flatnonzero(sums[edges[1:]] > sums[edges[:-1]]).tolist():
                mine, seen = grams[edges[row] : edges[row + 1]], {}
                for start, wide, length in candidates(mine, np.flatnonzero(hit[edges[row] : edges[row + 1]])):
                    if (start, wide) not in seen:
                        part = mine[start : start + wide]
                        seen[start, wide] = (simhash(part), weighted(part).view(np.int64))
                    out.append((row, start, length, *seen[start, wide]))
                if len(out) >= 20_000:
                    yield emit(ids, out)
                    out = []
            if out:
                yield emit(ids, out)

    def emit(ids: pa.Array, out: list) -> pa.RecordBatch:
        rows, *rest = (list(c) for c in zip(*out))
        columns = [ids.take(pa.array(rows)), *(pa.array(c, f.type) for c, f in zip(rest, list(schema)[1:]))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _bit_map(items: DataFrame) -> np.ndarray:
    """Fixed-size map of all item shingles, alone and with their item's length: 2**22 bits for any benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, words = split_words(batch.column("text"))
            edges, grams = shingle_hashes(offsets, hash_dictionary(words), SIZE)
            spots = np.concatenate([_spots(grams, 0), _spots(grams, np.repeat(np.diff(offsets), np.diff(edges)))])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(spots))], ["spot"])

    spots = items.mapInArrow(run, "spot long")
    words = spots.groupBy(F.shiftright("spot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << MAP_BITS - 6, np.uint64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: key, item_id, start, words, distance, similarity.

    Every window of as many words as an item has (the whole text if it is
    shorter) and the item itself get a 64-bit SimHash of their five-word shingles.
    Fingerprints within 19 bits agree in one of four blocks up to 4 bits, so items
    are entered under every block value that near and windows look theirs up.
    Found pairs are compared on the shingles weighted by how often each occurs,
    and hold from a similarity of 0.8; of several windows the most similar, then
    the first, is reported. Words are cut at ASCII white space, in lower case
    ASCII. Items and texts without words match nothing; an item of fewer than
    five words is one shingle. Null keys are reported as one document; repeated
    items give a row each if their ids differ; ids may be of any type, and an id
    with several texts is found where one of them is.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    named = numbered(benchmark.select(F.col("item_id").alias("name"), F.col("text").cast("string").alias("text")).distinct(), "id")
    items = named.select("id", "text")  # told apart by numbers: names may be of any type, and may repeat
    listed = items.mapInArrow(_items, "item long, words long, print long, shingles array<long>")
    lengths = sorted(r.words for r in listed.select("words").distinct().collect())
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()),
        T.StructField("print", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())),
    ])
    windows = rows.mapInArrow(_windows(_bit_map(items), lengths, to_arrow_type(kind)), schema)

    def blocks(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)]))).withColumn(
            "value", F.expr("cast(shiftrightunsigned(print, block * 16) & 65535 as int)"))

    near = F.filter(F.sequence(F.lit(0), F.lit(65535)), lambda m: F.bit_count(m) <= BLOCK_RADIUS)
    entered = blocks(listed).withColumn("flips", F.explode(near)).withColumn("value", F.col("value").bitwiseXOR(F.col("flips")))
    entered = entered.select("words", "block", "value", "item", F.col("print").alias("item_print"))
    grams = listed.select("item", F.col("shingles").alias("item_shingles"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    common = F.size(F.array_intersect("shingles", "item_shingles"))
    union = F.size("shingles") + F.size("item_shingles") - common
    # an item is entered under thousands of values, more than its file's size tells: not to be broadcast
    met = blocks(windows).join(entered.hint("merge"), ["words", "block", "value"]).withColumn("distance", distance).filter(
        F.col("distance") <= RADIUS)
    found = met.join(grams, "item").withColumn("common", common).withColumn("union", union).filter(
        F.col("common") * 100 >= F.col("union") * PERCENT)
    best = F.min(F.struct((-F.col("common") / F.col("union")).alias("s"), "start", "distance", "words"))
    called = named.select(F.col("id").alias("item"), F.col("name").alias("item_id"))
    return found.join(called, "item").groupBy("id", "item_id").agg(best.alias("b")).select(
        F.col("id").alias(key), "item_id", F.col("b.start").alias("start"), F.col("b.words").alias("words"),
        F.col("b.distance").alias("distance"), (-F.col("b.s")).alias("similarity"))
