"""Fill-in-the-middle texts: sentinels and rotations inside one byte buffer, and the way back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.words import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Plan:
    """Seed of the draws, and how many of a hundred texts are cut, and of those how many come suffix first."""

    seed: int = 7
    cut: int = 100
    suffix_first: int = 50

    def draws(self, key: str) -> list[int]:
        digest = sha256(f"{self.seed}:{key}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rotate(buffer: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the blocks begin..middle and middle..end in place: turn each round, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((begin, middle), (middle, end), (begin, end)):
        half = (b - a) // 2
        front, back = view[a : a + half], view[b - half : b][::-1]
        front[:], back[:] = back.copy(), front.copy()


def line_ends(body: bytes | bytearray) -> np.ndarray:
    """Places after each line; the last line may lack its end."""
    ends = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1
    return ends if not len(body) or body[-1] == 10 else np.append(ends, len(body))


def characters(buffer: bytes | bytearray, begin: int, end: int) -> int:
    """Code points between two places of UTF-8."""
    return int(np.count_nonzero(np.frombuffer(buffer, np.uint8)[begin:end] & 0xC0 != 0x80))


def to_middle(body: bytes, key: str, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, prefix_chars, middle_chars, output) of one text."""
    ends = line_ends(body)
    lines = len(ends)
    one, two, three, four = plan.draws(key)
    if not body or any(mark in body for mark in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= plan.cut:
        return lines, PLAIN, None, None, body
    low, high = sorted((one % (lines + 1), two % (lines + 1)))
    a, b = (int(ends[units - 1]) if units else 0 for units in (low, high))
    buffer = bytearray(body)
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    opened, closed = len(PREFIX) + a, len(PREFIX) + b + len(MIDDLE)  # where the second and third sentinels stand
    suffix_first = four % 100 < plan.suffix_first
    rotate(buffer, 0 if suffix_first else opened, closed, len(buffer))
    return lines, SPM if suffix_first else PSM, characters(body, 0, a), characters(body, a, b), bytes(buffer)


def from_middle(output: bytes, form: str) -> bytes:
    """The text that gave ``output``: the rotation undone, the sentinels taken out."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    suffix, middle = buffer.index(SUFFIX), buffer.index(MIDDLE)
    if form == PSM:
        rotate(buffer, suffix, middle, len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):  # from the back, so that the places before stay
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _cutter(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bodies = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            made = [to_middle(body, key or "", plan) for body, key in zip(bodies, batch.column("drawn").to_pylist())]
            lines, forms, heads, inner, outputs = zip(*made) if made else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(lines, pa.int64()), pa.array(forms, pa.string()),
                pa.array(heads, pa.int64()), pa.array(inner, pa.int64()), _texts(list(outputs)),
            ], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per document: ``key``, n, form, prefix_chars, middle_chars, output.

    A text of n lines (a line keeps its line feed) is cut after two numbers of
    lines drawn from the sha256 of the seed and the key; what stands between is
    the middle. The output shows prefix, suffix, middle (``psm``) or suffix, prefix,
    middle (``spm``), a sentinel before each. Empty texts, texts that hold a
    sentinel and those not drawn stay ``plain``, with null sizes. Null text is empty;
    a null key draws as the empty string; repeated rows give repeated results;
    further columns are ignored. A task holds a slice of texts and one buffer.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])
    rows = docs.select(F.col(key).alias("id"), F.col(key).cast("string").alias("drawn"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_cutter(plan), schema).withColumnRenamed("id", key)


def _restorer(position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            outputs = pc.fill_null(batch.column("output"), "").cast(pa.binary()).to_pylist()
            forms = batch.column("form").to_pylist()
            restored = _texts([from_middle(o, f or PLAIN) for o, f in zip(outputs, forms)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:position], restored], [*batch.schema.names[:position], "restored"])

    return run


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone.

    Null output is empty, null form plain; all other columns pass through.
    """
    kept = rows.drop("restored")
    schema = T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())])
    return kept.mapInArrow(_restorer(len(kept.columns)), schema)
