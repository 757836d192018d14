"""Token counts at every prefix: a dynamic programme over pieces, and the questions it answers."""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections import defaultdict
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.words import slices

SPACE = "▁"  # how the vocabulary writes a space
FREE = -1  # what stands left of a text's first piece, or a character no piece holds: it takes part in no merge
PAIRS, UNITS, UNIT_CHARS = 1_000_000, 200_000, 64  # entries that a worker process remembers; they change no result


class Prefixes:
    """Counts at every prefix of a unit of text, for a piece vocabulary with byte fallback.

    Merging pieces by rank has one property that makes this linear: a list of
    pieces is what the text encodes to exactly if every two neighbours encode to
    themselves. So the encoding of a prefix is that of a shorter one plus one
    piece, and that piece is the only one ending there that goes together with
    the last piece before it. The library judges pairs of pieces, never texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.model.get_piece_size()) if not (
            self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.names = {i: self.model.id_to_piece(i) for i in ids}
        self.tree: dict = {}  # letter by letter; "" holds the piece that ends there
        for i, name in self.names.items():
            node = self.tree
            for letter in name:
                node = node.setdefault(letter, {})
            node[""] = i
        if any("" not in node for node in self.tree.values()):
            raise ValueError("a character of the pieces is no piece itself")
        if any(self.model.normalize(t) != SPACE + t.replace(" ", SPACE) for t in ("a  b ", " Ａﬁ①\t\n ")):
            raise ValueError("the vocabulary changes its texts before encoding: prefixes of the text are not its prefixes")
        self.alone = "\n"  # in no piece: encodes to its byte, and nothing merges over it
        self.alone_id = self.model.piece_to_id("<0x0A>")
        words = not any(SPACE in name.lstrip(SPACE) for name in self.names.values())
        lines = not any("\n" in name for name in self.names.values())
        if not lines:
            raise ValueError("a piece of the vocabulary holds a line end")
        self.unit = re.compile(r" +[^ \n]*|\n|[^ \n]+" if words else r"\n|[^\n]+")
        self.pairs: dict[int, dict[int, bool]] = defaultdict(dict)
        self.judged = 0
        self.known: dict[str, bytes] = {}

    def _together(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side encode to themselves."""
        wanted = [right] if left == FREE else [left, right]
        text = self.alone + "".join([self.names[i] for i in wanted])
        answer = self.model.encode(text)[-len(wanted) - 1:] == [self.alone_id, *wanted]
        if self.judged >= PAIRS:
            self.pairs, self.judged = defaultdict(dict), 0
        self.pairs[left][right] = answer
        self.judged += 1
        return answer

    def counts(self, unit: str) -> list[int]:
        """Number of tokens of the first 0, 1, 2, ... characters of ``unit``, spaces written as the vocabulary does."""
        size = len(unit)
        count, last = [0] * (size + 1), [None] * (size + 1)
        last[0] = FREE
        first = self.tree.get
        for i, letter in enumerate(unit):
            left, total, j, node = last[i], count[i] + 1, i + 1, first(letter)
            if node is None:
                count[j], last[j] = count[i] + len(letter.encode()), FREE
                continue
            judged = self.pairs[left].get
            while True:
                if last[j] is None:
                    right = node.get("")
                    if right is not None:
                        fits = judged(right)
                        if fits or fits is None and self._together(left, right):
                            count[j], last[j] = total, right
                if j == size:
                    break
                node = node.get(unit[j])
                if node is None:
                    break
                j += 1
        return count

    def steps(self, unit: str) -> bytes:
        """How the count changes with each character of ``unit``, 4 bytes each; short units are remembered."""
        found = self.known.get(unit)
        if found is None:
            count = self.counts(unit.replace(" ", SPACE))
            found = array("i", map(sub, count[1:], count)).tobytes()
            if len(unit) <= UNIT_CHARS:
                if len(self.known) >= UNITS:
                    self.known.clear()
                self.known[unit] = found
        return found


def _prefixes(path: str) -> Prefixes:
    """The vocabulary and what was learnt about it, kept for the life of a worker process."""
    store = sys.modules.setdefault("_loomlog_prefixes", types.ModuleType("_loomlog_prefixes"))
    if not hasattr(store, path):
        setattr(store, path, Prefixes(path))
    return getattr(store, path)


def prefix_steps(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(edges, steps): the changes of the token count with each character of every text.

    Those of text i are ``steps[edges[i]:edges[i + 1]]``, one for each code point;
    their running sum is the count of tokens of each prefix. Null is empty.
    """
    made = _prefixes(path)
    bodies = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ").to_pylist()
    listed = [made.unit.findall(" " + body) if body else [] for body in bodies]
    flat = pa.array([unit for units in listed for unit in units], pa.string()).dictionary_encode()
    known = [made.steps(unit) for unit in flat.dictionary.to_pylist()]
    sizes = np.array([len(k) // 4 for k in known], np.int64)
    values = np.frombuffer(b"".join(known), np.int32)
    begins = np.cumsum(sizes) - sizes
    at = flat.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes[at])])
    steps = values[np.repeat(begins[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])]
    units = np.concatenate([[0], np.cumsum([len(u) for u in listed], dtype=np.int64)]).astype(np.int64)
    edges = ends[units]
    first = edges[:-1][np.diff(edges) > 0]  # the space that encoding puts before a text is no character of it
    steps[first + 1] += steps[first]
    keep = np.ones(len(steps), bool)
    keep[first] = False
    return np.concatenate([[0], np.cumsum(np.array([len(b) for b in bodies], np.int64))]), steps[keep]


def _stepper(path: str, key_type: pa.DataType):
    schema = pa.schema([
        ("id", key_type), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()),
        ("width", pa.int32()), ("steps", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            edges, steps = prefix_steps(texts, path)
            running = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
            most = np.abs(steps).max(initial=0)
            width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
            stream = steps.astype(f"<i{width}").tobytes()
            data = [stream[a * width : b * width] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            columns = [
                batch.column("id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), np.diff(edges),
                running[edges[1:]] - running[edges[:-1]], np.full(len(data), width, np.int32), data,
            ]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def write_prefix_counts(docs: DataFrame, path: str, model: str, key: str = "doc_id", text: str = "text") -> None:
    """Store the token count of every prefix of every text under ``path``.

    ``model`` is the file of a sentencepiece vocabulary of merged pieces with byte
    fallback; strings that look like special tokens are ordinary text, and no
    begin or end is added. One row per row of ``docs``: id, n_bytes (UTF-8), n_chars
    (code points), n_tokens, and ``steps``: by how much the count changes with each
    character, ``width`` bytes each, little-endian, signed (a count can fall: "t",
    "th", "the"). Null text is empty and has no steps; null and repeated keys and
    repeated rows stay rows of their own; other columns of ``docs`` are ignored; the
    empty table gives an empty one. A vocabulary that rewrites its texts raises.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("steps", T.BinaryType()),
    ])
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(_stepper(model, to_arrow_type(kind)), schema).write.mode("overwrite").parquet(path)


def read_prefix_counts(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; totals are read without the steps."""
    return spark.read.parquet(path)


def _answers(question: str, schema: pa.Schema):
    """Arrow mapper over stored rows with ``asked``: the answer from the running sum of the steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "steps"):
            out = []
            for asked, width, data in zip(*(batch.column(c).to_pylist() for c in ("asked", "width", "steps"))):
                counts = np.concatenate([[0], np.cumsum(np.frombuffer(data, f"<i{width}"), dtype=np.int64)])
                if asked is None:
                    out.append(None)
                elif question == "tokens":
                    out.append(int(counts[min(max(asked, 0), len(counts) - 1)]))
                else:
                    fits = np.flatnonzero(counts <= asked)
                    out.append(int(fits[-1]) if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asked"), pa.array(out, pa.int64())], schema=schema)

    return run


def _ask(rows: DataFrame, question: str, out: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([rows.schema["id"], T.StructField("asked", T.LongType()), T.StructField(out, T.LongType())])
    return rows.select("id", "asked", "width", "steps").mapInArrow(_answers(question, to_arrow_schema(schema)), schema)


def longest_prefixes(stored: DataFrame, budget: int) -> DataFrame:
    """(id, asked, n_chars): the longest prefix of each text of at most ``budget`` tokens.

    Longest means the last place at which the count is within the budget, even
    if a shorter prefix has more tokens. A budget below zero keeps nothing.
    """
    return _ask(stored.withColumn("asked", F.lit(budget).cast("long")), "chars", "n_chars")


def tokens_at(stored: DataFrame, places: DataFrame) -> DataFrame:
    """(id, asked, n_tokens): tokens of the first ``asked`` characters, for rows (id, asked) of ``places``.

    Places before the text count as 0, behind it as its end; a null place has a
    null answer; ids that are not stored, and null ids, have no row.
    """
    asked = places.select("id", F.col("asked").cast("long").alias("asked"))
    return _ask(stored.join(asked, "id"), "tokens", "n_tokens")
