"""Token ids in fixed-width packed blocks: writing in key order, reading, random access."""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomlog.llm.words import slices

BLOCK_TOKENS = 1 << 17
LANES = 64
TOGETHER = 512  # pieces that are encoded as one text
REMEMBERED = 400_000  # pieces that a worker process keeps; they change no result


def id_bits(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one little-endian bit stream, ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.zeros((-(-len(ids) // LANES), LANES), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint64)  # 64 ids fill ``bits`` words exactly
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()[: (len(ids) * bits + 7) // 8]


def unpack_ids(data: bytes, count: int, bits: int, start: int = 0) -> np.ndarray:
    """``count`` ids from place ``start`` of a packed stream, as uint32; reads only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    begin = start // 8 * 8
    need = start - begin + count
    rows = -(-need // LANES)
    raw = data[begin * bits // 8 : (begin + need) * bits // 8 + 1].ljust(rows * bits * 8, b"\0")
    words = np.frombuffer(raw, "<u8", rows * bits).reshape(rows, bits)
    out = np.empty((rows, LANES), np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        out[:, lane] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, lane] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out.ravel()[start - begin : need] & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _cut_table() -> np.ndarray:
    """Kinds of two neighbouring bytes between which every text can be cut, as a flat table."""
    out = np.zeros((KINDS, KINDS), bool)
    for left in (LETTER, DIGIT, MARK):
        for right in (LETTER, DIGIT, MARK, QUOTE):
            out[left, right] = left != right and (left, right) != (MARK, QUOTE)
    out[[LETTER, DIGIT, MARK, QUOTE, OTHER], WHITE] = True
    return out.ravel()


def _kind_table() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)  # control characters
    out[0x21:0x7F] = MARK
    out[[*range(65, 91), *range(97, 123)]] = LETTER
    out[48:58], out[39] = DIGIT, QUOTE
    out[[9, 10, 11, 12, 13, 32]] = WHITE
    out[128:] = OTHER
    return out


def _white_ends() -> np.ndarray:
    """Last two bytes that white space outside ASCII can have, first times 256 plus second."""
    out = np.zeros(1 << 16, bool)
    spaces = [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    for code in (chr(c).encode() for c in spaces):
        out[code[-2] * 256 + code[-1]] = True
    return out


LETTER, DIGIT, MARK, QUOTE, WHITE, OTHER, ODD, KINDS = range(8)  # those before WHITE are visible ASCII or letters
KIND, CUT, WHITE_END = _kind_table(), _cut_table(), _white_ends()


def _cuts_before(data: np.ndarray) -> np.ndarray:
    """Where a byte-level tokenizer always starts a new word, whatever stands around: flags by byte.

    Words are runs of letters, of digits or of other marks, with a space before them, and white
    space; an apostrophe may take letters after it. So runs of different kinds part, and white space
    parts from what stands before it. Nothing is cut inside white space, after an
    apostrophe or next to characters whose kind is not known from their bytes.
    """
    kinds = KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xD1))  # of two bytes; all of these are letters but two
    lead = lead[np.isin(data[lead], [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])]
    lead = lead[(data[lead] != 0xC3) | ~np.isin(data[lead + 1], [0x97, 0xB7])]
    kinds[lead] = kinds[lead + 1] = LETTER
    out = np.zeros(len(data), bool)
    out[1:] = CUT[kinds[:-1] * np.uint8(KINDS) + kinds[1:]]
    high = np.flatnonzero(out[1:] & (kinds[:-1] == OTHER)) + 1
    out[high[WHITE_END[data[high - 2].astype(np.int64) * 256 + data[high - 1]]]] = False
    return out


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a text or binary column without nulls."""
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _rows(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Encoder:
    """A tokenizer and the ids of the pieces it has met, in flat columns."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        #: strings that the tokenizer takes out of a text before it looks for words
        self.added = [t.content for t in self.made.get_added_tokens_decoder().values()]
        split, model = said.get("pre_tokenizer") or {}, said["model"]
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and split.get("add_prefix_space") is False
            and not any(said.get(k) for k in ("normalizer", "truncation", "padding")) and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        #: bytes of each id's token: a byte-level token has a character for each
        self.widths = np.zeros(max(self.made.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
        for token, number in self.made.get_vocab(with_added_tokens=False).items():
            self.widths[number] = len(token)
        self.forget()

    def forget(self) -> None:
        self.pieces, self.ids = (pa.array([], pa.large_binary()) for _ in range(2))

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.array(c.ids, np.uint32) for c in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(c) for c in coded], np.int64), np.concatenate([*coded, np.empty(0, np.uint32)])

    def _together(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of pieces that a text can be cut into, encoded as that text.

        The bytes of the tokens tell which are whose. Where they do not fall on the
        pieces' ends, or the text has an added token, each piece is encoded alone.
        """
        text = data.tobytes().decode()
        if not any(a in text for a in self.added):
            ids = np.array(self.made.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.concatenate([[0], np.cumsum(self.widths[ids])])
            places = np.searchsorted(stops, offsets)
            if stops[-1] == len(data) and (stops[places] == offsets).all():
                return np.diff(places), ids
        return self._apart([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])

    def learn(self, new: pa.Array) -> np.ndarray:
        """Encode new pieces, those that can stand behind each other many in one text; returns their places.

        These end where white space can follow and begin with white space, or get a new line, which
        is a word of its own before anything else, and whose id is taken out again.
        """
        offsets, data = _flat(new)
        first, last = KIND[data[offsets[:-1]]], offsets[1:] - 1
        high = WHITE_END[data[np.maximum(last - 1, 0)].astype(np.int64) * 256 + data[last]] & (data[last] >= 128)
        after = CUT[KIND[data[last]] * np.uint8(KINDS) + np.uint8(WHITE)] & ~high & (first <= WHITE)
        group = np.where(after, first < WHITE, 2)
        spaced, led, alone = (new.filter(pa.array(group == g)) for g in range(3))
        sizes, ids = [], []
        for some, lead in ((spaced, b""), (led, b"\n")):
            offsets, data = _flat(pc.binary_join_element_wise(pa.scalar(lead, pa.large_binary()), some, pa.scalar(b"", pa.large_binary())))
            for begin in range(0, len(some), TOGETHER):
                edges = offsets[begin : begin + TOGETHER + 1]
                counts, coded = self._together(edges - edges[0], data[edges[0] : edges[-1]])
                sizes.append(counts - len(lead))
                ids.append(np.delete(coded, np.cumsum(counts) - counts) if lead else coded)
        counts, coded = self._apart([p.decode() for p in alone.to_pylist()])
        stops = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, counts]))]) * 4
        places = np.empty(len(new), np.int64)
        places[np.argsort(group, kind="stable")] = np.arange(len(self.pieces), len(self.pieces) + len(new))
        self.pieces = pa.concat_arrays([self.pieces, spaced, led, alone])
        self.ids = pa.concat_arrays([self.ids, _rows(stops, np.concatenate([*ids, coded]))])
        return places

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Place of every piece; unknown ones are encoded first."""
        found = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()
        missing = found < 0
        if missing.any():
            found = found.astype(np.int64)
            found[missing] = self.learn(pieces.filter(pa.array(missing)))
        return found


def _encoder(path: str) -> _Encoder:
    """Kept for the life of a worker process."""
    store = sys.modules.setdefault("_loomlog_encoders", types.ModuleType("_loomlog_encoders"))
    if not hasattr(store, path):
        setattr(store, path, _Encoder(path))
    return getattr(store, path)


def encode_texts(texts: pa.Array, path: str, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of whole texts as the tokenizer's own settings give them; null is empty.

    A byte-level tokenizer encodes every word by itself, so a text is cut where a
    word always starts, and a piece is encoded once and then remembered, until
    more than ``remembered`` are; then all are forgotten. A text with an added token is
    encoded in one go, and so are all if the tokenizer is not a plain byte-level one.
    """
    coder = _encoder(path)
    if len(coder.pieces) > remembered:
        coder.forget()
    texts = pc.fill_null(texts, "")
    whole = np.full(len(texts), not coder.cuts)
    for content in coder.added:
        whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
    offsets, data = _flat(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
    starts = _cuts_before(data)
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.append(np.flatnonzero(starts), len(data))
    pieces = _rows(starts, data).dictionary_encode()
    known = coder.numbers(pieces.dictionary)
    stops, flat = _flat(coder.ids.take(pa.array(known[pieces.indices.to_numpy()])))
    ids, stops = flat.view(np.uint32), stops // 4
    lengths = np.diff(stops[np.searchsorted(starts, offsets)])
    if whole.any():
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        sizes, coded = coder._apart(texts.filter(pa.array(whole)).to_pylist())
        for row, some in zip(np.flatnonzero(whole), np.split(coded, np.cumsum(sizes)[:-1])):
            parts[row] = some
        lengths[whole] = sizes
        ids = np.concatenate([*parts, np.empty(0, np.uint32)])
    return lengths, ids


def _block(part: int, number: int, keys: list, lengths: list, ids: list, bits: int, schema: pa.Schema) -> pa.RecordBatch:
    stream = np.concatenate(ids)
    if int(stream.max()) >> bits:
        raise ValueError(f"the tokenizer gave id {int(stream.max())}, which {bits} bits do not hold")
    sizes = np.concatenate(lengths)
    columns = [[part], [number], [[k for some in keys for k in some]], [sizes], [len(stream)], [bits], [pack_ids(stream, bits)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _packer(path: str, end_id: int, bits: int, key_type: pa.DataType, block_tokens: int):
    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.list_(key_type)), ("lengths", pa.list_(pa.int64())),
        ("n_tokens", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        keys, lengths, ids, held = [], [], [], 0
        for batch in slices(batches, "text"):
            sizes, stream = encode_texts(batch.column("text"), path)
            stream = np.insert(stream, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            stops, names, row = np.cumsum(sizes), batch.column("id").to_pylist(), 0
            while row < len(names):  # up to the document that fills the block
                base = int(stops[row - 1]) if row else 0
                upto = min(len(names), int(np.searchsorted(stops, base + block_tokens - held)) + 1)
                keys.append(names[row:upto])
                lengths.append(sizes[row:upto])
                ids.append(stream[base : int(stops[upto - 1])])
                held += len(ids[-1])
                row = upto
                if held >= block_tokens:
                    yield _block(part, number, keys, lengths, ids, bits, schema)
                    number, keys, lengths, ids, held = number + 1, [], [], [], 0
        if held:
            yield _block(part, number, keys, lengths, ids, bits, schema)

    return run


def vocabulary_size(tokenizer: str) -> int:
    """One more than the greatest id the tokenizer can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int | None = None, end_id: int = 0, key: str = "doc_id",
    text: str = "text", block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode ``text`` and write packed blocks under ``path``, documents in ascending key order.

    ``vocabulary`` is the tokenizer's own unless it is given; an id that does not
    fit raises. Strings of special tokens inside a text are taken as the tokenizer
    takes them by default.

    ``path/blocks`` holds rows of part, block, the keys and token counts of whole
    documents, and their ids at the fewest bits the vocabulary needs; a block ends
    with the document that fills ``block_tokens``. ``path/starts`` has the number
    of ids before each block. Null text is an empty document (the end id alone),
    null keys come last, equal keys in order of their texts' hash. Documents are
    sorted by a range partition on the key, so any part of the files is a run of keys.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("keys", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.LongType()), T.StructField("bits", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["id", "_tie", "_row"]
    keyed = rows.withColumns({n: c for n, c in zip(names[1:], order[1:])})
    sort = [order[0], F.col("_tie"), F.col("_row")]
    run = _packer(tokenizer, end_id, id_bits(vocabulary or vocabulary_size(tokenizer)), to_arrow_type(kind), block_tokens)
    placed = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).select("id", "text")
    placed.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.schema(schema).parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts.select("part", "block", (F.col("base") + F.col("before")).alias("start"), "n_tokens").write.mode(
        "overwrite").parquet(f"{path}/starts")


def _unpacker(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, keys, lengths, count, bits, data = (c[row].as_py() for c in batch.columns)
                ids = unpack_ids(data, count, bits).astype("<u4")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e]) for n, e in zip(lengths, ends.tolist())]
                columns = [keys, [part] * len(keys), [block] * len(keys), (ends - lengths).tolist(), lengths, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the checksum covers its
    ids, end id included, as little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "keys", "lengths", "n_tokens", "bits", "payload")
    kind = blocks.schema["keys"].dataType.elementType
    fields = [("id", kind), ("part", T.IntegerType()), ("block", T.LongType()), ("at", T.LongType()),
              ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = blocks.mapInArrow(_unpacker(to_arrow_schema(schema)), schema)
    starts = spark.read.parquet(f"{path}/starts").select("part", "block", F.col("start").alias("base"))
    return rows.join(starts, ["part", "block"]).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _ranger(start: int, count: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, size, bits, data = (batch.column(c)[row].as_py() for c in ("start", "n_tokens", "bits", "payload"))
                first, last = max(start - base, 0), min(start + count - base, size)
                ids = unpack_ids(data, last - first, bits, first)
                yield pa.RecordBatch.from_arrays([pa.array([base + first]), pa.array([ids.tolist()], pa.list_(pa.int64()))], schema=schema)

    return run


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """(start, ids): the ids from place ``start`` of the whole stream, ``count`` of them, in pieces by block.

    The table of block starts tells which blocks are needed; only their rows are
    looked up, and of each only the bytes between its first and last id asked for
    are unpacked. Places outside the stream have no ids.
    """
    starts = spark.read.parquet(f"{path}/starts").filter((F.col("start") < start + count) & (F.col("start") + F.col("n_tokens") > start))
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "bits", "payload")
    bounds = starts.agg(F.min("part").alias("a"), F.max("part").alias("b")).first()
    if bounds.a is None:
        return spark.createDataFrame([], "start long, ids array<long>")
    near = blocks.filter(F.col("part").between(bounds.a, bounds.b))  # reaches the files
    schema = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return near.join(starts, ["part", "block"]).select("start", "n_tokens", "bits", "payload").mapInArrow(
        _ranger(start, count, schema), "start long, ids array<long>")


def read_document(spark: SparkSession, path: str, key) -> DataFrame:
    """(start, ids) of the documents with this key, end id included, found by the keys of the blocks."""
    blocks = spark.read.parquet(f"{path}/blocks").filter(F.array_contains("keys", F.lit(key)))
    starts = spark.read.parquet(f"{path}/starts").select("part", "block", "start")
    rows = blocks.join(starts, ["part", "block"]).select("start", "keys", "lengths", "bits", "payload")
    schema = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, keys, lengths, bits, data = (c[row].as_py() for c in batch.columns)
                ends = np.cumsum(lengths).tolist()
                for name, size, end in zip(keys, lengths, ends):
                    if name == key:
                        ids = unpack_ids(data, size, bits, end - size)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([base + end - size]), pa.array([ids.tolist()], pa.list_(pa.int64()))], schema=schema)

    return rows.mapInArrow(run, "start long, ids array<long>")
