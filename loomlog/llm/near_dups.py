"""Near copies: one-permutation MinHash, banded buckets, stars, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.running import numbered
from loomlog.llm.words import hash_dictionary, mix, shingle_hashes, slices, split_words
from loomlog.sources.tables import cut_lineage

BINS, ROWS = 128, 4  # 32 bands of 4 rows: a pair at similarity 0.8 misses all with probability 5e-8
SIGN_WORDS = 256  # most 64-bit words of a sign; a larger set has fewer bits a shingle, and the sign rules out less
DIRECT = 2048  # members of a bucket whose signs are compared pair by pair; more go by their differences from a centre
CROWDED = 64  # possible pairs for each member of such a bucket; with more it goes by differences, too
SIEVE_BITS = (16, 26)  # least and greatest size of the first filter; its fill follows from the number of sets


def _set_rows(offsets: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in rising order, and how many."""
    sets = [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return np.array([len(s) for s in sets], np.int64), flat


def _sums(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    edges = np.concatenate([[0], np.cumsum(lengths)])
    running = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return running[edges[1:]] - running[edges[:-1]]


def sketches(lengths: np.ndarray, flat: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation sketch (texts x bins): the least hash in each bin by leading bits.

    An empty bin copies a filled one: it asks the others in an order fixed per bin,
    the same for all texts, so two sets copy from the same place as often as they agree.
    """
    shift = np.uint64(64 - bins.bit_length() + 1)
    cell = np.repeat(np.arange(len(lengths)) * bins, lengths) + (flat >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out, filled = np.zeros(len(lengths) * bins, np.uint64), np.zeros(len(lengths) * bins, bool)
    out[cell[first]], filled[cell[first]] = flat[first], True
    asked = np.random.default_rng(7).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)
    gaps = np.flatnonzero(~filled & np.repeat(lengths > 0, bins))
    for turn in range(bins):
        if not len(gaps):
            break
        donor = gaps // bins * bins + asked[gaps % bins, turn]
        has = filled[donor]
        out[gaps[has]] = out[donor[has]]
        gaps = gaps[~has]
    return out.reshape(len(lengths), bins)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key per band."""
    bands = sketch.reshape(len(sketch), -1, rows)
    key = np.tile(np.arange(bands.shape[1], dtype=np.uint64), (len(sketch), 1))
    for r in range(rows):
        key = mix(key ^ bands[:, :, r], r + 1)
    return key


def parity_signs(lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, words): each shingle flips one of two to four bits a shingle, SIGN_WORDS words at the most.

    Two signs differ in no more bits than their sets in shingles. Of signs of two sizes
    the longer is folded: its halves xor to what half as many words would have held.
    """
    words = np.minimum(SIGN_WORDS, 1 << np.ceil(np.log2(np.maximum(1, lengths / 32))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(words * 64)])
    spots = mix(flat, 13) & np.repeat((words * 64 - 1).astype(np.uint64), lengths)
    flips = np.bincount(np.repeat(ends[:-1], lengths) + spots.astype(np.int64), minlength=int(ends[-1]))
    return words, np.packbits((flips & 1).astype(np.uint8), bitorder="little").view("<u8")


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.view(np.int64)))


def _describe(size: int, full: bool):
    """Arrow mapper: (id, text) -> id, n, c1, c2, the band keys and the sign, or the whole set if ``full``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, words = split_words(batch.column("text"))
            lengths, flat = _set_rows(*shingle_hashes(offsets, hash_dictionary(words), size))
            marks = [pa.array(_sums(lengths, mix(flat, seed)).view(np.int64)) for seed in (11, 12)]
            if full:
                last = _lists(lengths, flat)
            else:
                keys = band_keys(sketches(lengths, flat))
                last = _lists(np.where(lengths > 0, keys.shape[1], 0), keys[lengths > 0].ravel())
            columns = [batch.column("id"), pa.array(lengths), *marks, last]
            if not full:
                columns.append(_lists(*parity_signs(lengths, flat)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "c1", "c2", *(["shingles"] if full else ["bands", "sign"])])

    return run


def _described(docs: DataFrame, size: int, full: bool) -> DataFrame:
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()),
        *[T.StructField(name, T.ArrayType(T.LongType())) for name in (["shingles"] if full else ["bands", "sign"])],
    ])
    return docs.mapInArrow(_describe(size, full), schema)


def sieve(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``wanted``: a first filter before a join.

    The filter is a bit map with some sixteen bits for each wanted value, of 8 MB at
    the most; where that is too little for them, more rows pass, and none is lost.
    """
    low, high = SIEVE_BITS
    size = min(high, max(low, (16 * max(1, wanted.count())).bit_length()))
    spot = F.xxhash64(column).bitwiseAND(F.lit((1 << size) - 1))
    bits = wanted.select(spot.alias("_s")).groupBy(F.shiftright("_s", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_b")
    )
    words = df.sparkSession.range(1 << size - 6).join(bits, "id", "left").select(
        F.struct("id", F.coalesce("_b", F.lit(0)).alias("b")).alias("w")
    )
    table = words.groupBy().agg(F.sort_array(F.collect_list("w"))["b"].alias("_map"))
    test = F.expr("shiftright(element_at(_map, cast(shiftright(_s, 6) as int) + 1), cast(_s & 63 as int)) & 1L") == 1
    return df.withColumn("_s", spot).crossJoin(F.broadcast(table)).filter(test).drop("_s", "_map")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): the least node each is linked with.

    Every node points to its least neighbour, pointers are followed twice, and
    the edges between what they point to go into the next turn, until none is
    left. All of it stays in tables; a turn at least halves what is left.
    """
    turns, left = [], edges
    while turns == [] or not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a")).filter("a <> b")
        least = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select(
            "node", F.least("node", "up").alias("up")))
        jumped = least
        for _ in range(2):
            over = jumped.select(F.col("node").alias("n"), F.col("up").alias("u"))
            jumped = jumped.join(over, F.col("up") == F.col("n")).select("node", F.col("u").alias("up"))
        turns.append(cut_lineage(jumped))
        a = turns[-1].select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = turns[-1].select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = cut_lineage(left.join(a, "a").join(b, "b").filter("ua <> ub").select(
            F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    roots = turns[0].withColumnRenamed("up", "root")
    for later in turns[1:]:
        over = later.withColumnRenamed("node", "root")
        roots = roots.join(over, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut_lineage(roots)


def _similar(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets share ``percent`` of what they hold together."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(one, "a").join(two, "b").filter(both * 100 >= union * percent).select("a", "b")


def _pair(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _rooted(rows: DataFrame, roots: DataFrame | None, name: str = "node", out: str = "root") -> DataFrame:
    """``rows`` with the root of the component that the node belongs to so far."""
    if roots is None:
        return rows.withColumn(out, F.col(name))
    known = roots.select(F.col("node").alias(name), F.col("root").alias("_known"))
    return rows.join(known, name, "left").withColumn(out, F.coalesce("_known", name)).drop("_known")


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members, with their roots, of the buckets that still hold nodes of several components."""
    placed = _rooted(members.drop("root"), roots)
    if roots is not None:
        placed = cut_lineage(placed)
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"))
    mixed = cut_lineage(mixed.filter("low < high").select("key", "m"))
    return cut_lineage(placed.drop("m").join(mixed.hint("merge"), "key"))


class _Links:
    """Pairs that were compared, and the components that the confirmed links make.

    ``signs`` (node, sign) are looked at before the sets, see :func:`parity_signs`.
    """

    def __init__(self, sets: DataFrame, percent: int, signs: DataFrame | None = None):
        self.sets, self.percent, self.signs, self.tested, self.roots = sets, percent, signs, None, None

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb), each once, that their signs do not rule out, as (a, b)."""
        fresh = pairs.distinct()
        if self.signs is not None:
            for name in "ab":
                fresh = fresh.join(self.signs.select(F.col("node").alias(name), F.col("sign").alias("s" + name)), name)
            fresh = fresh.filter(_signs_allow("sa", "sb", F.col("na") + F.col("nb"), self.percent))
        return fresh.select("a", "b")

    def compare(self, pairs: DataFrame) -> None:
        """Compare the pairs (a, b) on their full sets, each pair once in a run."""
        fresh = pairs.distinct()
        if self.tested is not None:
            fresh = fresh.join(self.tested, ["a", "b"], "left_anti")
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            return
        links = cut_lineage(_similar(self.sets, fresh, self.percent))
        self.tested = fresh if self.tested is None else self.tested.union(fresh)
        if not links.isEmpty():
            self.roots = _joined(self.roots, links)


def _may_link(one: str, two: str, percent: int) -> Column:
    """Whether two sizes allow the sets to overlap enough."""
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def _signs_allow(one, two, sizes: Column, percent: int) -> Column:
    """Whether two signs allow an overlap of ``percent``: no more bits differ than shingles may,
    which are (100 - percent) / (100 + percent) of both sizes together."""
    one, two = (F.col(x) if isinstance(x, str) else x for x in (one, two))

    def bits(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)

    def folded(x, size):
        return F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))

    differ = F.when(F.size(one) == F.size(two), bits(one, two)).when(
        F.size(one) == 2 * F.size(two), bits(folded(one, F.size(two)), two)).when(
        F.size(two) == 2 * F.size(one), bits(one, folded(two, F.size(one)))).otherwise(0)
    return differ * (100 + percent) <= sizes * (100 - percent)


def _fold(signs: np.ndarray) -> np.ndarray:
    half = signs.shape[1] // 2
    return signs[:, :half] ^ signs[:, half:]


def _possible_pairs(node: np.ndarray, root: np.ndarray, n: np.ndarray, signs: list[np.ndarray], percent: int) -> np.ndarray:
    """(a, b) of one bucket, in components of their own, that sizes and signs allow to be linked."""
    words, found = np.array([len(x) for x in signs]), []
    for width in np.unique(words):
        here, twice = np.flatnonzero(words == width), np.flatnonzero(words == 2 * width)
        one = np.stack([signs[i] for i in here])
        other = np.concatenate([one, _fold(np.stack([signs[i] for i in twice]))]) if len(twice) else one
        there = np.concatenate([here, twice])
        step = max(1, (1 << 20) // other.size)
        for begin in range(0, len(here), step):
            rows = np.arange(begin, min(len(here), begin + step))
            differ = np.bitwise_count(one[rows, None] ^ other[None]).sum(axis=2, dtype=np.int64)
            x, y = n[here[rows]][:, None], n[there][None]
            ok = (differ * (100 + percent) <= (x + y) * (100 - percent)) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent)
            ok &= (root[here[rows]][:, None] != root[there][None]) & (rows[:, None] < np.arange(len(there))[None])
            i, j = np.nonzero(ok)
            found.append(np.stack([node[here[rows[i]]], node[there[j]]]))
    pairs = np.concatenate(found, axis=1)
    return np.stack([pairs.min(axis=0), pairs.max(axis=0)])


def _compare_buckets(percent: int, most: int):
    """Arrow mapper over members in order of their key: (key, a, b) of possible pairs, or (key, null, null) of a
    bucket that has more than ``most`` of them for each member."""
    names = ["key", "a", "b"]

    def bucket(key: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        node, root, n = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("node", "root", "n"))
        signs = []
        for p in parts:
            listed = p.column("sign")
            edges = listed.offsets.to_numpy()
            signs += np.split(listed.values.to_numpy()[edges[0] : edges[-1]].view(np.uint64), edges[1:-1] - edges[0])
        pairs = _possible_pairs(node, root, n, signs, percent)
        if pairs.shape[1] > most * len(node):
            return pa.RecordBatch.from_arrays([pa.array([key]), *[pa.array([None], pa.int64())] * 2], names)
        return pa.RecordBatch.from_arrays([pa.array(np.full(pairs.shape[1], key)), *map(pa.array, pairs)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else []
            for begin, end in zip(edges[:-1], edges[1:]):
                if held and keys[begin] != last:
                    yield bucket(last, held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = int(keys[begin])
        if held:
            yield bucket(last, held)

    return run


def _all_pairs(members: DataFrame, percent: int, signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of buckets of up to ``DIRECT`` members that sizes and signs allow
    to be linked, and the keys of buckets with so many that they are better split."""
    placed = members.join(signs, "node").select("key", "node", "root", "n", "sign")
    found = cut_lineage(placed.repartition("key").sortWithinPartitions("key").mapInArrow(
        _compare_buckets(percent, CROWDED), "key long, a long, b long"))
    return found.filter("a is not null").select("a", "b"), found.filter("a is null").select("key")


def _difference_buckets(groups: DataFrame, links: _Links) -> DataFrame:
    """Smaller buckets for the groups (c, node) around a centre: nodes that share a difference from it.

    Let D = 100 + percent, c the centre, o the overlap with it, and k = percent *
    |x| - D * o + 100 * |c|. Two nodes x and y are linked only if they share K =
    (k(x) + k(y) - (100 - percent) * |c|) / D or more of their differences from c,
    which are the shingles that x has and c has not, and the other way round. K is
    above zero unless both are linked with c. Differences that only nodes of one
    component have link no further pair; with the others in an order that all nodes agree
    on, the rarest first, a linked pair has a common one among the first
    |differences| - K + 1 of each (prefix filter). What most of a family has in
    common cancels out; what is left tells its close pairs apart, and no pair that
    may be linked is lost. Nodes of the centre's own component need to meet the
    others only.
    """
    percent, whole = links.percent, 100 + links.percent
    node = links.sets.select("node", F.col("shingles").alias("x"))
    centre = links.sets.select(F.col("node").alias("c"), F.col("shingles").alias("s"))
    rooted = _rooted(_rooted(groups, links.roots), links.roots, "c", "centre_root")
    met = cut_lineage(rooted.join(node, "node").join(centre, "c").select(
        "c", "node", "degree", "n", "root", (F.col("root") == F.col("centre_root")).alias("near"), F.size("s").cast("long").alias("size"),
        F.concat(F.array_except("x", "s"), F.array_except("s", "x")).alias("apart"),
        (percent * F.size("x") - whole * F.size(F.array_intersect("x", "s")) + 100 * F.size("s")).cast("long").alias("k")))
    least = met.groupBy("c").agg(
        F.min(F.when(~F.col("near"), F.col("k"))).alias("far_k"), F.min(F.when(F.col("near"), F.col("k"))).alias("near_k"))
    least = cut_lineage(least.filter("far_k is not null"))
    each = cut_lineage(met.join(least.select("c"), "c").select("c", "node", "root", F.explode("apart").alias("e")))
    seen = each.groupBy("c", "e").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    seen = seen.filter("low < high").select("c", "e", "df")
    # differences that nodes of several components have, the rarest first; no other can join two of them
    common = each.join(cut_lineage(seen), ["c", "e"]).groupBy("c", "node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("common"))
    rows = cut_lineage(met.join(least, "c").join(common, ["c", "node"]))

    def prefixes(which: Column, other: str, kind: int) -> DataFrame:
        shared = F.greatest(F.lit(1), F.ceil((F.col("k") + F.col(other) - (100 - percent) * F.col("size")) / whole).cast("int"))
        first = (F.size("common") - shared + 1).cast("int")
        chosen = rows.filter(which & F.col(other).isNotNull()).filter(first > 0)
        return chosen.select(
            F.explode(F.slice(F.col("common")["e"], F.lit(1), first)).alias("e"), "c", "node", "degree", "n", "near").select(
            F.xxhash64("c", "e", F.lit(kind)).alias("key"), F.lit(kind).alias("kind"), "node", "degree", "n", "near")

    near, far = F.col("near"), ~F.col("near")
    among = prefixes(far, "far_k", 0)
    across = prefixes(near, "far_k", 1).unionByName(prefixes(far, "near_k", 1))
    held = cut_lineage(among.unionByName(across).distinct())
    # buckets of the second kind are for pairs with a node of the centre's component
    kinds = held.groupBy("key").agg(
        F.max("kind").alias("kind"), F.max("near").alias("near"), F.min("near").alias("all_near"), F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"))
    useful = kinds.filter((F.col("m") > 1) & ~F.col("all_near") & ((F.col("kind") == 0) | F.col("near")))
    # of buckets with the same members, told by their number and 128 bits of their hashes, one is enough
    useful = useful.groupBy("m", "one", "two").agg(F.min("key").alias("key"))
    return held.drop("kind", "near").join(cut_lineage(useful.select("key")).hint("merge"), "key")


def _linked(members: DataFrame, sets: DataFrame, percent: int, signs: DataFrame) -> DataFrame | None:
    """(node, root) after every two nodes that share a bucket were compared or are in one component.

    ``members`` has key, node, degree and n, the size of the set. Each turn compares,
    in every bucket that still holds nodes of different components, all nodes with
    a centre, the node that shares buckets with most others: of copies that each
    differ from a common text in their own way it is the closest to that text.
    In buckets of up to ``DIRECT`` members that are not settled by that, signs are compared
    pair by pair, and sets where the signs allow a link, unless these are more than ``CROWDED``
    for each member. Other buckets are split into buckets of nodes that share a
    difference from the centre, see :func:`_difference_buckets`, which the next
    turn takes up. A bucket all of whose members have been around this centre before
    holds nothing new. It ends when no bucket is open; no number of turns, pairs or
    members is a limit.
    """
    links, around, left = _Links(sets, percent, signs), None, members
    while True:
        held = _open(left, links.roots)
        if held.isEmpty():
            return links.roots
        heads = cut_lineage(held.groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("node").alias("h"), "node", "n")).alias("c")).select(
            "key", F.col("c.node").alias("c"), F.col("c.n").alias("cn")))
        stars = held.join(heads, "key").filter("node <> c").filter(_may_link("n", "cn", percent))
        links.compare(links.possible(stars.select(
            *_pair("node", "c"), F.when(F.col("node") < F.col("c"), F.col("n")).otherwise(F.col("cn")).alias("na"),
            F.when(F.col("node") < F.col("c"), F.col("cn")).otherwise(F.col("n")).alias("nb"))))
        held = _open(held, links.roots)
        pairs, crowded = _all_pairs(held.filter(F.col("m").between(3, DIRECT)), percent, links.signs)
        links.compare(pairs)
        large = held.join(crowded, "key", "left_semi").union(held.filter(F.col("m") > DIRECT))
        if large.isEmpty():
            return links.roots
        grouped = large.join(heads.select("key", "c"), "key").filter("node <> c").select("key", "c", "node", "degree", "n")
        if around is not None:
            known = around.withColumn("_seen", F.lit(True))
            marked = cut_lineage(grouped.join(known, ["c", "node"], "left"))
            news = marked.filter("_seen is null").select("key").distinct()
            grouped = marked.drop("_seen").join(cut_lineage(news).hint("merge"), "key", "left_semi")
        groups = cut_lineage(grouped.select("c", "node", "degree", "n").distinct())
        if groups.isEmpty():
            return links.roots
        pairs = groups.select("c", "node")
        around = pairs if around is None else around.union(pairs).distinct()
        left = _difference_buckets(groups, links)


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after further links (a, b) between nodes."""
    if roots is None:
        return smallest_reachable(links)
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
    hops = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    over = smallest_reachable(cut_lineage(hops)).select(F.col("node").alias("old"), F.col("root").alias("new"))
    known = roots.join(over, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    extra = over.join(roots, over["old"] == roots["node"], "left_anti").select(
        F.col("old").alias("node"), F.col("new").alias("root"))
    return cut_lineage(known.union(extra))


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, kept.

    Documents are linked where their sets of ``size``-word shingles (words in
    lower case ASCII, cut at ASCII white space) overlap by ``percent`` or more of
    their union; component_id is the smallest key reachable and kept says that it
    is the document's own. Fewer words than ``size`` are one shingle; null or
    empty text has none and is linked with nothing. Null keys take part but are
    not kept. Equal sets, told by their size and a 128-bit sum of hashes, are one
    node, so copies make no pairs. Candidates meet in buckets of MinHash bands, where
    a pair at the threshold misses all with probability 5e-8; in a bucket of any
    size every link is found, see :func:`_linked`, and confirmed on the full sets,
    read again from the texts of the nodes that share a bucket. Repeated rows get
    equal results.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    marks = ["c1", "c2", "n"]
    digest = numbered(_described(rows, size, False))
    full = digest.filter("n > 0")
    nodes = cut_lineage(full.groupBy(*marks).agg(
        F.min("_row").alias("node"), F.min("id").alias("low"), F.first("bands").alias("bands"), F.first("sign").alias("sign")))
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = cut_lineage(buckets.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    met = cut_lineage(buckets.join(shared.hint("merge"), "key"))  # plain tables: a hot bucket can be split
    degrees = met.groupBy("node").agg(F.sum("m").alias("degree")).join(nodes.select("node", "n"), "node")
    members = cut_lineage(met.join(degrees, "node").select("key", "node", "degree", "n"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(*marks, "node")
    wanted = cut_lineage(wanted)
    signs = cut_lineage(nodes.select("node", "sign").join(wanted.select("node"), "node"))
    again = sieve(_described(rows, size, True), wanted, "c1")
    sets = again.dropDuplicates(marks).join(wanted, marks).select("node", "shingles")
    roots = _linked(members, cut_lineage(sets), percent, signs)
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    placed = nodes.select(*marks, "node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(placed.join(least, "root").select(*marks, "component_id", F.lit(True).alias("_known")))
    out = digest.select("id", *marks).join(named, marks, "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
