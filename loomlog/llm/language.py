"""Language by families first, then one-versus-one linear SVMs inside a family."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.running import uniform
from loomlog.llm.words import mix, slices, split_words
from loomlog.sources.tables import cut_lineage

FEATURES = 4096
PER_LANGUAGE, TAUGHT = 400, 3200  # sampled texts of a language, and of all together
SHORT = 5  # words of the short example that goes with each sampled text

# fixed values: families of ISO 639-1 codes; a language not listed is a family of its own
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "malayic": "id ms",
    "dravidian": "kn ml ta te",
}


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), lang)


def word_features(words: list[str], size: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of every hashed character 1-, 2- and 3-gram of the words, word ends included."""
    text = " " + " ".join(words).lower() + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = codes == 32
    owner = np.cumsum(gap) - 1
    one = np.flatnonzero(~gap)
    two = np.flatnonzero(~(gap[:-1] & gap[1:]))
    three = np.flatnonzero(~gap[1:-1])
    hashed = [
        mix(codes[one], 1), mix(codes[two] << np.uint64(21) | codes[two + 1], 2),
        mix(codes[three] << np.uint64(42) | codes[three + 1] << np.uint64(21) | codes[three + 2], 3),
    ]
    grams = np.concatenate(hashed) % np.uint64(size)
    return np.concatenate([owner[one], owner[two], owner[three]]), grams.astype(np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of whole sampled texts and of a short piece of each, as float32 bytes."""
    for batch in slices(batches, "text", 1 << 20):
        offsets, words = split_words(batch.column("text"), lower=False)
        owner, grams = word_features(words.dictionary.to_pylist())
        order = np.argsort(owner, kind="stable")
        grams, ends = grams[order], np.searchsorted(owner[order], np.arange(len(words.dictionary) + 1))
        at, langs, rows = words.indices.to_numpy(), batch.column("lang").to_pylist(), []
        for row, lang in enumerate(langs):
            mine = at[offsets[row] : offsets[row + 1]]
            begin = int(mix(np.array([len(mine)], np.uint64), row)[0] % np.uint64(max(1, len(mine) - SHORT)))
            for part in (mine, mine[begin : begin + SHORT]):
                if len(part):
                    found = np.concatenate([grams[ends[w] : ends[w + 1]] for w in part])
                    rows.append((lang, np.bincount(found, minlength=FEATURES).astype(np.float32).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "counts"])


def linear_svm(x: np.ndarray, sign: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (last one the offset) of a squared-hinge SVM, by accelerated full gradients.

    Both sides weigh the same whatever their number."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(x.dtype)
    v = np.random.default_rng(6).normal(size=x.shape[1]).astype(x.dtype)
    for _ in range(12):  # largest curvature, for the step
        v = x.T @ (share * (x @ v))
        norm = float(np.linalg.norm(v))
        v /= norm or 1.0
    rate = 1.0 / (2.2 * norm + penalty)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for step in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * x.T @ (share * sign * slack))
        ahead, w = new + (step / (step + 3.0)) * (new - w), new
    return w


def fit(langs: np.ndarray, counts: np.ndarray):
    """(weights, families, pairs): a column of weights per decision, offset last.

    ``families`` lists (name, its languages, column); ``pairs`` lists (first,
    second, column), the sign of which speaks for the first."""
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    scale = 1.0 / np.sqrt(share.mean(axis=0) + 1e-6)
    x = (share * scale).astype(np.float32)
    names = sorted(set(langs))
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(family_of(name), []).append(name)
    columns, families, pairs = [], [], []

    def train(rows: np.ndarray, positive: np.ndarray) -> int:
        w = linear_svm(x[rows], np.where(positive, 1.0, -1.0).astype(np.float32))
        columns.append(np.concatenate([w[:-1] * scale, w[-1:]]))
        return len(columns) - 1

    every = np.ones(len(langs), bool)
    for name, members in groups.items():
        families.append((name, members, train(every, np.isin(langs, members)) if len(groups) > 1 else None))
        for a, b in combinations(members, 2):
            rows = (langs == a) | (langs == b)
            pairs.append((a, b, train(rows, langs[rows] == a)))
    return np.array(columns, np.float64).reshape(len(columns), x.shape[1] + 1).T, families, pairs


def decide(margins: np.ndarray, families, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row of decision values: the best family, then the
    language with most pairs won in it, by the sum of margins where they tie."""
    squash = lambda m: 1.0 / (1.0 + np.exp(-np.clip(4.0 * m, -60, 60)))
    count = len(margins)
    by_family = np.column_stack([margins[:, c] if c is not None else np.zeros(count) for _, _, c in families])
    best = by_family.argmax(axis=1)
    rest = np.sort(by_family, axis=1)
    sure = squash((rest[:, -1] - rest[:, -2]) / 2) if len(families) > 1 else np.ones(count)
    lang, score = np.empty(count, object), np.zeros(count)
    for index, (_, members, _) in enumerate(families):
        rows = np.flatnonzero(best == index)
        votes = {m: np.zeros(len(rows)) for m in members}
        least = {m: np.full(len(rows), np.inf) for m in members}
        for a, b, c in pairs:
            if a in votes and b in votes:
                m = margins[rows, c]
                for name, side in ((a, m), (b, -m)):
                    votes[name] += (side > 0) + np.tanh(side) * 1e-3
                    least[name] = np.minimum(least[name], side)
        table = np.column_stack([votes[m] for m in members])
        won = table.argmax(axis=1)
        close = np.column_stack([least[m] for m in members])[np.arange(len(rows)), won]
        lang[rows] = np.array(members, object)[won]
        score[rows] = sure[rows] * np.where(np.isinf(close), 1.0, squash(close))
    return lang, score


def _predictor(model):
    weights, families, pairs = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            offsets, words = split_words(texts, lower=False)
            names, at = words.dictionary.to_pylist(), words.indices.to_numpy()
            owner, grams = word_features(names, len(weights) - 1)
            sums = lambda per_word: np.diff(np.concatenate([[0.0], np.cumsum(per_word[at])])[offsets])
            total = np.maximum(1.0, sums(np.bincount(owner, minlength=len(names)).astype(float)))
            margins = np.empty((batch.num_rows, weights.shape[1]))
            for c in range(weights.shape[1]):
                margins[:, c] = sums(np.bincount(owner, weights=weights[grams, c], minlength=len(names))) / total + weights[-1, c]
            lang, score = decide(margins, families, pairs)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            lang[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def held_out(key: str) -> Column:
    """Documents that teach nothing: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 6) -> DataFrame:
    """One row per document: ``key``, held_out, lang_pred, score.

    The model learns from about ``PER_LANGUAGE`` texts of each known language
    that are not held out, chosen by hash, and from about ``TAUGHT`` of all languages
    together; that bounds the rows that reach the driver, whatever the number of
    languages. A language that no family lists is a family of its own, and one
    language alone is predicted for every text with letters. Prediction reads whole texts and nothing else: sums
    of n-gram weights per word, computed once per distinct word. Texts that are
    null or have no letter are ``und`` with score 0, and so is everything when
    there is nothing to learn from. Rows with a null key, null language or
    repeated key are predicted like others; a null key teaches nothing.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(
        F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # written, so that a list of usual length is sent to the texts and one of any length can be merged with them
    sizes = cut_lineage(known.groupBy("lang").agg(F.count("*").alias("n")))
    share = min(float(PER_LANGUAGE), TAUGHT / max(1, sizes.count()))
    rates = sizes.select("lang", (F.lit(share) / F.col("n")).alias("rate"))
    chosen = known.join(rates, "lang").filter(uniform(seed, "id", F.xxhash64("text")) < F.col("rate")).select("lang", "text")
    taught = chosen.mapInArrow(_examples, "lang string, counts binary").toArrow()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    if taught.num_rows:
        counts = np.stack([np.frombuffer(c, np.float32) for c in taught["counts"].to_pylist()])
        model = fit(np.array(taught["lang"].to_pylist(), object), counts)
        found = rows.mapInArrow(_predictor(model), schema)
    else:
        found = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return found.select(F.col("id").alias(key), held_out("id").alias("held_out"), "lang_pred", "score")
