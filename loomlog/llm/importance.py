"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.running import numbered, running_totals, uniform
from loomlog.llm.words import mix, slices, split_words

BINS = 1 << 13  # few enough that no document, nor a group of copies, weighs much in its bins
SAMPLE = 20_000
LENGTH = 64  # default temperature: long texts weigh like texts of so many n-grams
REPEAT = 0x5EED


def ngram_bins(texts: pa.Array, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bins): hashed unigrams and bigrams of each text's tokens.

    Tokens are runs of word characters and runs of others between white space, in
    lower case. A token that repeats the one before it counts as the one n-gram
    "repeat" instead of a pair, so all repetition is one event of the model.
    """
    offsets, words = split_words(texts)
    found = [re.findall(r"\w+|[^\w\s]+", w.lower()) or [w] for w in words.dictionary.to_pylist()]
    sizes = np.array([len(f) for f in found], np.int64)
    tokens = [t for f in found for t in f]
    codes = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False) if tokens else np.empty(0, np.uint64)
    at = words.indices.to_numpy()
    begins, taken = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.concatenate([[0], np.cumsum(taken)])
    stream = codes[np.repeat(begins[at] - ends[:-1], taken) + np.arange(ends[-1])]
    edges = ends[offsets]  # of texts, in tokens
    pair = mix(np.concatenate([stream[:1], stream[:-1]]) ^ mix(stream, 1), 2)
    again = np.zeros(len(stream), bool)
    again[1:] = stream[1:] == stream[:-1]
    pair[again] = np.uint64(REPEAT)
    opens = np.zeros(len(stream), bool)
    opens[edges[:-1][np.diff(edges) > 0]] = True
    # unigram and bigram of a token side by side; the first token of a text has no bigram
    both = np.stack([mix(stream, 3), pair], axis=1).ravel()
    keep = np.stack([np.ones(len(stream), bool), ~opens], axis=1).ravel()
    counts = np.concatenate([[0], np.cumsum(keep)])
    return counts[edges * 2], (both[keep] % np.uint64(bins)).astype(np.int64)


def _counter(chosen: pa.Array, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for batch in slices(batches, "text"):
            offsets, grams = ngram_bins(batch.column("text"), bins)
            raw += np.bincount(grams, minlength=bins)
            mine = pc.is_in(batch.column("id"), value_set=chosen, skip_nulls=True).to_numpy(zero_copy_only=False)
            target += np.bincount(grams[np.repeat(mine, np.diff(offsets))], minlength=bins)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bin", "raw", "target"])

    return run


def fit_ratio(docs: DataFrame, chosen: pa.Array, key: str = "doc_id", text: str = "text", bins: int = BINS) -> np.ndarray:
    """Log ratio of both models in every bin: raw counts of all documents, target
    counts of those whose key is among ``chosen``.

    The ratio of the target count to the count that the raw model expects is drawn
    towards 1 by five more of each. The model has ``bins`` numbers, whatever the input.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(chosen, bins), "bin long, raw long, target long")
    model = counts.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    ratio = np.zeros(bins, np.float32)
    if len(model) and model.target.sum():
        expected = model.raw.to_numpy() * (model.target.sum() / model.raw.sum())
        ratio[model.bin.to_numpy()] = np.log((model.target.to_numpy() + 5.0) / (expected + 5.0))
    return ratio


def _scorer(ratio: np.ndarray, carried: list[str], text: str, temper: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            offsets, grams = ngram_bins(batch.column(text), len(ratio))
            sums = np.concatenate([[0.0], np.cumsum(ratio[grams], dtype=np.float64)])
            weight = sums[offsets[1:]] - sums[offsets[:-1]]
            if temper is not None:
                weight = weight * (temper / np.maximum(temper, np.diff(offsets)))
            columns = [*(batch.column(c) for c in carried), pa.array(np.diff(offsets)), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "_n_grams", "_log_weight"])

    return run


def expected_good(rows: DataFrame, labels: DataFrame, key: str) -> int | None:
    """How many documents are of quality, judged by the labelled ones of about the same weight.

    Weights fall into unit steps between -50 and 50; each step counts its documents
    with the share of quality 1 among its labelled ones, a step without any with
    that of the nearest step that has some. None if nothing is labelled.
    """
    step = F.greatest(F.lit(-50), F.least(F.lit(50), F.floor("_log_weight"))).alias("step")
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").cast(rows.schema[key].dataType).alias("_id")).agg(
        F.max("quality").alias("_quality"))
    judged = rows.filter("_n_grams > 0").join(marks, F.col(key) == F.col("_id"), "left")
    steps = judged.groupBy(step).agg(
        F.count("*").alias("n"), F.count("_quality").alias("known"), F.count_if(F.col("_quality") == 1).alias("good")).collect()
    known = [s for s in steps if s.known]
    if not known:
        return None
    nearest = {s.step: min(known, key=lambda k: (abs(k.step - s.step), k.step)) for s in steps}
    return round(sum(s.n * nearest[s.step].good / nearest[s.step].known for s in steps))


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", carried: list[str] | None = None,
    sample: int = SAMPLE, k: int | None = None, temper: int | None = LENGTH, seed: int = 5,
) -> DataFrame:
    """Columns ``carried`` (all of ``docs`` by default) with _n_grams, _log_weight, _key and _kept.

    The target model is fitted on at most ``sample`` documents labelled quality 1
    and not toxic, those with the smallest hashes of their id; the raw model on
    all documents. A document's weight is the log of the ratio of its likelihoods. The
    k largest keys, weight plus Gumbel noise, stay: a draw of ``k`` without
    replacement in proportion to the ratios, another one with another ``seed``.

    ``temper`` is the temperature: a text of n n-grams, more than that, has its log
    ratio divided by n / ``temper``, so that long texts compete like texts of that
    length; None takes the ratios as they are, and the longest texts decide. Without
    ``k`` it is the number of documents of quality that the labels make one
    expect at the weights there are, see :func:`expected_good`; where nothing is
    labelled, all. A text without words has weight 0 and is not kept. Keys
    may be of any type; null keys are no target. Rows come back as they were, nulls and
    repeated rows included; equal rows have equal keys and may be split only at
    the last place.
    """
    kind = docs.schema[key].dataType
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast(kind).alias("id"))
    picked = good.filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = picked.toArrow()["id"].combine_chunks()
    ratio = fit_ratio(docs, chosen, key, text)
    carried = docs.columns if carried is None else carried
    through = list(dict.fromkeys([*carried, key]))
    schema = T.StructType([
        *(docs.schema[c] for c in through), T.StructField("_n_grams", T.LongType()), T.StructField("_log_weight", T.DoubleType()),
    ])
    noise = -F.log(-F.log(uniform(seed, key, "_n_grams") + 2.0**-54))
    scored = docs.select(*dict.fromkeys([*through, text])).mapInArrow(_scorer(ratio, through, text, temper), schema)
    rows = numbered(scored.withColumn("_key", F.when(F.col("_n_grams") > 0, F.col("_log_weight") + noise)))
    keys = rows.filter("_key is not null").select("_key", "_row", F.lit(1).cast("long").alias("_one"))
    if k is None:
        k = expected_good(rows, labels, key)
    if k is None:
        kept = F.col("_key").isNotNull()
    else:
        ranked = running_totals(keys, [], [F.col("_key").desc()], "_one", "_rank")
        last = ranked.filter(F.col("_rank") <= k - 1).agg(F.max(F.struct("_rank", "_key", "_row")).alias("last")).first().last
        kept = F.lit(False)
        if last is not None:
            above = (F.col("_key") > last._key) | ((F.col("_key") == last._key) & (F.col("_row") <= last._row))
            kept = F.coalesce(above, F.lit(False))
    return rows.withColumn("_kept", kept).select(*carried, "_n_grams", "_log_weight", "_key", "_kept")
