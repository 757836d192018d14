"""Masked pseudo-likelihood: a two-sided window network in numpy scores every token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.words import hash_dictionary, mix, slices, split_words

CLASSES, INSIDE, WIDTH = 32, 32, 16
TOKENS = CLASSES * INSIDE  # hashed words; number TOKENS stands for "outside the text"
SIDES = (-2, -1, 1, 2)
SHAPES = {"embed": (len(SIDES), TOKENS + 1, WIDTH), "bias": (WIDTH,), "top": (WIDTH + 1, CLASSES),
          "low": (CLASSES, WIDTH + 1, INSIDE)}
BATCH = 1 << 14
PLACES = 1 << 18  # tokens whose surroundings are held at once


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, tokens) of whole texts: words in lower case, hashed to TOKENS numbers."""
    offsets, words = split_words(texts)
    return offsets, (mix(hash_dictionary(words), 8) % np.uint64(TOKENS)).astype(np.int64)


def contexts(offsets: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens around the places ``at`` (places x sides), never across the ends of a text."""
    text = np.searchsorted(offsets, at, "right") - 1
    first, end = offsets[text], offsets[text + 1]
    out = np.full((len(at), len(SIDES)), TOKENS)
    for i, step in enumerate(SIDES):
        there = at + step
        ok = (there >= first) & (there < end)
        out[ok, i] = tokens[there[ok]]
    return out


def start_model() -> dict[str, np.ndarray]:
    """The same small random start for every task."""
    rng = np.random.default_rng(8)
    return {n: (rng.normal(size=s) * (0.1 if n == "embed" else 0.05)).astype(np.float32) for n, s in SHAPES.items()}


def _normal(logits: np.ndarray) -> np.ndarray:
    """Log-probabilities from logits, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def _hidden(model: dict, around: np.ndarray) -> np.ndarray:
    total = np.tile(model["bias"], (len(around), 1))
    for i in range(len(SIDES)):
        total += model["embed"][i][around[:, i]]
    return np.hstack([np.tanh(total), np.ones((len(around), 1), np.float32)])


def log_probabilities(model: dict, around: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Log-probability of each token given both sides: of its class, then of it in the class."""
    out = np.empty(len(tokens), np.float64)
    for begin in range(0, len(tokens), BATCH):
        part = slice(begin, begin + BATCH)
        h, want = _hidden(model, around[part]), tokens[part]
        kind, inner = np.divmod(want, INSIDE)
        got = _normal(h @ model["top"])[np.arange(len(want)), kind].astype(np.float64)
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(ends)):
            rows = order[ends[c] : ends[c + 1]]
            got[rows] += _normal(h[rows] @ model["low"][c])[np.arange(len(rows)), inner[rows]]
        out[part] = got
    return out


def train_step(model: dict, memory: dict, around: np.ndarray, tokens: np.ndarray, rate: float = 0.1) -> None:
    """One Adagrad step on the masked tokens of a batch."""
    h = _hidden(model, around)
    kind, inner = np.divmod(tokens, INSIDE)
    error = np.exp(_normal(h @ model["top"]))
    error[np.arange(len(tokens)), kind] -= 1
    grad = {"top": h.T @ error, "low": np.zeros(SHAPES["low"], np.float32), "embed": np.empty(SHAPES["embed"], np.float32)}
    back = error @ model["top"].T
    order = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(ends)):
        rows = order[ends[c] : ends[c + 1]]
        error = np.exp(_normal(h[rows] @ model["low"][c]))
        error[np.arange(len(rows)), inner[rows]] -= 1
        grad["low"][c] = h[rows].T @ error
        back[rows] += error @ model["low"][c].T
    back = back[:, :-1] * (1 - h[:, :-1] ** 2)
    grad["bias"] = back.sum(axis=0)
    for i in range(len(SIDES)):
        for d in range(WIDTH):
            grad["embed"][i, :, d] = np.bincount(around[:, i], back[:, d], TOKENS + 1)
    for name, g in grad.items():
        g = g / np.float32(len(tokens))
        memory[name] += g * g
        model[name] -= rate * g / np.sqrt(memory[name] + 1e-8)


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains on every token of every text of the task, each masked once; returns (place in the model, value, weight)."""
    model = start_model()
    memory = {n: np.full(s, 1e-6, np.float32) for n, s in SHAPES.items()}
    held, seen = [], 0
    for batch in slices(batches, "text"):
        offsets, tokens = token_stream(batch.column("text"))
        for first in range(0, len(tokens), PLACES):
            at = np.arange(first, min(len(tokens), first + PLACES))
            held.append((contexts(offsets, tokens, at), tokens[at]))
            if sum(len(t) for _, t in held) >= BATCH:
                around, want = np.concatenate([a for a, _ in held]), np.concatenate([t for _, t in held])
                shuffled = np.random.default_rng(len(want)).permutation(len(want))
                for begin in range(0, len(want), BATCH // 4):
                    rows = shuffled[begin : begin + BATCH // 4]
                    train_step(model, memory, around[rows], want[rows])
                seen, held = seen + len(want), []
    for around, want in held:
        if len(want):
            train_step(model, memory, around, want)
            seen += len(want)
    if seen:
        flat = np.concatenate([model[n].ravel() for n in SHAPES]).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))], ["place", "value", "seen"])


def train(docs: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """The mean of the models that the tasks train from one start, weighted by tokens.

    Every document takes part with all its tokens, each masked in its turn and
    predicted from its neighbours. The models are averaged by a grouping over their numbers, so what moves
    grows with the corpus and the result has the size of one model.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"))
    parts = rows.mapInArrow(_trainer, "place long, value double, seen long")
    mean = parts.groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas()
    if not len(mean):
        return start_model()
    flat = np.zeros(len(mean), np.float32)
    flat[mean.place.to_numpy()] = mean.value.to_numpy()
    sizes = [int(np.prod(s)) for s in SHAPES.values()]
    pieces = np.split(flat, np.cumsum(sizes)[:-1])
    return {n: p.reshape(s) for (n, s), p in zip(SHAPES.items(), pieces)}


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, tokens = token_stream(batch.column("text"))
            found = np.empty(len(tokens))
            for begin in range(0, len(tokens), PLACES):
                at = np.arange(begin, min(len(tokens), begin + PLACES))
                found[at] = log_probabilities(model, contexts(offsets, tokens, at), tokens[at])
            sums = np.concatenate([[0.0], np.cumsum(found)])
            total = sums[offsets[1:]] - sums[offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(total)], ["id", "n_tokens", "log_likelihood"])

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """One row per document: ``key``, n_tokens, log_likelihood, mean_log_likelihood.

    Tokens are words between ASCII white space, hashed to 1,024 numbers; each is
    predicted from the two words on either side, and the log-probabilities of all
    tokens of the whole text are summed. Null, empty and blank texts have no
    token, sum 0 and a null mean. Without ``model`` one is trained on ``docs``.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("log_likelihood", T.DoubleType())])
    scored = rows.mapInArrow(_scorer(train(docs, text) if model is None else model), schema)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select(F.col("id").alias(key), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
