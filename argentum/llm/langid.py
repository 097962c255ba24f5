"""Language identification by a byte convolutional network, in numpy.

A text is cut into windows of ``WINDOW`` bytes of its lower-case UTF-8, the last one
filled with zero bytes.  Each byte has a learned vector; filters of several widths
slide over a window, each keeps its largest answer, and a softmax layer turns these
into languages.  A text's scores are the normalised geometric mean of its windows'.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.llm import textops
from argentum.llm.common import small_batches

WINDOW = 128
EMBED, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
#: Labelled texts from which the network learns, on average, shared evenly among languages, one of each at least.
SAMPLE = 3200
#: Windows of one text from which the network learns, at most, drawn from the whole text.
PER_TEXT = 256
STEPS, BATCH = 900, 64
#: Windows that one pass over the network holds.
SLICE = 256
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]  # (width * EMBED, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, *self.biases, self.dense, self.dense_bias]

    def forward(self, windows: np.ndarray, keep: bool = False):
        """Log-probabilities of windows (n, WINDOW); with what backward needs if keep."""
        x = self.embed[windows]
        pooled, kept = [], []
        for kernel, bias, width in zip(self.kernels, self.biases, WIDTHS):
            columns = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2)
            columns = columns.reshape(len(x) * (WINDOW - width + 1), width * EMBED)
            answer = (columns @ kernel).reshape(len(x), WINDOW - width + 1, FILTERS)
            if keep:
                kept.append((columns, answer.argmax(1)))
            pooled.append(np.maximum(answer.max(1) + bias, 0))
        features = np.concatenate(pooled, 1)
        logits = features @ self.dense + self.dense_bias
        logits -= logits.max(1, keepdims=True)
        out = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return (out, features, kept) if keep else out

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of ``parameters``."""
        out, features, kept = self.forward(windows, keep=True)
        n = len(windows)
        delta = np.exp(out)
        delta[np.arange(n), labels] -= 1
        delta /= n
        back = (delta @ self.dense.T) * (features > 0)
        embed, kernels, biases = np.zeros_like(self.embed), [], []
        for i, ((columns, best), kernel, width) in enumerate(zip(kept, self.kernels, WIDTHS)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            rows = np.arange(n)[:, None] * (WINDOW - width + 1) + best  # one position per window and filter
            picked = columns[rows]  # (n, FILTERS, width * EMBED)
            kernels.append(np.einsum("nfk,nf->kf", picked, own))
            biases.append(own.sum(0))
            into = (own[:, :, None] * kernel.T[None]).reshape(n, FILTERS, width, EMBED)
            for k in range(width):
                np.add.at(embed, windows[np.arange(n)[:, None], best + k], into[:, :, k])
        return [embed, *kernels, *biases, features.T @ delta, delta.sum(0)]


def cut(data: np.ndarray, cuts: np.ndarray):
    """(windows, text of each) of the texts of a chunk; an empty text has none."""
    count = -(-np.diff(cuts) // WINDOW)
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (cuts[text] + nth * WINDOW)[:, None] + np.arange(WINDOW)
    inside = at < cuts[text + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8), text


def learn(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 3) -> Network:
    """Train by Adam; every language is drawn equally often."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(
        languages,
        draw(256, EMBED, scale=0.5),
        [draw(w * EMBED, FILTERS, scale=(2 / (w * EMBED)) ** 0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw(FILTERS * len(WIDTHS), len(languages), scale=0.1),
        np.zeros(len(languages), np.float32),
    )
    weight = 1 / np.bincount(labels, minlength=len(languages))[labels]
    order = rng.choice(len(labels), (steps, BATCH), p=weight / weight.sum())
    mean = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    for step, pick in enumerate(order, 1):
        rate = 0.004 * (1 - (step - 1) / steps) + 0.0001
        for p, g, m, s in zip(net.parameters(), net.gradients(windows[pick], labels[pick]), mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _drawn_windows(batches):
    """Columns id, text, lang: PER_TEXT windows at most of each text, with their place in it."""
    for batch in batches:
        ids, langs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for row, data, cuts in textops.chunks(batch.column(1)):
            windows, text = cut(data, cuts)
            firsts = np.searchsorted(text, np.arange(len(cuts)))
            for t, (a, b) in enumerate(zip(firsts.tolist(), firsts[1:].tolist())):
                own = np.arange(a, b)
                if b - a > PER_TEXT:
                    own = np.sort(np.random.default_rng(zlib.crc32(data[cuts[t] : cuts[t + 1]].tobytes())).choice(own, PER_TEXT, replace=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[row + t]] * len(own), pa.int64()),
                        pa.array(own - a),
                        pa.array([langs[row + t]] * len(own), pa.string()),
                        pa.array([windows[w].tobytes() for w in own], pa.binary()),
                    ],
                    names=["id", "place", "lang", "window"],
                )


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Learn from about ``sample`` labelled texts, drawn by a hash of the id; None if there are none.

    Every language has one at least.  An id counts once, however often it is repeated, and a text
    with PER_TEXT windows at most, drawn from all of it; only these windows come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("id is not null and text is not null and lang is not null")
    draw = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()  # a row for each language
    if not sizes:
        return None
    each = max(1.0, sample / len(sizes))
    shares = docs.sparkSession.createDataFrame([(r["lang"], each / r["n"], r["least"]) for r in sizes], "of string, share double, least double")
    drawn = (
        rows.join(F.broadcast(shares), F.col("lang") == F.col("of"))  # a row for each language
        .where((draw < F.col("share")) | (draw == F.col("least")))
        .groupBy("id")
        .agg(F.min(F.struct("text", "lang")).alias("one"))
        .select("id", "one.text", "one.lang")
    )
    got = drawn.mapInArrow(_drawn_windows, "id long, place long, lang string, window binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("place", "ascending")])
    named = got.column("lang").to_pylist()
    languages = sorted(set(named))
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    labels = np.array([number[x] for x in named])
    windows = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return learn(windows, labels, languages)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.

    Every window of the whole text counts.  A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if there is no network.  Repeated rows
    repeat their answer; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    schema = [f for f in rows.schema.fields if f.name == "id"][0].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            lettered = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            names, scores = [], []
            for row, data, cuts in textops.chunks(batch.column(1)) if net else ():
                windows, text = cut(data, cuts)
                sums = np.zeros((len(cuts) - 1, len(net.languages)))
                for i in range(0, len(windows), SLICE):
                    np.add.at(sums, text[i : i + SLICE], net.forward(windows[i : i + SLICE]))
                sums /= np.maximum(1, np.bincount(text, minlength=len(sums)))[:, None]
                p = np.exp(sums - sums.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                names += [net.languages[k] for k in p.argmax(1)]
                scores += p.max(1).tolist()
            if not net:
                names, scores, lettered = [UNKNOWN] * len(lettered), [0.0] * len(lettered), lettered & False
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x if ok else UNKNOWN for x, ok in zip(names, lettered)], pa.string()),
                    pa.array([x if ok else 0.0 for x, ok in zip(scores, lettered)], pa.float64()),
                ],
                names=["id", "lang_pred", "score"],
            )

    return rows.mapInArrow(judge, f"id {schema}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_: str | Column, parts: int = 5, part: int = 0) -> Column:
    """Whether an id is kept from training; a null id is not."""
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return F.coalesce(F.crc32(id_.cast("string")) % parts == part, F.lit(False))
