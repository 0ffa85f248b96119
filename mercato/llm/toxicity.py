"""Operator 6: toxicity by compression distance.

Two zstandard dictionaries are trained, one on the wording that toxic training
documents have over ordinary ones and one on ordinary wording. Every word of a
text is a window; its length compressed with the ordinary dictionary less its
length with the toxic one says how much better the toxic wording explains it.
A document is the histogram of these differences; thresholds set on ordinary
calibration documents turn it into hit counts, and a logistic fit turns those
into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import crc_remainder, documents, map_texts, word_list

#: Follows each window: zstandard looks for no match in the last bytes of an input, and both dictionaries know it.
TAIL = b"\x01<one window of text\x02reads:>"
#: Longer words are several windows.
WINDOW = 64
#: Differences are counted from -SPAN to SPAN.
SPAN = 32
#: Bounds of the training sample: labelled documents of either class for the dictionaries, and for the calibration.
TRAIN_DOCS = 4_000
#: Words that a dictionary is trained on, at most; candidate dictionary sizes (the calibration picks one).
TRAIN_WORDS = 20_000
SIZES = (4096, 8192, 16384)
#: Shares of ordinary words that lie under the thresholds.
QUANTILES = (0.5, 0.9, 0.97, 0.99, 0.997, 0.999, 0.9997, 0.9999)


def _dictionary(words: list[tuple[bytes, int]], size: int, samples: int) -> bytes:
    """Trained on windows of the words as often as they occur; room that the training leaves is filled with the most
    frequent words it left out."""
    total = sum(n for _, n in words) or 1
    windows = [b" " + w + b" " + TAIL for w, n in words for _ in range(max(1, round(n * samples / total)))]
    try:
        body = zstandard.train_dictionary(size, windows, k=16, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        body = b""  # too little text to train on
    more, room = [], size - len(body)
    for w, _ in words:
        room -= len(w) + 1
        if room < 0:
            break
        if w not in body:
            more.append(w)
    return body + b" " + b" ".join(reversed(more)) + b" " + TAIL


class Distances(dict):
    """Difference of the compressed lengths of a word under the two dictionaries, remembered up to ``limit`` words."""

    limit = 200_000

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.by = [self._compressor(d) for d in (ordinary, toxic)]

    @staticmethod
    def _compressor(body: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=WINDOW, dict_size=len(body), write_content_size=0, write_checksum=0, write_dict_id=0,
            min_match=3, strategy=zstandard.STRATEGY_GREEDY)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(body))

    def learn(self, words) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(words)
        if new:
            windows = [b" " + w + b" " + TAIL for w in new]
            for w, x, y in zip(new, *(c.multi_compress_to_buffer(windows, threads=1) for c in self.by), strict=True):
                self[w] = min(SPAN, max(-SPAN, len(x) - len(y))) + SPAN


def windows_of(text: str) -> list[bytes]:
    words = word_list(text)
    if any(len(w) > WINDOW for w in words):
        words = [w[i:i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]
    return words


def histograms(texts, distances: Distances) -> np.ndarray:
    """For each text how many of its windows have each difference."""
    out = np.zeros((len(texts), 2 * SPAN + 1), np.int64)
    for i, text in enumerate(texts):
        words = windows_of(text)
        distances.learn(dict.fromkeys(words))
        if words:
            out[i] = np.bincount(np.fromiter(map(distances.__getitem__, words), np.int64, len(words)),
                                 minlength=2 * SPAN + 1)
    return out


@dataclass
class Model:
    """What scoring needs: two dictionaries, thresholds and the logistic fit (a few KB). Without weights the score is ``prior``."""

    prior: float
    dictionaries: tuple[bytes, bytes] = (TAIL, TAIL)
    thresholds: tuple[int, ...] = ()
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def features(self, hist: np.ndarray) -> np.ndarray:
        n = hist.sum(axis=1)
        tail = hist[:, ::-1].cumsum(axis=1)[:, ::-1]  # windows with at least this difference
        top = [np.minimum(tail, k)[:, 1:].sum(axis=1) / k for k in (1, 3)]  # mean of the k highest, from -SPAN
        hits = [f for t in self.thresholds for f in (np.log1p(tail[:, t]), tail[:, t] / np.maximum(n, 1))]
        mean = (hist * np.arange(hist.shape[1])).sum(axis=1) / np.maximum(n, 1)
        return np.column_stack([*top, *hits, mean, np.log1p(n)])

    def fit(self, hist: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
        """Ridge logistic regression by Newton steps; returns the mean log loss. A document counts ``weight`` times."""
        share = hist[toxic == 0].sum(axis=0).cumsum()
        self.thresholds = tuple(sorted({int(np.searchsorted(share, q * share[-1])) for q in QUANTILES}))
        x = self.features(hist)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.c_[np.ones(len(x)), (x - self.center) / self.scale]
        w, ridge = np.zeros(a.shape[1]), np.r_[0, np.full(a.shape[1] - 1, 0.5)] + 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge),
                                 a.T @ (weight * (toxic - p)) - ridge * w)
        self.weights = w
        p = np.clip(self.score(hist), 1e-6, 1 - 1e-6)
        return float(-np.average(toxic * np.log(p) + (1 - toxic) * np.log(1 - p), weights=weight))

    def score(self, hist: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(hist), self.prior)
        x = (self.features(hist) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _sample(labels: DataFrame, folds: tuple[int, ...]) -> DataFrame:
    """At most TRAIN_DOCS ids of each class from the given folds, by hash order: the same ids in every run."""
    own = labels.where(crc_remainder(F.col("id")).isin(*folds))
    each = [own.where(F.col("toxic") == t).orderBy(F.xxhash64("id", F.lit(6)), "id").limit(TRAIN_DOCS) for t in (0, 1)]
    return F.broadcast(each[0].union(each[1]))  # at most 2 * TRAIN_DOCS rows of two numbers


def _weights(labels: DataFrame) -> dict[tuple[int, int], float]:
    """For (half, class) how many labels each sampled one stands for: folds 1 and 2 are half 0, folds 3 and 4 half 1."""
    fold = crc_remainder(F.col("id"))
    n = labels.where(fold > 0).groupBy((fold > 2).cast("int").alias("half"), "toxic").agg(F.count(F.lit(1)).alias("n"))
    return {(r["half"], r["toxic"]): max(1.0, r["n"] / TRAIN_DOCS) for r in n.collect()}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    Folds 1 and 2 give the dictionaries, folds 3 and 4 the thresholds, the fit
    and the dictionary size, so that a text is never scored with a dictionary
    made from it. Only word counts of the bounded sample (at most TRAIN_WORDS
    words of either class) and histograms (65 numbers for each of at most
    2 * TRAIN_DOCS documents) reach the driver. A sampled document counts as often
    as there are labels of its class for each one sampled, so the fit and the
    prior see the classes in their true proportion at any size. Null labels are
    no labels; of several labels for one id the highest holds. With one class
    only, or none, the score is the share of toxic labels.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    docs = documents(docs)
    weight = _weights(known)

    def words(batches):
        for pdf in batches:
            rows = [(t, w) for text, t in zip(pdf["text"], pdf["toxic"], strict=True) for w in set(windows_of(text))]
            yield pd.DataFrame(rows, columns=["toxic", "word"])

    first = docs.join(_sample(known, (1, 2)), F.col("doc_id") == F.col("id"))
    n = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_ordinary = n.get(1, 0), n.get(0, 0)
    true_toxic, true_ordinary = n_toxic * weight.get((0, 1), 1.0), n_ordinary * weight.get((0, 0), 1.0)
    prior = true_toxic / (true_toxic + true_ordinary) if n else 0.0
    if not n_toxic or not n_ordinary:
        return Model(prior)
    counts = first.select("text", "toxic").mapInPandas(words, "toxic int, word binary").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    rate_t, rate_o = F.col("t") / n_toxic, (F.col("o") + 0.5) / n_ordinary
    least = max(2, math.ceil(0.004 * n_toxic))
    toxic = counts.where((F.col("t") >= least) & (rate_t >= 10 * rate_o)).orderBy(F.desc("t"), "word")
    ordinary = counts.where((F.col("o") >= 3) & (rate_t <= rate_o)).orderBy(F.desc("o"), "word")
    toxic, ordinary = ([(bytes(r["word"]), r[c]) for r in df.limit(TRAIN_WORDS).collect()]
                       for df, c in ((toxic, "t"), (ordinary, "o")))
    if not toxic:
        return Model(prior)
    pairs = [(_dictionary(ordinary, s, 200_000), _dictionary(toxic, s, 60_000)) for s in SIZES]

    def calibrate(batches):
        distances = [Distances(*p) for p in pairs]
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], **{
                f"h{i}": list(histograms(pdf["text"], d)) for i, d in enumerate(distances)}})

    second = docs.join(_sample(known, (3, 4)), F.col("doc_id") == F.col("id")).select("text", "toxic", "doc_id")
    cols = ", ".join(f"h{i} array<long>" for i in range(len(SIZES)))
    got = second.mapInPandas(calibrate, f"toxic int, {cols}").toPandas()
    y = got["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(prior)
    each = np.where(y > 0, weight.get((1, 1), 1.0), weight.get((1, 0), 1.0))
    fits = []
    for i, p in enumerate(pairs):
        model = Model(prior, p)
        # summed in a fixed order, so that reruns agree whatever order the rows came in
        hist = np.stack(got[f"h{i}"].to_numpy()).astype(np.int64)
        order = np.lexsort((*hist.T, y))
        fits.append((model.fit(hist[order], y[order], each[order]), i, model))
    return min(fits, key=lambda f: f[:2])[2]


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Scores read only the text: the windows of the whole of it. Null text counts
    as empty; a text without words gets the score of an empty histogram. Rows
    repeated are scored each, null ids too (held_out: crc32 of the empty text is
    0, so true). An empty table gives no rows.
    """
    model = train(docs, labels)

    def make():
        distances = Distances(*model.dictionaries)

        def columns(texts):
            s = model.score(histograms(texts, distances))
            return [s, (s >= 0.5).astype("int32")]

        return columns

    out = map_texts(documents(docs), make, "score double, predicted int")
    return out.select("doc_id", (crc_remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all columns of ``docs``: a pass over the rows, no join. Where
    nothing could be fitted, nothing is known of any text, so all documents stay."""
    model = train(docs, labels)
    if model.weights is None:
        return docs

    def keep(batches):
        distances = Distances(*model.dictionaries)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.score(histograms(texts, distances)) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
