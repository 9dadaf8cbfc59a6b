"""Toxicity by a counterfactual-regularised classifier.

A logistic model over hashed words, present or not, of the whole text. It is fitted on a bounded sample of labelled rows
by accelerated proximal gradient steps with an L1 penalty. Every sentence of a sampled text that names a group
(IDENTITIES) is written anew with each other group of the same kind in its place, and the squared change of the score
from the one sentence to the other is part of the loss: naming a group by itself moves the score as little as naming any
other, or people in general, whatever labels the texts that name it happen to bear.

Only words that tell the classes apart, and the terms that name groups, leave the executors, and equal pairs of sentences
are counted there: what reaches the driver is bounded by SAMPLE_ROWS, SWAP_PAIRS and the 2 ** BITS hashed words.

Null and empty texts get the score of the bias alone. Labels without a document and documents without a label take no
part in fitting; several labels of one document all count, also contrary ones; null labels are left out. With no labels,
or labels of one class only, the model is its bias. Repeated rows are scored each on its own; columns named as the results
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise
from .text import chunks, words

BITS = 18
#: Most labelled rows that are fitted on, taken by least hash of the key.
SAMPLE_ROWS = 20_000
#: Most distinct pairs of a sentence and its counterfactual that are fitted on, taken by least hash.
SWAP_PAIRS = 100_000
L1, SWAP_PENALTY, STEPS = 3e-5, 4.0, 600
#: Standard errors by which a word's share must differ between the classes.
LEAST_Z = 4.0
FOLDS = 5

#: Terms that name groups, by kind; the first of each kind is neutral.
IDENTITIES: dict[str, tuple[str, ...]] = {
    "gender": ("people", "women", "men", "girls", "boys", "transgender", "nonbinary"),
    "faith": ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs", "christian", "muslim", "jewish", "hindu", "buddhist"),
    "origin": ("residents", "immigrants", "refugees", "africans", "asians", "europeans", "mexicans", "arabs", "americans", "african", "asian", "mexican", "arab", "black", "white", "latino"),
    "orientation": ("couples", "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    "age_ability": ("persons", "elderly", "young", "disabled", "deaf", "blind"),
    "leute": ("leute", "frauen", "männer", "muslime", "juden", "christen", "ausländer"),
    "gens": ("gens", "femmes", "hommes", "musulmans", "juifs", "chrétiens", "immigrés"),
    "gente": ("gente", "mujeres", "hombres", "musulmanes", "judíos", "cristianos", "inmigrantes"),
}

_codes = np.arange(256)
_LETTER = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
_FOLD = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the distinct hashed words of each document."""
    w = words(data, offsets, ~_LETTER, _FOLD)
    owner = np.repeat(np.arange(len(w.first) - 1, dtype=np.int64), np.diff(w.first))
    both = np.unique((owner << bits) | (w.hash >> np.uint64(64 - bits)).astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


def feature_of(word: str, bits: int = BITS) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(features(raw, np.array([0, len(raw)]), bits)[1][0])


def features_of(text: str, bits: int = BITS) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]), bits)[1].tolist()


_SWAPS = pa.list_(pa.struct([("before", pa.list_(pa.int32())), ("after", pa.list_(pa.int32()))]))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = features(data, offsets)
        return _sigmoid(self.bias + np.bincount(doc, self.weights[feature], len(offsets) - 1))


_TERM = {t: terms for terms in IDENTITIES.values() for t in terms}
_NAMED = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, _TERM), key=len, reverse=True)) + r")\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]+")


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """Each sentence that names a group, with each sentence that names another group of the kind in its place."""
    if not _NAMED.search(text):
        return []
    out = []
    for sentence in _SENTENCE.findall(text):
        for term in sorted({m.lower() for m in _NAMED.findall(sentence)}):
            named = re.compile(rf"\b{re.escape(term)}\b", re.IGNORECASE)
            out += [(sentence, named.sub(other, sentence)) for other in _TERM[term] if other != term]
    return out


def told_apart(n: int, toxic: int, all_: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Which words stand in one class's texts more often than chance allows: by the score of a two-sample test of shares.

    n texts, toxic of which are; all_ and bad: how many of all and of the toxic ones hold each word.
    """
    share = all_ / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / toxic + 1 / (n - toxic)))
    z = (bad / toxic - (all_ - bad) / (n - toxic)) / spread
    return (all_ >= 3) & (np.abs(z) >= LEAST_Z)


@dataclass
class Sets:
    """Sets of features in a row: set i has the features where owner is i."""

    count: int
    owner: np.ndarray
    feature: np.ndarray

    @staticmethod
    def of(lists: list) -> Sets:
        sizes = [len(x) for x in lists]
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sum(sizes) else np.zeros(0, np.int64)
        return Sets(len(lists), np.repeat(np.arange(len(lists)), sizes), flat)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(labels: np.ndarray, texts: Sets, swaps: tuple[Sets, Sets] | None = None, weight: np.ndarray | None = None, *, l1: float = L1, swap: float = SWAP_PENALTY, steps: int = STEPS, bits: int = BITS) -> Model:
    """Logistic loss of the texts + swap times the mean squared change of score from each sentence to its counterfactual.

    swaps: sentences and their counterfactuals, pair by pair; weight: how often each pair was found. Rows of one class
    only, or none, give a model of the bias alone.
    """
    n = len(labels)
    rate = labels.mean() if n else 0.0
    if not 0 < rate < 1:
        return Model(np.zeros(1 << bits), float(np.log((rate * n + 0.5) / (n - rate * n + 0.5))))
    before, after = swaps or (Sets.of([]), Sets.of([]))
    share = np.ones(before.count) if weight is None else weight
    share = share / max(1.0, share.sum())
    columns, local = np.unique(np.concatenate([texts.feature, before.feature, after.feature]), return_inverse=True)
    own, old, new = np.split(local, np.cumsum([len(texts.feature), len(before.feature)]))
    m = len(columns)
    # The last coordinate is the bias, which takes no penalty. The bound on the curvature is a trace, so it holds always.
    w = np.append(np.zeros(m), np.log(rate / (1 - rate)))
    sizes = 2 + np.bincount(before.owner, minlength=before.count) + np.bincount(after.owner, minlength=after.count)
    bound = 0.25 * (1 + np.mean(np.bincount(texts.owner, minlength=n))) + 0.5 * swap * float(share @ sizes)
    penalty = np.append(np.full(m, l1 / bound), 0.0)
    y, momentum, last = w.copy(), 1.0, w.copy()
    for _ in range(steps):
        error = (_sigmoid(y[m] + np.bincount(texts.owner, y[own], n)) - labels) / n
        g = np.append(np.bincount(own, error[texts.owner], m), error.sum())
        if before.count:
            s, t = (_sigmoid(y[m] + np.bincount(x.owner, y[i], x.count)) for x, i in ((before, old), (after, new)))
            change = 2 * swap * share * (s - t)
            up, down = change * s * (1 - s), change * t * (1 - t)
            g[:m] += np.bincount(old, up[before.owner], m) - np.bincount(new, down[after.owner], m)
            g[m] += (up - down).sum()
        step = y - g / bound
        w = np.sign(step) * np.maximum(np.abs(step) - penalty, 0)
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = w + (momentum - 1) / ahead * (w - last)
        momentum, last = ahead, w
    weights = np.zeros(1 << bits)
    weights[columns] = w[:m]
    return Model(weights, float(w[m]))


def fold(key: Column) -> Column:
    """CRC-32 of the key as text, modulo the number of folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, swap: float = SWAP_PENALTY) -> Model:
    """Fits on at most `rows` labelled rows outside fold 0, those of least key hash: a sample that doesn't depend on order."""
    picked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 0)).select(key, F.col(label).cast("int").alias("_label"))
    picked = picked.orderBy(F.xxhash64(key), key, "_label").limit(rows)
    # The sample is bounded by `rows`, so it can be broadcast.
    texts = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(picked), key).select("_label", "_text", F.col(key).cast("long").alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                doc, feature = features(data, offsets)
                lists = np.split(feature, np.searchsorted(doc, np.arange(1, b - a)))
                swaps = [[{"before": features_of(x), "after": features_of(y)} for x, y in counterfactuals(t)] for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a), pa.array(lists, pa.list_(pa.int32())), pa.array(swaps, _SWAPS)], ["key", "label", "features", "swaps"])

    # One row per key and label: a repeated document does not enlarge the sample.
    sample = texts.mapInArrow(run, "key long, label int, features array<int>, swaps array<struct<before:array<int>,after:array<int>>>")
    sample = materialise(sample.groupBy("key", "label").agg(F.min_by(F.struct("features", "swaps"), F.xxhash64("features")).alias("x")).select("key", "label", "x.*"), "toxicity-sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return fit(np.ones(n) * (toxic > 0), Sets.of([]))
    counts = sample.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).toPandas()
    all_, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    all_[counts["f"]], bad[counts["f"]] = counts["n"], counts["bad"]
    chosen = told_apart(n, toxic, all_, bad)
    chosen[[feature_of(t) for t in _TERM]] = True
    kept = F.array(*(F.lit(int(f)) for f in np.flatnonzero(chosen)))
    rows = sample.select("key", "label", F.array_intersect("features", kept).alias("features")).orderBy("key", "label").toPandas()
    swaps = sample.select(F.explode("swaps").alias("p")).select(F.array_sort(F.array_intersect("p.before", kept)).alias("before"), F.array_sort(F.array_intersect("p.after", kept)).alias("after"))
    swaps = swaps.groupBy("before", "after").agg(F.count("*").alias("n")).orderBy(F.xxhash64("before", "after"), "before", "after").limit(SWAP_PAIRS).toPandas()
    pairs = Sets.of(list(swaps["before"])), Sets.of(list(swaps["after"]))
    return fit(rows["label"].to_numpy().astype(float), Sets.of(list(rows["features"])), pairs, swaps["n"].to_numpy().astype(float), swap=swap)


def scored(documents: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with `score`, from 0 to 1, and `predicted`, 1 from 0.5 on."""
    documents = documents.drop("score", "predicted")
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    at = documents.columns.index(text)
    kept = [i for i in range(len(documents.columns)) if keep_text or i != at]
    names = [documents.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in chunks(batch.column(at)):
                out[a:b] = own.score(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out)], [*names, "score"])

    schema = ", ".join([*(f"`{documents.schema[i].name}` {documents.schema[i].dataType.simpleString()}" for i in kept), "score double"])
    return documents.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
