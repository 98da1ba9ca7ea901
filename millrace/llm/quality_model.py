"""Text quality by a linear hinge-loss model over n-gram indicators scaled by log-count ratios.

Every n-gram that occurs in a text is an indicator; its weight in the input is the log ratio of its
smoothed document frequencies in good and in bad texts. A support vector machine on these inputs is
fitted by dual coordinate descent. N-grams are of bytes (one to three) and of word shapes (one to
three), where a word's shape says its letter case, the kind of its last character, its length
class, and whether it repeats one of the two words before it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import byte_view, slices
from millrace.llm.words import LOWER, Hashes, mix, word_spans

BUCKETS = 1 << 16
"""Size of the hashed feature space; bounds the model, and with it all that is gathered or broadcast."""
SAMPLE_ROWS = 16_384
"""Labels that the fit reads at most, taken by a hash of the id."""
SLICE_BYTES = 1 << 18
"""Bytes of text whose n-grams are held at once; they take about 100 bytes each."""
LEAST_TEXTS = 3
SMOOTHING = 1.0
COST = 0.05
EPOCHS = 15
FOLDS = 4
THRESHOLD = 0.7

# Byte kinds: 0 lower-case letter or part of a longer character, 1 upper-case letter, 2 digit, 3 sentence mark, 4 symbol.
KIND = np.full(256, 4, np.int64)
KIND[ord("a") : ord("z") + 1] = 0
KIND[0x80:] = 0
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 3


def indicators(batch: pa.RecordBatch, text: str) -> Iterator[np.ndarray]:
    """For each text the sorted distinct buckets of its n-grams."""
    raw, offsets = byte_view(batch.column(text))
    starts, ends, first = word_spans(raw, offsets)
    low = LOWER[raw].astype(np.uint64)
    bucket = lambda keys, kind: (mix(keys + np.uint64(kind << 40)) >> np.uint64(48)).astype(np.int32)
    ones = bucket(low, 1)
    twos = bucket(low[:-1] << np.uint64(8) | low[1:], 2)
    threes = bucket(low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:], 3)

    hashes = Hashes(LOWER[raw]).of(starts, ends)
    kinds = KIND[raw]
    sums = np.concatenate([[0], np.cumsum(kinds == 1)])
    length = ends - starts
    upper = sums[ends] - sums[starts]
    case = np.where(upper == 0, 0, np.where(2 * upper > length, 2, 1)) if len(starts) else length
    last = kinds[ends - 1] if len(starts) else length
    again = np.zeros(len(starts), np.int64)
    again[1:] |= hashes[1:] == hashes[:-1]
    again[2:] |= 2 * (hashes[2:] == hashes[:-2])
    # A text's first words repeat none of the text before it.
    head = first[:-1][first[:-1] < len(starts)]
    again[head[head + 1 < len(starts)] + 1] &= 1
    again[head] = 0
    shape = (((case * 5 + last) * 4 + again) * 4 + np.minimum(length // 5, 3)).astype(np.uint64)
    one = bucket(shape, 4)
    two = bucket(shape[:-1] << np.uint64(16) | shape[1:], 5)
    three = bucket(shape[:-2] << np.uint64(32) | shape[1:-1] << np.uint64(16) | shape[2:], 6)

    seen = np.zeros(BUCKETS, bool)
    edges = zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist())
    for a, b, c, d in edges:
        seen[ones[a:b]] = True
        seen[twos[a : max(a, b - 1)]] = True
        seen[threes[a : max(a, b - 2)]] = True
        seen[one[c:d]] = True
        seen[two[c : max(c, d - 1)]] = True
        seen[three[c : max(c, d - 2)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def sliced_indicators(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batch in small slices, each with the buckets of its texts as two-byte numbers, so that a worker's memory follows neither batch nor rows."""
    for part in slices(batch, text, SLICE_BYTES):
        yield part, [f.astype("<u2") for f in indicators(part, text)]


@dataclass(frozen=True)
class Model:
    """Hinge-loss weights times log-count ratios and the squared ratios, by bucket, and the sigmoid of the margin."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum()) / max(1.0, float(self.squares[found].sum())) ** 0.5 + self.bias
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of good and of bad texts that hold each n-gram; 0 for those in fewer than three texts."""
    totals = np.zeros((2, BUCKETS))
    for found, label in zip(rows, labels):
        totals[label, found] += 1
    sizes = np.bincount(labels, minlength=2)[:, None]
    share = (totals + SMOOTHING) / (sizes + 2 * SMOOTHING)
    return np.log(share[1] / share[0]) * (totals.sum(axis=0) >= LEAST_TEXTS)


def scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    """The inputs of each text: its n-grams' ratios, at most unit length."""
    return [(ratios[r] / max(1.0, float(np.square(ratios[r]).sum())) ** 0.5).astype(np.float32) for r in rows]


def dual_descent(
    rows: list[np.ndarray], inputs: list[np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS
) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine by dual coordinate descent, both classes of equal mass."""
    weights, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    slack = share[labels] / cost
    norms = np.array([float(x @ x) + 1.0 for x in inputs])
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, r = inputs[k], rows[k]
            gradient = sign[k] * (float(weights[r] @ x) + bias) - 1.0 + slack[k] * alpha[k]
            step = max(alpha[k] - gradient / (norms[k] + slack[k]), 0.0) - alpha[k]
            if step:
                alpha[k] += step
                weights[r] += step * sign[k] * x
                bias += step * sign[k]
    return weights, bias


def sigmoid_fit(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and labels, by damped Newton steps."""
    good, bad = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((target - p) * margin).sum(), (target - p).sum()])
        hessian = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        slope, shift = slope + move[0], shift + move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(slope), float(shift)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of labelled indicator sets; without both classes a constant one, with no rows 0.5."""
    if len(set(labels.tolist())) < 2:
        shift = 0.0 if not len(labels) else (5.0 if labels[0] == 1 else -5.0)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, shift)
    ratios = log_ratios(rows, labels)
    fold = np.random.default_rng(3).permutation(len(rows)) % FOLDS
    outer = np.zeros(len(rows))
    for k in range(FOLDS):
        chosen = np.flatnonzero(fold != k)
        part, own = [rows[i] for i in chosen], labels[chosen]
        if len(set(own.tolist())) < 2:
            continue
        own_ratios = log_ratios(part, own)
        w, b = dual_descent(part, scaled(part, own_ratios), own, epochs=EPOCHS // 2)
        for i in np.flatnonzero(fold == k):
            x = own_ratios[rows[i]]
            outer[i] = float(w[rows[i]] @ x) / max(1.0, float(x @ x)) ** 0.5 + b
    slope, shift = sigmoid_fit(outer, labels)
    weights, bias = dual_descent(rows, scaled(rows, ratios), labels)
    return Model(weights * ratios, np.square(ratios), bias, slope, shift)


def held_out(id_col: str) -> Column:
    """Whether the row is kept from all fitting: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on at most ``sample_rows`` labels outside the held-out quarter, the first by a hash of their id.

    The sampled ids and labels are few by that bound and are broadcast, so texts are not shuffled;
    the indicators of the sampled texts go to one task. Null labels and ids are left out.
    """
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, found in sliced_indicators(whole, text_col):
                packed = pa.array([f.tobytes() for f in found], pa.binary())
                yield pa.record_batch([batch.column("_id"), batch.column("_label"), packed], names=["_id", "_label", "found"])

    kind = labels.schema[id_col].dataType.simpleString()
    sampled = (
        documents.select(F.col(id_col).alias("_id"), text_col)
        .join(F.broadcast(chosen), "_id")
        .select("_id", "_label", text_col)
        .mapInArrow(extract, f"_id {kind}, _label int, found binary")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, rows = [], [], []
        for batch in batches:
            ids += batch.column("_id").to_pylist()
            marks += batch.column("_label").to_pylist()
            rows += [np.frombuffer(found, "<u2") for found in batch.column("found").to_pylist()]
        # Only rows that repeat an id need their buckets to be put in order.
        often = Counter(ids)
        order = sorted(range(len(ids)), key=lambda k: (ids[k], len(rows[k]), rows[k].astype("<i4").tobytes() if often[ids[k]] > 1 else b""))
        model = fit([rows[k] for k in order], np.array([marks[k] for k in order], np.int64))
        numbers = [model.bias, model.slope, model.shift]
        yield pa.record_batch(
            [pa.array([model.weights.tobytes()]), pa.array([model.squares.tobytes()]), pa.array([numbers])],
            names=["weights", "squares", "numbers"],
        )

    row = sampled.repartition(1).mapInArrow(learn, "weights binary, squares binary, numbers array<double>").first()
    return Model(np.frombuffer(row["weights"]), np.frombuffer(row["squares"]), *row["numbers"])


def score_quality(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the columns of ``keep``, and ``score`` of every whole text, row per row.

    Nothing but the text enters the score. A null or empty text has no n-grams and scores what the
    bias gives. Repeated texts score alike; an empty table gives an empty result.
    """
    schema = documents.schema
    carried = list(dict.fromkeys([id_col, *keep]))
    text = text_col if text_col in carried else "_text"
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch, rows in sliced_indicators(whole, text):
                scores = [known.score(found) for found in rows]
                yield pa.record_batch([*(batch.column(c) for c in carried), pa.array(scores, pa.float64())], names=[*carried, "_score"])

    fields = ", ".join([*(f"`{c}` {schema[c].dataType.simpleString()}" for c in carried), "_score double"])
    sent = documents.select(*carried) if text in carried else documents.select(*carried, F.col(text_col).alias(text))
    return sent.mapInArrow(work, fields)


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id, held_out, score, predicted`` per document; 1 is predicted from a score of THRESHOLD."""
    model = fit_quality(documents, labels, id_col, text_col, label_col)
    scored = score_quality(documents, model, id_col, text_col)
    return scored.select(
        id_col, held_out(id_col).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    )
