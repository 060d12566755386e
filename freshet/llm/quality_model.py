"""Quality classifier from positive and unlabelled texts.

A linear model f on shape measures of a text minimises the non-negative unbiased risk
``p R+(f) + max(0, Ru-(f) - p R-(f))`` with logistic loss: R+ and R- are means over trusted positives (label 1), Ru-
is the mean over all texts, taken as unlabelled, and p is the class prior. Each step is a Newton step: its sums over all texts (loss, gradient and
curvature, some 750 numbers) are one aggregate in Spark; the positives, a bounded sample, stand on the driver.

The prior is estimated without negatives: a first model tells positives from unlabelled texts, and for every set of
high scores the share of all texts in it over the share of the positives in it bounds the prior from above; the least bound is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fold, sample_ids
from .quality_rules import measure
from .tables import materialize, read_table
from .texts import HASH_BITS, WHITE, chunks, lean, pieces, span_hashes

#: Bound of the trusted positives that the model is fitted on; a parameter of ``train``. Unlabelled are all texts.
MAX_POSITIVE = 6000
THRESHOLD = 0.3
#: Newton steps at most, the gradient that ends them, the ridge, and standard deviations beyond which a measure is cut.
STEPS, ENOUGH, RIDGE, CUT = 20, 1e-4, 1e-4, 5.0
#: Width over which the corner of the non-negative part is rounded.
KINK = 1e-2
#: Sets of high scores that may bound the prior hold at least this share of the positives.
LEAST_MASS = 0.5
_U = np.uint64
_CLASS = np.zeros(256, np.int64)  # 1 digit, 2 sentence end, 3 other ASCII punctuation
_CLASS[48:58] = 1
_CLASS[list(b".?")] = 2
_CLASS[list(b"!\"'()+,-/:;=@[\\]^_`{}~")] = 3


def shape(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, features) float64 of a chunk's texts; an empty text has zeros."""
    n = len(offs) - 1
    m = {k: v.astype(np.float64) for k, v in measure(buf, offs).items()}
    words, chars, lines = (np.maximum(m[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    start, end, row = pieces(buf, offs, WHITE)
    key = np.unique((row.astype(_U) << _U(HASH_BITS)) | (span_hashes(buf, start, end) >> _U(64 - HASH_BITS)))
    distinct = np.bincount((key >> _U(HASH_BITS)).astype(np.int64), minlength=n)
    single = np.bincount(row[end - start == 1], minlength=n)
    kinds = np.zeros((4, n))
    kind = _CLASS[buf]
    for k in (1, 2, 3):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        kinds[k] = total[offs[1:]] - total[offs[:-1]]
    raw = [
        np.sqrt(m["n_symbols"] / chars), np.sqrt(m["n_upper"] / chars), np.sqrt(m["n_bangs"] / chars), np.sqrt(m["n_repeat_words"] / words), np.sqrt(m["n_dup_lines"] / lines), m["word_chars"] / words / 10,
        np.log1p(m["n_words"]) / 10, distinct / words, single / words, np.sqrt(kinds[1] / chars), np.sqrt(kinds[2] / chars), np.sqrt(kinds[3] / chars), np.log1p(m["n_words"] / lines) / 10,
    ]
    x = np.stack(raw, axis=1)
    return np.concatenate([x, x**2], axis=1)


N_FEATURES = 26


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the bias comes last
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sig(standard(x, self.mean, self.scale) @ self.weight)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised measures, cut at ``CUT``, with a column of ones."""
    return np.column_stack([np.clip((x - mean) / scale, -CUT, CUT), np.ones(len(x))])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x): the shape measures of every row, written once for the passes of the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in chunks(b.column(1)):
                x = shape(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], [id_col, "x"])

    return materialize(docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, x array<double>"), "measures")


def _rows(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(len(x), N_FEATURES)


def _sum(made: DataFrame, parts) -> np.ndarray:
    """The sum over all rows of ``parts(x)``, an array: added up in each task, then by place in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = parts(np.zeros((0, N_FEATURES)))
        for b in batches:
            total = total + parts(_rows(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    got = made.select("x").mapInArrow(lean(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")
    return got["v"].to_numpy() if len(got) else parts(np.zeros((0, N_FEATURES)))


def _loss_parts(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """Sums of log(1 + e^f), its gradient and its curvature over rows."""

    def parts(x: np.ndarray) -> np.ndarray:
        z = standard(x, mean, scale)
        s = _sig(f := z @ w)
        return np.concatenate([[np.logaddexp(0, f).sum()], s @ z, ((s * (1 - s))[:, None] * z).T.dot(z).ravel()])

    return parts


def _newton(made: DataFrame, n: int, p: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights of least non-negative risk with ``prior``; with None those that tell ``p`` from all rows."""
    d = p.shape[1]
    ridge = RIDGE * np.append(np.ones(d - 1), 1e-3)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        every = _sum(made, _loss_parts(mean, scale, w)) / n
        loss, slope, bend = every[0], every[1 : d + 1], every[d + 1 :].reshape(d, d)
        f = p @ w
        s = _sig(f)
        curve = (p * (s * (1 - s))[:, None]).T @ p / len(p)
        if prior is None:
            risk, g, h = loss + np.logaddexp(0, -f).mean(), slope - (1 - s) @ p / len(p), bend + curve
        else:
            # max(0, v) with its corner rounded over KINK, so that the steps can follow it
            v, dv = loss - prior * np.logaddexp(0, f).mean(), slope - prior * s @ p / len(p)
            root = np.hypot(v, KINK)
            part, bent = (1 + v / root) / 2, KINK**2 / (2 * root**3)
            risk = prior * np.logaddexp(0, -f).mean() + (v + root) / 2
            g = -prior * (1 - s) @ p / len(p) + part * dv
            h = prior * (1 - part) * curve + part * bend + bent * np.outer(dv, dv)
        return risk + (ridge * w * w).sum() / 2, g + ridge * w, h + np.diag(ridge) + 1e-9 * np.eye(d)

    w = np.zeros(d)
    risk, g, h = at(w)
    for _ in range(STEPS):
        if np.abs(g).max() < ENOUGH:
            break
        step = np.linalg.solve(h, g)
        for t in (1.0, 0.5, 0.25, 0.0625):
            new = at(w - t * step)
            if new[0] < risk:
                break
        else:
            break
        w, (risk, g, h) = w - t * step, new
    return w


def _prior(made: DataFrame, n: int, p: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    w = _newton(made, n, p, mean, scale, None)
    mine = np.sort(p @ w)
    cuts = np.unique(mine[(len(mine) * np.arange(20) / 20 * (1 - LEAST_MASS)).astype(int)])
    above = _sum(made, lambda x: ((standard(x, mean, scale) @ w)[:, None] >= cuts[None, :]).sum(axis=0).astype(float)) / n
    mass = (mine[:, None] >= cuts[None, :]).mean(axis=0)
    return float(np.clip((above / mass).min(), 0.01, 0.99))


def fit_nnpu(made: DataFrame, positive: np.ndarray, prior: float | None = None) -> Model:
    """The model of (x) rows and measures of positives; without a ``prior`` it is estimated. Without rows or positives all scores are 1/2."""
    sums = _sum(made, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n = int(sums[0])
    if not n or not len(positive):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), prior or 0.5)
    mean = sums[1 : N_FEATURES + 1] / n
    scale = np.sqrt(np.maximum(sums[N_FEATURES + 1 :] / n - mean**2, 0)) + 1e-6
    p = standard(positive, mean, scale)
    prior = _prior(made, n, p, mean, scale) if prior is None else prior
    return Model(mean, scale, _newton(made, n, p, mean, scale, prior), prior)


def train(made: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_positive: int = MAX_POSITIVE) -> Model:
    """Fit on the ``measures`` of all texts and at most ``max_positive`` texts labelled 1 outside fold 0; no other label is looked at.

    Null labels and ids are not learned from; of an id with both labels the 1 counts.
    """
    known = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    ids = sample_ids(known, max_positive, "positive", id_col)  # at most max_positive rows
    x = made.join(F.broadcast(ids), id_col, "left_semi").select(id_col, "x").toArrow().sort_by(id_col)["x"].combine_chunks()
    return fit_nnpu(made, _rows(x))


def score_measures(made: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row of ``measures``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_rows(b.column(1))))], [id_col, "score"])

    return made.select(id_col, "x").mapInArrow(lean(run), f"`{id_col}` {made.schema[id_col].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row. Null texts count as empty; repeated rows are scored each; other columns are ignored."""
    return score_measures(measures(docs, id_col, text_col), model, id_col)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = measures(read_table(spark, sf_dir, "documents"))
    model = train(made, read_table(spark, sf_dir, "labels"))
    return score_measures(made, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
