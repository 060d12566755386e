"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade <= j) = sigmoid(theta_j - w.x)`` with ordered thresholds theta_1 < theta_2 < theta_3 and one weight vector for all of
them. x holds the presence of each word of a lexicon, chosen by counts over all labelled texts outside fold 0.

The labels tell toxic from not. How severe a toxic text is comes from the other half of the labelled texts: each word has the logarithm of
its odds of standing in a toxic rather than another text, counted in one half (by a hash of the id), and the evidence of a text in the
other half is the sum over its words where that is positive. Grades 1 to 3 of the toxic texts used for fitting are the thirds of
their evidence. No text's own label enters its evidence, and the evidence is no feature. The severity of a text is its expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fold, sample_ids
from .tables import materialize, read_table
from .texts import HASH_BITS, LOWER, NOT_WORD, chunks, lean, pieces, span_hashes

#: Bound of the labelled texts of each class that the weights are fitted on; a parameter of ``train``.
MAX_PER_CLASS = 4000
#: Weight of all toxic texts together in the fit, the others have the rest; chosen by leaving out each of the folds 1 to 4.
TOXIC_WEIGHT = 1 / 3
GRADES = 3
#: A word enters the lexicon if the log-likelihood ratio of its counts of toxic and other texts is as rare as one in a thousand without a difference.
LEAST_RATIO = 10.83
#: Labelled rows (some 40 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
_U = np.uint64


def word_keys(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted ``row << 54 | hash`` of every row's distinct words: runs of letters, digits and apostrophes with A-Z lowered."""
    buf = LOWER[buf]
    start, end, row = pieces(buf, offs, NOT_WORD)
    return np.unique((row.astype(_U) << _U(HASH_BITS)) | (span_hashes(buf, start, end) >> _U(64 - HASH_BITS)))


def _word(key: np.ndarray) -> np.ndarray:
    return (key & _U((1 << HASH_BITS) - 1)).view(np.int64)


def _row(key: np.ndarray) -> np.ndarray:
    return (key >> _U(HASH_BITS)).astype(np.int64)


def half(id_col: str) -> F.Column:
    """0 or 1: the half of the labelled texts that a row belongs to."""
    return (F.crc32(F.concat(F.lit("half"), F.col(id_col).cast("string")).cast("binary")) % 2).cast("int")


_GROUPS = ("b0", "a0", "b1", "a1")  # other and toxic texts of half 0, then of half 1


def _word_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, b0, a0, b1, a1) from (label, half, text): texts of each class and half with the word, for each chunk; the word -1 counts all its texts."""
    for b in batches:
        for i, j, buf, offs in chunks(b.column(2)):
            label, part = (b.column(k).slice(i, j - i).to_numpy() for k in (0, 1))
            group = 2 * part + label
            key = word_keys(buf, offs)
            word, at = np.unique(_word(key), return_inverse=True)
            mine = group[_row(key)]
            counts = [np.append(np.bincount(at[mine == k], minlength=len(word)), (group == k).sum()).astype(np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word, -1)), *map(pa.array, counts)], ["word", *_GROUPS])


@dataclass
class Lexicon:
    """Sorted hashes of words, and for a text of each half the evidence that the other half gives a word."""

    words: np.ndarray
    evidence: np.ndarray  # (2, words)

    def columns(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column of each word that stands in the lexicon, which words those are)."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        return at[hit], hit


def lexicon(rows: DataFrame) -> Lexicon:
    """The words that tell the texts of (label, half, text) apart.

    The counts are distributed over all rows and written once; only the chosen words (24 bytes each) reach the driver. The log-likelihood
    ratio needs no smoothing, so a word without other texts scores by its toxic ones in full.
    """
    made = rows.mapInArrow(lean(_word_texts), "word long, " + ", ".join(f"{c} long" for c in _GROUPS)).groupBy("word").agg(*(F.sum(c).alias(c) for c in _GROUPS))
    counts = materialize(made, "word-texts")
    total = counts.filter("word = -1").first()
    if total is None or not total.a0 + total.a1 or not total.b0 + total.b1:
        return Lexicon(np.zeros(0, np.int64), np.zeros((2, 0)))
    a, b, ones, zeros = F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), F.lit(float(total.a0 + total.a1)), F.lit(float(total.b0 + total.b1))
    part = lambda seen, k, of: F.when(seen > 0, seen * F.log(seen * (ones + zeros) / (k * of))).otherwise(0.0)
    ratio = 2 * (part(a, a + b, ones) + part(b, a + b, zeros) + part(ones - a, ones + zeros - a - b, ones) + part(zeros - b, ones + zeros - a - b, zeros))
    odds = lambda k: F.greatest(F.lit(0.0), F.log((F.col(f"a{k}") + 0.5) / (total[f"a{k}"] + 1.0)) - F.log((F.col(f"b{k}") + 0.5) / (total[f"b{k}"] + 1.0)))
    t = counts.filter("word >= 0").filter(ratio >= LEAST_RATIO).select("word", odds(1).alias("e0"), odds(0).alias("e1")).toArrow().sort_by("word")
    return Lexicon(t["word"].to_numpy(), np.stack([t["e0"].to_numpy(), t["e1"].to_numpy()]))


def _hits(lex: Lexicon):
    """(id, label, half, cols) from (id, label, half, text): the lexicon's columns in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in chunks(b.column(3)):
                key = word_keys(buf, offs)
                cols, hit = lex.columns(_word(key))
                cut = np.append(0, np.cumsum(np.bincount(_row(key)[hit], minlength=j - i)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(cols, pa.int32()))], ["id", "label", "half", "cols"])

    return run


class Sparse:
    """A matrix of (row, column, value) entries with the products that the fit needs."""

    __array_ufunc__ = None

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.col], minlength=self.shape[0])

    def __rmatmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * v[self.row], minlength=self.shape[1])


@dataclass
class Model:
    """The lexicon, the weight of each of its words, and the thresholds."""

    lexicon: Lexicon
    weight: np.ndarray
    theta: np.ndarray

    def latent(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        key = word_keys(buf, offs)
        cols, hit = self.lexicon.columns(_word(key))
        return np.bincount(_row(key)[hit], self.weight[cols], minlength=len(offs) - 1)

    def above(self, z: np.ndarray) -> np.ndarray:
        """(rows, GRADES): the probability of each grade or a higher one."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - z[:, None], -40, 40)))


def fit_ordinal(x: np.ndarray | Sparse, grade: np.ndarray, weight: np.ndarray, steps: int = 800, rate: float = 0.05, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """(w, theta) by Adam on the weighted log-likelihood of the cumulative-link model with a ridge on w."""
    d = x.shape[1]
    par = np.concatenate([np.zeros(d), [1.0], np.zeros(GRADES - 1)])  # theta_1, then logs of the steps up
    first, second = np.zeros_like(par), np.zeros_like(par)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        up = np.exp(par[d + 1 :])
        theta = par[d] + np.concatenate([[0], np.cumsum(up)])
        z = x @ par[:d]
        hi = np.where(grade < GRADES, sig(theta[np.minimum(grade, GRADES - 1)] - z), 1.0)
        lo = np.where(grade > 0, sig(theta[np.maximum(grade - 1, 0)] - z), 0.0)
        p = np.maximum(hi - lo, 1e-9)
        dh, dl = np.where(grade < GRADES, hi * (1 - hi), 0) / p, np.where(grade > 0, lo * (1 - lo), 0) / p
        gz = weight * (dh - dl)
        gt = np.array([(-weight * dh)[grade == k].sum() + (weight * dl)[grade == k + 1].sum() for k in range(GRADES)])
        g = np.concatenate([gz @ x + decay * par[:d] / len(x) ** 0.5, [gt.sum()], [gt[k:].sum() * up[k - 1] for k in range(1, GRADES)]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        par -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return par[:d], par[d] + np.concatenate([[0], np.cumsum(np.exp(par[d + 1 :]))])


def grades(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for other texts; the third of its evidence among the toxic ones, 1 to 3, ties to the lower."""
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        out[toxic] = 1 + np.searchsorted(np.quantile(evidence[toxic], [1 / 3, 2 / 3]), evidence[toxic], "left")
    return out


def fit(cols: np.ndarray, row: np.ndarray, toxic: np.ndarray, part: np.ndarray, lex: Lexicon) -> Model:
    """The model of sampled texts given as entries (row, column); ``part`` is the half of each text."""
    ones, zeros = int(toxic.sum()), int((~toxic).sum())
    if not ones or not zeros or not len(lex.words):
        return Model(Lexicon(np.zeros(0, np.int64), np.zeros((2, 0))), np.zeros(0), np.array([3.0, 4.0, 5.0]))
    grade = grades(np.bincount(row, lex.evidence[part[row], cols], minlength=len(toxic)), toxic)
    x = Sparse(row, cols, np.ones(len(cols)), (len(toxic), len(lex.words)))
    return Model(lex, *fit_ordinal(x, grade, np.where(toxic, TOXIC_WEIGHT / ones, (1 - TOXIC_WEIGHT) / zeros)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> Model:
    """Lexicon from all labelled texts outside fold 0, weights from at most ``max_per_class`` of each class (of them the driver gets lexicon columns only).

    An id labelled both toxic and not counts as toxic. Null labels and ids are not learned from.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0)).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"), half(id_col).alias("half"))
    known = materialize(known, "labels")
    lex = lexicon(docs.select(id_col, text_col).join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, id_col).select("label", "half", text_col))
    ids = sample_ids(known.filter("label = 0"), max_per_class, "toxic0", id_col).union(sample_ids(known.filter("label = 1"), max_per_class, "toxic1", id_col))
    mine = known.join(F.broadcast(ids), id_col, "left_semi")  # at most 2 * max_per_class rows
    rows = docs.select(id_col, text_col).join(F.broadcast(mine), id_col).select(id_col, "label", "half", text_col)
    t = rows.mapInArrow(lean(_hits(lex)), f"id {docs.schema[id_col].dataType.simpleString()}, label int, half int, cols array<int>").toArrow().sort_by("id")
    if not len(t):
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), lex)
    lists = t["cols"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return fit(lists.flatten().to_numpy(), np.repeat(np.arange(len(t)), sizes), t["label"].to_numpy() == 1, t["half"].to_numpy(), lex)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``severity`` (expected grade, 0 to 3), ``p_toxic`` (grade 1 or more), ``grade`` (likeliest) for every row.

    Null and empty texts have no features and get the grade of the thresholds alone. Repeated rows are scored each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in chunks(b.column(1)):
                up = model.above(model.latent(buf, offs))
                each = -np.diff(np.column_stack([np.ones(len(up)), up, np.zeros(len(up))]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(up.sum(axis=1)), pa.array(up[:, 0].copy()), pa.array(each.argmax(axis=1), pa.int32())], [id_col, "severity", "p_toxic", "grade"])

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, severity double, p_toxic double, grade int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))
