"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k | text) = 1 / (1 + exp(w . x - t_k)) with one weight vector for all grades and increasing
thresholds t_k. x is a hashed bag of words, word shapes and repetitions of the whole text. The expected
grade and the tail probability P(grade >= k) come from the same curve.

The fit sees at most ``FIT_ROWS`` labelled rows, chosen by the hash of their ids, and runs in one task;
everything else is spread over the table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandwise.llm.columns import with_struct
from strandwise.llm.labelled import sample, training_labels
from strandwise.session import stage

BINS = 1 << 18
FIT_ROWS = 16_384
STEPS = 120
PENALTY = 1e-6
CACHED_WORDS = 1 << 18

_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))
FIELDS = T.StructType([
    T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType())),
])
_BAG = T.StructType([
    T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType())),
])


def _bin(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BINS


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits as one A, a, 0 each; other characters stay, at most four."""
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return word[:4]


class Bagger:
    """Texts to sorted bins and values of unit length. The bins of words seen before are kept."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int]] = {}

    def _bins(self, word: str) -> tuple[int, int, int]:
        shape = shape_of(word)
        got = _bin("w:" + word.lower()), _bin("s:" + shape), _bin("t:" + word[-4:].lower() + shape[-1:])
        self.known[word] = got
        return got

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return np.array([_bin("empty")], dtype=np.int32), np.ones(1, dtype=np.float32)
        lines = text.decode("utf-8", "replace").split("\n")
        words = [w for line in lines for w in line.split()]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        get, make = self.known.get, self._bins
        single = np.array([get(w) or make(w) for w in words], dtype=np.int64).reshape(-1, 3)
        n = max(1, len(words))
        again = sum(a == b for a, b in zip(words, words[1:])) / n
        variety = len(set(words)) / n
        extra = {
            _bin("again"): again, _bin("few words"): 1 - variety, _bin(f"length {min(12, n.bit_length())}"): 0.3,
            _bin("lines repeat"): 1 - len(set(lines)) / len(lines),
        }
        # shares of words, softened so that frequent words do not rule
        bins, counts = np.unique(single.T.ravel(), return_counts=True) if len(words) else (np.empty(0, np.int64), np.empty(0))
        values = np.sqrt(counts / (3 * n))
        bins = np.concatenate([bins, np.fromiter(extra, dtype=np.int64)])
        values = np.concatenate([values, np.sqrt(np.fromiter(extra.values(), dtype=float))])
        return bins.astype(np.int32), values.astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, bins: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(float(self.weights[bins] @ values) - self.thresholds, -40, 40)))


def fit_ordinal(rows: np.ndarray, bins: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood by Adam over all rows at once; ``rows`` names the row of each bin and value.

    The thresholds are a first one and positive gaps, so they stay in order.
    """
    n = len(grades)
    if not n:
        return Model(np.zeros(BINS, dtype=np.float32), np.arange(n_grades - 1, dtype=float))
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, n), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    theta = np.concatenate([np.zeros(BINS), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        cuts = np.cumsum(np.concatenate([theta[BINS : BINS + 1], np.exp(theta[BINS + 1 :])]))
        z = np.bincount(rows, weights=values * theta[bins], minlength=n)
        # P(grade <= k) at both ends of each row's grade
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = _sigmoid(edges[grades + 1] - z), _sigmoid(edges[grades] - z)
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        by_row = (d_high - d_low) / n  # of the negative log-likelihood by z
        by_cut = np.zeros(n_grades - 1)
        np.add.at(by_cut, grades[grades < n_grades - 1], -d_high[grades < n_grades - 1] / n)
        np.add.at(by_cut, grades[grades > 0] - 1, d_low[grades > 0] / n)
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([
            np.bincount(bins, weights=values * by_row[rows], minlength=BINS) + PENALTY * theta[:BINS],
            tail[:1], tail[1:] * np.exp(theta[BINS + 1 :]),
        ])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = np.cumsum(np.concatenate([theta[BINS : BINS + 1], np.exp(theta[BINS + 1 :])]))
    return Model(theta[:BINS].astype(np.float32), cuts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(
    docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, text: str = "text", doc_id: str = "doc_id",
    rows: int = FIT_ROWS,
) -> Model:
    """Fit on at most ``rows`` rows of ``labels`` that may be learned from; ``grade`` runs from 0 to n_grades - 1.

    Null grades are left out; grades of one id count once, the largest. Without any row the thresholds are even.
    """
    few = stage(sample(training_labels(labels, grade, doc_id), rows), "quality-sample")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def make():
        bag = Bagger()
        return lambda batch: [dict(zip(("bins", "values"), bag(t))) for t in batch]

    # at most `rows` ids
    bags = stage(with_struct(texts.join(F.broadcast(few), "id"), "text", "bag", _BAG, make, keep=["label"]), "quality-bags")

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, sizes, bins, values = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, np.int32)], [np.empty(0, np.float32)]
        for b in batches:
            bag = b.column("bag")
            grades.append(b.column("label").to_numpy(zero_copy_only=False))
            sizes.append(np.diff(bag.field("bins").offsets.to_numpy()))
            bins.append(bag.field("bins").flatten().to_numpy())
            values.append(bag.field("values").flatten().to_numpy())
        size = np.concatenate(sizes)
        model = fit_ordinal(
            np.repeat(np.arange(len(size)), size), np.concatenate(bins), np.concatenate(values),
            np.clip(np.concatenate(grades), 0, n_grades - 1).astype(int), n_grades,
        )
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tolist()]})

    row = bags.coalesce(1).mapInArrow(learn, "weights binary, thresholds array<double>").first()
    if row is None:
        return Model(np.zeros(BINS, dtype=np.float32), np.arange(n_grades - 1, dtype=float))
    return Model(np.frombuffer(row.weights, dtype=np.float32), np.array(row.thresholds))


def grade(docs: DataFrame, model: Model, text: str = "text", out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: ``expected_grade`` and ``tails``, P(grade >= k) for each k from 1.

    Null and empty texts have the feature "empty" alone; equal texts get equal grades. A column already
    called ``out`` is replaced; other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights: 1 MB

    def make():
        model, bag = shared.value, Bagger()

        def fn(texts: list[bytes | None]) -> list[dict]:
            tails = [model.tails(*bag(t)) for t in texts]
            return [{"expected_grade": float(p.sum()), "tails": p.tolist()} for p in tails]

        return fn

    return with_struct(docs, text, out, FIELDS, make, keep)


def select(docs: DataFrame, model: Model, least: int = 1, probability: float = 0.5) -> DataFrame:
    """``docs`` whose grade is at least ``least`` with the given probability, columns unchanged."""
    graded = grade(docs, model, out="_quality")
    return graded.where(F.col("_quality.tails")[least - 1] >= probability).drop("_quality")
