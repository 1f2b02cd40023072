"""Toxicity from class-conditional Kneser-Ney models of the letters of words.

Two models predict each letter from the six before it in its word. Their highest order holds the
counts of one class; both back off to the same lower orders, whose continuation counts come from both
classes together, so an expression that neither class has seen weighs nothing either way. A text is
judged by its length-normalised log-likelihood under the toxic model less that under the ordinary one:
over the whole text, and over its most toxic stretch of words, which a long text would otherwise hide.
A logistic curve, fitted on rows that its models have not counted, turns these into a probability.

Counting covers every labelled row that may be learned from, and every letter group is kept with its own
counts: Spark counts words, cuts the distinct ones into groups, and computes the shared orders and the ratios
as tables. The ratios are written in blocks, each a range of keys. A task that scores gathers the words of
many texts and looks up the groups of the new ones block by block, so neither the driver nor a task holds all
groups. Lookups go by a 64-bit hash of the group's letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strandwise.llm.columns import give_back, with_struct
from strandwise.llm.filters import with_flag
from strandwise.llm.labelled import sample, training_labels
from strandwise.llm.token_records import filesystem
from strandwise.session import stage

ORDER = 7
BITS = 21  # of a letter in a packed group: any code point
DISCOUNT = 0.75
STRETCH = 3  # words
STRONG = 3.0  # log-likelihood ratio of a word that counts as strong
FEATURES = 5
CALIBRATION_ROWS = 20_000
CACHED_WORDS = 1 << 18
ROWS = 256
PIECE = 64  # letters of a padded word that are counted together
BLOCK = 1 << 18  # keys in a file of ratios
KEPT_KEYS = 1 << 22  # that a task keeps in memory, 64 MB; blocks beyond them are read again for each lookup
LOOKUP_BYTES = 1 << 24  # of texts whose words are looked up together
PART_BYTES = 1 << 22  # the same inside a batch that Spark hands over

_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x01", "\x02"
_LETTER = (1 << BITS) - 1
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))])


def words_of(text: bytes | None) -> list[str]:
    return [] if not text else _WORD.findall(text.decode("utf-8", "replace").lower())


def letter_groups(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ORDER letters packed as whole numbers of any size, for all words in turn, and the number of groups of each word."""
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    pad = _START * (ORDER - 1)
    letters = np.frombuffer("".join([f"{pad}{w}{_END}" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(object)
    packed = letters[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        packed |= letters[ORDER - 1 - k : len(letters) - k] << (BITS * k)
    first = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return packed[np.repeat(first, lengths) + within], lengths


# --- counts --------------------------------------------------------------------------------------

CLASSES = ["c0", "c1", "c2", "c3"]  # label * 2 + half


def pieces_of(word: str) -> list[str]:
    """The word with its markers, in pieces of bounded length that hold each of its letter groups once."""
    padded = _START * (ORDER - 1) + word + _END
    return [padded[at : at + PIECE] for at in range(0, len(padded) - ORDER + 1, PIECE - ORDER + 1)]


def count_groups(rows: DataFrame) -> DataFrame:
    """``gram`` and its counts in each class and half of ``rows`` (text, label, half), for every distinct group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held = [Counter() for _ in CLASSES]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                group = (part.column("label").to_numpy(zero_copy_only=False) > 0) * 2 + part.column("half").to_numpy(zero_copy_only=False)
                for g, text in zip(group.tolist(), texts):
                    held[g].update(words_of(text))
                if sum(map(len, held)) > CACHED_WORDS:
                    yield from _counted(held)
        yield from _counted(held)

    counted = rows.select("text", "label", "half").mapInArrow(run, "piece string, " + ", ".join(f"{n} long" for n in CLASSES))
    sums = [F.sum(n).alias(n) for n in CLASSES]
    pieces = counted.groupBy("piece").agg(*sums)
    cut = F.transform(F.sequence(F.lit(1), F.length("piece") - (ORDER - 1)), lambda i: F.substring(F.col("piece"), i, F.lit(ORDER)))
    return pieces.select(F.explode(cut).alias("gram"), *CLASSES).groupBy("gram").agg(*sums)


def _counted(held: list[Counter]) -> Iterator[pa.RecordBatch]:
    for g, counter in enumerate(held):
        pieces, counts = [], []
        for word, n in counter.items():
            cut = pieces_of(word)
            pieces += cut
            counts += [n] * len(cut)
        counter.clear()
        if pieces:
            zeros = np.zeros(len(pieces), dtype=np.int64)
            columns = [pa.array(counts, pa.int64()) if k == g else pa.array(zeros) for k in range(len(CLASSES))]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), *columns], names=["piece", *CLASSES])


# --- tables of the models ------------------------------------------------------------------------

MODELS = {"half": ("c0", "c2"), "full": ("c0 + c1", "c2 + c3")}  # counts of ordinary and toxic rows


def shared_orders(grams: DataFrame) -> DataFrame:
    """``tail`` (all but the first letter of a group) and its Kneser-Ney probability in each of MODELS.

    Continuation counts of an order are the distinct types of the order above it, which are counted in turn.
    """
    types = grams.select(F.col("gram").alias("s"), *[(F.expr(f"{a} + {b}") > 0).alias(m) for m, (a, b) in MODELS.items()])
    levels = {}
    for k in range(ORDER - 1, 0, -1):
        counted = types.groupBy(F.substring("s", -k, k).alias("s")).agg(*[F.sum(F.col(m).cast("long")).alias(f"n_{m}") for m in MODELS])
        levels[k] = stage(counted, f"toxicity-types-{k}")
        types = levels[k].select("s", *[(F.col(f"n_{m}") > 0).alias(m) for m in MODELS])
    shared = None
    for k in range(1, ORDER):
        level = levels[k].withColumn("context", F.substring("s", 1, k - 1)).withColumn("tail", F.substring("s", -(k - 1), k - 1) if k > 1 else F.lit(""))
        totals = level.groupBy("context").agg(
            *[F.sum(f"n_{m}").alias(f"total_{m}") for m in MODELS], *[F.sum((F.col(f"n_{m}") > 0).cast("long")).alias(f"types_{m}") for m in MODELS]
        )
        rows = level.join(totals, "context")
        if shared is not None:
            rows = rows.join(shared, "tail")
        made = []
        for m in MODELS:
            n, total, followers = (F.col(f"{c}_{m}") for c in ("n", "total", "types"))
            below = F.col(f"p_{m}") if shared is not None else 1 / followers
            made.append(F.when(n > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * followers * below) / total).alias(f"p_{m}"))
        shared = stage(rows.select(F.col("s").alias("tail"), *made), f"toxicity-order-{k}")
    return shared


def ratio_table(grams: DataFrame) -> DataFrame:
    """``name``, a letter group or a context (all but its last letter), and its log-likelihood ratio in each of MODELS."""
    sides = {f"{m}_{side}": F.expr(count) for m, pair in MODELS.items() for side, count in zip(("o", "t"), pair)}
    rows = grams.select("gram", F.substring("gram", 1, ORDER - 1).alias("context"), F.substring("gram", 2, ORDER - 1).alias("tail"), *[c.alias(k) for k, c in sides.items()])
    totals = rows.groupBy("context").agg(*[F.sum(k).alias(f"total_{k}") for k in sides], *[F.sum((F.col(k) > 0).cast("long")).alias(f"types_{k}") for k in sides])
    # a context that a class has not seen leaves everything to the shared orders
    backs = [F.when(F.col(f"total_{k}") > 0, DISCOUNT * F.col(f"types_{k}") / F.col(f"total_{k}")).otherwise(1.0).alias(f"back_{k}") for k in sides]
    contexts = stage(totals.select("context", *[f"total_{k}" for k in sides], *backs), "toxicity-contexts")
    own = {m: (F.log(f"back_{m}_t") - F.log(f"back_{m}_o")) for m in MODELS}
    full = rows.join(contexts, "context").join(shared_orders(grams), "tail")

    def log_of(m: str, side: str):
        k = f"{m}_{side}"
        return F.log(F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total_{k}"), F.lit(1)) + F.col(f"back_{k}") * F.col(f"p_{m}"))

    # a group that neither class has in the half goes by its context
    known = {m: F.when(F.col(f"{m}_o") + F.col(f"{m}_t") > 0, log_of(m, "t") - log_of(m, "o")).otherwise(own[m]) for m in MODELS}
    return full.select(F.col("gram").alias("name"), *[c.alias(m) for m, c in known.items()]).unionByName(
        contexts.select(F.col("context").alias("name"), *[c.alias(m) for m, c in own.items()])
    )


_FACTORS = np.random.default_rng(7).integers(1 << 62, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of all letter groups of the words in turn and of their contexts, and the number of groups of each word."""
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    pad = _START * (ORDER - 1)
    letters = np.frombuffer("".join([f"{pad}{w}{_END}" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(letters) - ORDER + 1
    contexts = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER - 1):
        contexts += letters[k : k + n] * _FACTORS[k]
    grams = contexts + letters[ORDER - 1 :] * _FACTORS[-1]
    first = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    at = np.repeat(first, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return grams[at].view(np.int64), contexts[at].view(np.int64), lengths


def _key_of_names(names: list[str]) -> np.ndarray:
    """The keys of letter groups and contexts given as strings."""
    letters = np.array(names, dtype=f"U{ORDER}").view(np.uint32).reshape(-1, ORDER).astype(np.uint64)
    return (letters * _FACTORS).sum(axis=1, dtype=np.uint64).view(np.int64)


@dataclass
class Blocks:
    """Written ratios: files of sorted keys, each with its smallest and largest key."""

    files: list[tuple[int, int, int, str]]  # first, last, keys, path


def write_blocks(table: DataFrame) -> Blocks:
    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _key_of_names(batch.column("name").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[batch.column(m) for m in MODELS]], names=["key", *MODELS])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("key").to_numpy()
                values = [batch.column(m).to_numpy() for m in MODELS]
                columns = [[int(keys[0])], [int(keys[-1])], [len(keys)], [keys.tobytes()], *[[v.tobytes()] for v in values]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["first", "last", "n", "keys", *MODELS])

    table = stage(table.mapInArrow(keyed, "key long, " + ", ".join(f"{m} double" for m in MODELS)), "toxicity-ratios")
    parts = max(1, -(-table.count() // BLOCK))
    sorted_rows = table.repartitionByRange(parts, "key").sortWithinPartitions("key")
    blocks = stage(sorted_rows.mapInArrow(packed, "first long, last long, n long, keys binary, " + ", ".join(f"{m} binary" for m in MODELS)), "toxicity-blocks")
    files = blocks.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("first"), F.max("last"), F.sum("n"))
    return Blocks(sorted((first, last, n, path) for path, first, last, n in files.collect()))


# --- models --------------------------------------------------------------------------------------


@dataclass
class Ratios:
    """Log-likelihood ratio of each known group, and of an unknown group by its first letters.

    Models held in memory: what ``ratio_table`` computes in Spark, in plain form.
    """

    grams: np.ndarray
    of_gram: np.ndarray
    contexts: np.ndarray
    of_context: np.ndarray

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = _look_up(self.contexts, self.of_context, grams >> BITS)
        return _look_up(self.grams, self.of_gram, grams, out)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: np.ndarray | float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted)) + otherwise
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def _shared(grams: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last letter of each group from continuation counts of all lower orders."""
    p = np.full(len(grams), 1.0 / max(1, len(np.unique(grams & _LETTER))))
    for order in range(1, ORDER):
        low = (1 << (BITS * order)) - 1
        # distinct groups one letter longer stand for the counts of this order
        longer = np.unique(grams & ((1 << (BITS * (order + 1))) - 1)) & low
        types, n = np.unique(longer, return_counts=True)
        contexts, where = np.unique(types >> BITS, return_inverse=True)
        total, followers = np.bincount(where, weights=n), np.bincount(where)
        wanted = grams & low
        i = np.searchsorted(types, wanted)
        c = where[i]
        p = (np.maximum(n[i] - DISCOUNT, 0) + DISCOUNT * followers[c] * p) / total[c]
    return p


def fit_ratios(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Ratios:
    """Both models from their counts of the same groups."""
    order = np.argsort(grams)
    grams, counts = grams[order], np.stack([ordinary[order], toxic[order]]).astype(float)
    known = counts.sum(axis=0) > 0
    grams, counts = grams[known], counts[:, known]
    if not len(grams):
        return Ratios(grams, np.empty(0), grams, np.empty(0))
    lower = _shared(grams)
    contexts, where = np.unique(grams >> BITS, return_inverse=True)
    logs, backs = [], []
    for c in counts:
        total = np.bincount(where, weights=c)
        followers = np.bincount(where, weights=c > 0)
        # a context that this class has not seen leaves everything to the shared orders
        back = np.where(total > 0, DISCOUNT * followers / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[where] + back[where] * lower))
        backs.append(np.log(back))
    return Ratios(grams, logs[1] - logs[0], contexts, backs[1] - backs[0])


class Lookup:
    """Ratios of letter groups from written blocks; of an unknown group by its context, of an unknown context 0."""

    def __init__(self, blocks: Blocks, model: str):
        self.files, self.model = blocks.files, model
        self.kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.room = KEPT_KEYS

    def __call__(self, grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        wanted, place = np.unique(np.concatenate([grams, contexts]), return_inverse=True)
        found = np.full(len(wanted), np.nan)
        for first, last, n, path in self.files:
            lo, hi = np.searchsorted(wanted, first), np.searchsorted(wanted, last, side="right")
            if lo < hi:
                found[lo:hi] = np.fmax(found[lo:hi], _look_up(*self._block(path, n), wanted[lo:hi], np.nan))
        of_gram, of_context = found[place[: len(grams)]], found[place[len(grams) :]]
        return np.where(np.isnan(of_gram), np.nan_to_num(of_context), of_gram)

    def _block(self, path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        if path in self.kept:
            return self.kept[path]
        store, inside = filesystem(path)
        with store.open_input_file(inside) as f:
            rows = pq.read_table(f, columns=["keys", self.model])
        keys, values = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in (("keys", np.int64), (self.model, np.float64)))
        if n <= self.room:
            self.room -= n
            self.kept[path] = keys, values
        return keys, values


class Scorer:
    """Features of texts; the ratios of words seen before are kept."""

    def __init__(self, ratios: Lookup):
        self.ratios = ratios
        self.known: dict[str, float] = {}

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        distinct: set[str] = set()
        for text in texts:
            distinct.update(words_of(text))
        new = [w for w in distinct if w not in known]
        if new:
            grams, contexts, lengths = keys_of(new)
            known.update(zip(new, np.add.reduceat(self.ratios(grams, contexts), np.cumsum(lengths) - lengths).tolist()))
        return np.array([self._features(words_of(t)) for t in texts]).reshape(-1, FEATURES)

    def _features(self, words: list[str]) -> list[float]:
        if not words:
            return [0.0, 0.0, 0.0, 0.0, float(np.log(0.01))]
        ratio = np.array([*map(self.known.__getitem__, words)])
        length = np.array([*map(len, words)]) + 1.0
        n = min(STRETCH, len(words))
        up, along = np.concatenate([[0], np.cumsum(ratio)]), np.concatenate([[0], np.cumsum(length)])
        stretch = (up[n:] - up[:-n]) / (along[n:] - along[:-n])
        strong = float((ratio > STRONG).sum())
        return [
            float(up[-1] / along[-1]), float(stretch.max()), float((ratio / length).max()), float(np.log1p(strong)),
            float(np.log((strong + 0.5) / (len(words) + 50))),
        ]


@dataclass
class Model:
    ratios: Blocks
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.centre) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _calibrate(ratios: Blocks, features: np.ndarray, label: np.ndarray) -> Model:
    """Logistic regression by Newton steps with a slight penalty on the weights."""
    centre, scale = (features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)) if len(features) else (np.zeros(FEATURES), np.ones(FEATURES))
    x = np.hstack([(features - centre) / scale, np.ones((len(features), 1))])
    w = np.zeros(FEATURES + 1)
    penalty = np.diag([1e-2] * FEATURES + [1e-6])
    for _ in range(30 if len(features) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - label) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(ratios, centre, scale, w[:-1], float(w[-1]))


# --- the operator --------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> Model:
    """Models from every labelled row that may be learned from; rows with null labels or texts add nothing.

    The curve is fitted on at most ``CALIBRATION_ROWS`` of those rows, scored by a model of the other half.
    """
    usable = training_labels(labels, F.col(toxic))
    usable = stage(usable.withColumn("half", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)).cast("long")), "toxicity-labels")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # only texts that may be labelled are shuffled, in one way at every size
    asked = with_flag(texts, F.xxhash64("id"), usable.select(F.xxhash64("id").alias("key")), "_may").where("_may").drop("_may")
    grams = stage(count_groups(asked.hint("merge").join(usable, "id")), "toxicity-groups")
    blocks = write_blocks(ratio_table(grams))
    few = stage(sample(usable.where("half = 1").select("id", "label"), CALIBRATION_ROWS), "toxicity-sample")
    rows = with_struct(texts.join(F.broadcast(few), "id"), "text", "made", FIELDS, _featurer(blocks), keep=["label"], least_bytes=LOOKUP_BYTES)
    got = rows.select("label", "made.features").toArrow()
    features = np.array(got["features"].to_pylist(), dtype=float).reshape(-1, FEATURES)
    return _calibrate(blocks, features, (got["label"].to_numpy() > 0).astype(float))


def _featurer(blocks: Blocks):
    def make():
        scorer = Scorer(Lookup(blocks, "half"))
        return lambda texts: [{"score": None, "features": f} for f in scorer(texts).tolist()]

    return make


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: ``score`` (0 to 1) and the ``features`` it comes from.

    Null and empty texts, and texts without letters, get the score of a text of which nothing is known.
    Equal texts score alike. A column already called ``out`` is replaced; other columns stay.
    """
    # the names of its files, not its groups
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        scorer = Scorer(Lookup(model.ratios, "full"))

        def fn(texts: list[bytes | None]) -> list[dict]:
            features = scorer(texts)
            return [{"score": p, "features": f} for p, f in zip(model.probability(features).tolist(), features.tolist())]

        return fn

    return with_struct(docs, text, out, FIELDS, make, keep, LOOKUP_BYTES)


def scored_by(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """The score as a function of a text column. Texts go to Python and numbers come back; all else stays in the JVM."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        model = shared.value
        scorer = Scorer(Lookup(model.ratios, "full"))
        for batch in texts:
            found: list[float] = []
            held: list[bytes | None] = []
            size = 0
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS).cast(pa.binary()).to_pylist()
                held += part
                size += sum(map(len, filter(None, part)))
                if size >= PART_BYTES or at + ROWS >= len(batch):
                    found += model.probability(scorer(held)).tolist()
                    held, size = [], 0
            yield pa.array(found, pa.float64())

    return scores


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score stays below ``threshold``, columns unchanged whatever their names.

    Null and empty texts are judged like texts of which nothing is known; equal texts go or stay together.
    """
    score_of = scored_by(docs.sparkSession, fit(docs, labels))
    return docs.where(score_of(F.col("text")) < threshold)
