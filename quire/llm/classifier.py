"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, released, small_batches

BITS = 15
RANK = 8
#: Bound of the labelled rows that the model is fitted on; the rows with the smallest id hashes are taken.
MAX_TRAIN = 6000
EPOCHS = 4
RATE, DECAY = 0.05, 1e-5
THRESHOLD = 0.3

STATS = ("log_words", "word_length", "symbols", "digits", "capitals", "distinct_words", "distinct_lines", "line_words", "commas_stops", "shouts", "bars", "top_word")


class Features(dict):
    """Hashed word and statistic features of a text; the table of word places is emptied when full."""

    def __init__(self, bits: int = BITS, most: int = 400_000):
        super().__init__()
        self.bits, self.most = bits, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = zlib.crc32(word) & ((1 << self.bits) - 1)
        return value

    def of(self, text: str, extra: tuple[float, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(places, values): words first, weighted by the root of their count and scaled to length 1."""
        raw = text.encode()
        words = raw.lower().split()
        n = max(1, len(words))
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        u, c = np.unique(places, return_counts=True)
        x = np.sqrt(c)
        x /= max(1e-9, np.sqrt(c.sum()))
        codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = max(1, len(raw))
        lines = [line for line in text.split("\n") if line.strip(BLANKS)]
        stats = (
            np.log1p(len(words)) / 8,
            chars / n / 10,
            min(1.0, codes[[35, 42, 36, 37, 38, 60, 62]].sum() / n),
            codes[48:58].sum() / chars * 5,
            codes[65:91].sum() / chars * 2,
            len(u) / n,
            len(set(lines)) / max(1, len(lines)),
            min(2.0, n / max(1, len(lines)) / 50),
            min(1.0, (codes[44] + codes[46]) / n * 4),
            min(1.0, codes[33] / n),
            min(1.0, codes[124] / n),
            c.max() / n if len(words) else 0.0,
            *extra,
        )
        at = np.arange(len(stats)) + (1 << self.bits)
        return np.concatenate([u, at]), np.concatenate([x, stats]).astype(np.float32)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def scores(model: dict, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Probabilities of label 1; pairs of features are summed in linear time by the sum-of-squares identity."""
    flat, x, at = np.concatenate(places), np.concatenate(values), _starts(np.asarray([len(p) for p in places]))
    vx = model["v"][flat] * x[:, None]
    s = np.add.reduceat(vx, at, axis=0)
    pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), at))
    z = model["b"] + np.add.reduceat(model["w"][flat] * x, at) + pairs
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(places: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, *, size: int, rank: int = RANK, epochs: int = EPOCHS, seed: int = 3) -> dict:
    """Minibatch AdaGrad on the logistic loss; both classes weigh alike up to a factor of three."""
    rng = np.random.default_rng(seed)
    model = {"b": 0.0, "w": np.zeros(size, np.float32), "v": (0.01 * rng.standard_normal((size, rank))).astype(np.float32)}
    if not len(labels):
        return model
    good = max(1e-3, min(1 - 1e-3, float(labels.mean())))
    model["b"] = float(np.log(good / (1 - good)))
    gw, gv = np.full(size, 1e-4, np.float32), np.full((size, rank), 1e-4, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), 32):
            rows = order[i : i + 32]
            lengths = np.asarray([len(places[r]) for r in rows])
            flat, x, at = np.concatenate([places[r] for r in rows]), np.concatenate([values[r] for r in rows]), _starts(lengths)
            vx = model["v"][flat] * x[:, None]
            s = np.add.reduceat(vx, at, axis=0)
            z = model["b"] + np.add.reduceat(model["w"][flat] * x, at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), at))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]).astype(np.float32) / len(rows)
            e = np.repeat(error, lengths)
            u, inverse = np.unique(flat, return_inverse=True)
            d = np.bincount(inverse, e * x, len(u)).astype(np.float32) + DECAY * model["w"][u]
            gw[u] += d * d
            model["w"][u] -= RATE * d / np.sqrt(gw[u])
            each = (e * x)[:, None] * (np.repeat(s, lengths, axis=0) - vx)
            for f in range(rank):
                d = np.bincount(inverse, each[:, f], len(u)).astype(np.float32) + DECAY * model["v"][u, f]
                gv[u, f] += d * d
                model["v"][u, f] -= RATE * d / np.sqrt(gv[u, f])
            model["b"] -= RATE * float(error.sum())
    return model


def held_out(doc_id) -> F.Column:
    """Rows whose labels the model never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, metadata: tuple[str, ...] = ()) -> dict:
    """Fit the model on at most ``max_train`` labelled rows, never a held-out one.

    The bound makes the fit's cost a constant: the labelled ids with the smallest hashes are chosen first, their
    texts become features on the executors, and only those (about 2 KB an id) reach the driver. An id is one row of the
    fit, however often its label or its document is repeated: its least label counts, and of its documents the one whose
    features come first.
    """
    small_batches(docs.sparkSession)
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out("doc_id"))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("own_id")).agg(F.min("quality").cast("int").alias("own_label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(23), F.col("own_id")), "own_id").limit(max_train)
    extra = [F.coalesce(F.col(c).cast("float"), F.lit(0.0)).cast("float").alias(f"m{i}") for i, c in enumerate(metadata)]
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).alias("own_text"), *extra).join(F.broadcast(chosen), "own_id")
    rows = rows.select("own_id", "own_label", "own_text", *(f"m{i}" for i in range(len(metadata))))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            more = list(zip(*(c.to_pylist() for c in batch.columns[3:]))) if metadata else [()] * batch.num_rows
            found = [features.of(t or "", m) for t, m in zip(batch.column(2).to_pylist(), more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                ["id", "label", "places", "values"],
            )

    made = rows.mapInArrow(released(featurise), "id long, label int, places binary, values binary")
    got = made.groupBy("id").agg(F.min(F.struct("places", "values", "label")).alias("x")).select("id", "x.*").toArrow().sort_by("id")
    places = [np.frombuffer(x, "<i4").astype(np.int64) for x in got["places"].to_pylist()]
    values = [np.frombuffer(x, "<f4") for x in got["values"].to_pylist()]
    return fit(places, values, np.asarray(got["label"].to_pylist(), np.float32), size=(1 << BITS) + len(STATS) + len(metadata))


def _scorer(model: dict, n_extra: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                more = list(zip(*(c.to_pylist() for c in part.columns[2:]))) if n_extra else [()] * part.num_rows
                found = [features.of(t or "", m) for t, m in zip(part.column(1).to_pylist(), more)]
                out.append(scores(model, [p for p, _ in found], [v for _, v in found]))
            score = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` of every row in one pass without a shuffle; the model has a fixed size of about 1 MB."""
    extra = [F.coalesce(F.col(c).cast("float"), F.lit(0.0)).cast("float").alias(f"m{i}") for i, c in enumerate(metadata)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    return rows.mapInArrow(released(_scorer(model, len(metadata))), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of docs, by a model trained on the labels.

    Null and empty texts are scored from the statistics of an empty text. Null ids are scored and not held out.
    Repeated rows get equal scores. Without labels every score is 0.5 or near it. An empty table gives no rows. The
    model reads the text and the ``metadata`` columns that a caller names (none by default): never lang, source,
    the id or a label.
    """
    model = train(docs, labels, **options)
    out = score(docs, model, **{k: v for k, v in options.items() if k != "max_train"})
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that score at least ``threshold``, all columns unchanged, in the pass that scores them.

    Null and empty texts are judged by the score of an empty text, null ids like others; repeated rows, and ties of equal
    texts, have one fate. An empty table gives no rows. Columns keep their names, whatever they are.
    """
    model, schema = train(docs, labels, id_col=id_col, text_col=text_col, max_train=max_train), docs.schema
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [features.of(t or "") for t in part.column(place).to_pylist()]
                good = scores(model, [p for p, _ in found], [v for _, v in found]) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(released(run), schema)
