"""Quality classifier by co-training on two views of a document.

One classifier sees the text, as ratios that describe how it is written; the other sees the page's
metadata (columns such as language, source and size) and never the text. Both start from the same
labelled rows. In every round each labels the unlabelled rows that it is surest of, as many good
as bad ones in proportion, for the other one to learn from. Both are then calibrated on labelled rows
that neither has seen, and a last small model joins their log odds to one score.

The models are fitted on bounded samples; every document is scored, in one narrow pass."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm import common

LABELLED_ROWS, UNLABELLED_ROWS = 12_000, 12_000  # at most about as many rows are fitted on
ROUNDS = 4
SURE = 0.97  # probability from which a pseudo-label is given
GIVEN_PER_ROUND = 0.1  # of the unlabelled rows, at most, by each view
CALIBRATION_SHARE = 0.25  # of the labelled rows
METADATA_BUCKETS = 256
RIDGE = 1e-3

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"
_HIGH = bytes(range(128, 256))
TEXT_FEATURES = 14


def text_features(raw: bytes) -> list[float]:
    """How a text is written; an empty text is all zeros but its length."""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))

    def share(characters):
        return (len(raw) - len(raw.translate(None, characters))) / size

    lines = [line for line in raw.split(b"\n") if line.strip()]
    pairs = list(zip(words, words[1:]))
    return [
        share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS), share(_HIGH), share(b".,;:"),
        len(set(words)) / n,
        sum(a == b for a, b in pairs) / n,
        len(set(pairs)) / n,
        min(40.0, size / n),
        1 - len(set(lines)) / max(1, len(lines)),
        min(50.0, n / max(1, len(lines))),
        sum(w in (b"|", b"-", b"*", b">") for w in words) / n,
        math.log1p(len(words)),
    ]


def _metadata(columns: list[str], schema) -> list[Column]:
    """Each metadata value as a bucket number; numbers by their order of magnitude, null apart."""
    out = []
    for name in columns:
        value = F.col(name)
        if isinstance(schema[name].dataType, T.NumericType):
            value = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1))
        text = F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("null")))
        out.append(F.pmod(F.xxhash64(text), F.lit(METADATA_BUCKETS)).cast("int"))
    return out


def _view_rows(docs, id_col, text_col, metadata):
    return docs.select(
        F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"),
        F.array(*_metadata(metadata, docs.schema)).cast("array<int>").alias("_meta"),
    )


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _one_hot(buckets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(buckets), METADATA_BUCKETS), np.float32)
    out[np.arange(len(buckets))[:, None], buckets] = 1
    return out


@dataclass
class View:
    """A logistic model of standardised features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x):
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def calibrated(self, x):
        return np.clip(self.slope * self.odds(x) + self.shift, -30, 30)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x, y, ridge=RIDGE, steps=30):
    """Weights and bias by Newton steps; the bias is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) / len(y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_view(x, y) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    return View(mean, scale, *logistic((x - mean) / scale, y))


def _surest(p, free, rate, n):
    """Rows among the free ones that a view is surest of, good and bad in the labelled proportion."""
    good = np.flatnonzero(free & (p >= SURE))
    bad = np.flatnonzero(free & (p <= 1 - SURE))
    good = good[np.argsort(-p[good], kind="stable")][: math.ceil(n * rate)]
    bad = bad[np.argsort(p[bad], kind="stable")][: math.ceil(n * (1 - rate))]
    return np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])


def co_train(text, meta, y, free_text, free_meta) -> list[View]:
    """The text view and the metadata view after exchanging pseudo-labels."""
    views, pools = [text, meta], [free_text, free_meta]
    sets = [(text, y), (meta, y)]
    given = [np.zeros(len(free_text), bool), np.zeros(len(free_meta), bool)]
    models = [fit_view(*s) for s in sets]
    rate, n = float(np.mean(y)), int(GIVEN_PER_ROUND * len(free_text))
    for _ in range(ROUNDS if n else 0):
        for giver, taker in ((0, 1), (1, 0)):
            rows, labels = _surest(_sigmoid(models[giver].odds(pools[giver])), ~given[taker], rate, n)
            given[taker][rows] = True
            x, known = sets[taker]
            sets[taker] = np.vstack([x, pools[taker][rows]]), np.concatenate([known, labels])
        models = [fit_view(*s) for s in sets]
    return models


@dataclass
class Model:
    text: View
    meta: View
    weights: np.ndarray  # of the two views' calibrated log odds
    bias: float

    def score(self, text, meta):
        both = np.column_stack([self.text.calibrated(text), self.meta.calibrated(meta)])
        return _sigmoid(both @ self.weights + self.bias)


def _calibrate(models, views, y):
    for view, x in zip(models, views):
        slope, shift = logistic(view.odds(x)[:, None], y)
        view.slope, view.shift = float(max(slope[0], 0.0)), shift
    both = np.column_stack([v.calibrated(x) for v, x in zip(models, views)])
    weights, bias = logistic(both, y, ridge=1e-2)
    return Model(*models, np.maximum(weights, 0.0), bias)


def _sampled(rows, column, limit, total, salt):
    """Rows thinned by their id's hash to about ``limit``."""
    parts = 1 << 20
    place = F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit(salt)), F.lit(parts))
    return rows.filter(place < parts * min(1.0, limit / max(1, total)))


def _features(rows: DataFrame) -> DataFrame:
    def run(block):
        texts = common.string_array(block.column("_text")).cast(pa.binary()).to_pylist()
        made = pa.array([text_features(t) for t in texts], pa.list_(pa.float64()))
        keep = [n for n in block.schema.names if n != "_text"]
        return pa.record_batch([*(block.column(n) for n in keep), made], [*keep, "_features"])

    schema = rows.drop("_text").schema.add("_features", T.ArrayType(T.DoubleType()))
    return common.run_arrow(rows, run, schema, "_text")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
        metadata=("lang", "source", "n_chars"), learn: Column | None = None) -> Model | None:
    """A model of ``label_col`` (1: good); None without labelled rows of both classes.

    Of several labels of an id the smallest counts. Only label rows that meet ``learn`` are used."""
    marked = labels.filter((F.lit(True) if learn is None else learn) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("_labelled")).agg(F.min(F.col(label_col).cast("int")).alias("_label"))
    chosen = _sampled(marked, "_labelled", LABELLED_ROWS, marked.count(), "labelled")
    rows = _view_rows(docs, id_col, text_col, list(metadata))
    # at most about LABELLED_ROWS rows
    known = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled")).drop("_labelled")
    free = _sampled(rows.filter(F.col("_id").isNotNull()), "_id", UNLABELLED_ROWS, docs.count(), "unlabelled")
    free = free.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled"), "left_anti").withColumn("_label", F.lit(None).cast("int"))
    got = _features(known.unionByName(free)).orderBy("_id", "_features").toArrow()
    if not got.num_rows:
        return None
    text, meta = _matrix(got["_features"].combine_chunks()), _one_hot(_matrix(got["_meta"].combine_chunks()))
    label = got["_label"].fill_null(-1).to_numpy()
    known = np.flatnonzero(label >= 0)
    if len(set(label[known])) < 2:
        return None
    every = round(1 / CALIBRATION_SHARE)
    apart = np.arange(len(known)) % every == every - 1
    train, check, unknown = known[~apart], known[apart], np.flatnonzero(label < 0)
    if len(set(label[train])) < 2 or len(set(label[check])) < 2:
        train = check = known
    models = co_train(text[train], meta[train], label[train].astype(float), text[unknown], meta[unknown])
    return _calibrate(models, [text[check], meta[check]], label[check].astype(float))


def score(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text",
          metadata=("lang", "source", "n_chars")) -> DataFrame:
    """(id, text_score, metadata_score, score) of every row; all 0.5 without a model.

    Null texts count as empty, null metadata as a value of its own."""
    rows = _view_rows(docs, id_col, text_col, list(metadata))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(block):
        texts = common.string_array(block.column("_text")).cast(pa.binary()).to_pylist()
        scores = np.full((3, len(texts)), 0.5)
        if model is not None:
            text = np.array([text_features(t) for t in texts])
            meta = _one_hot(_matrix(block.column("_meta")))
            scores = [_sigmoid(model.text.calibrated(text)), _sigmoid(model.meta.calibrated(meta)), model.score(text, meta)]
        return pa.record_batch(
            [block.column("_id"), *(pa.array(np.asarray(s, float)) for s in scores)],
            ["_id", "text_score", "metadata_score", "score"],
        )

    found = common.run_arrow(rows, run, f"_id {kind}, text_score double, metadata_score double, score double", "_text")
    return found.withColumnRenamed("_id", id_col)
