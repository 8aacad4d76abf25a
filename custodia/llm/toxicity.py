"""Counterfactual-regularised toxicity classifier.

A text is the set of its words' features: the lower-cased word and its leading letters. A logistic
model is fitted on a bounded sample of labelled texts over the features that mark toxic texts most
surely. For every labelled sentence that names a group of people, variants name other groups of the
same kind instead; the fit penalises any change of the score, so that naming a group is not held
against a text.

Feature counts, the sample's features and the variants are made in Spark; the driver fits on at most
as many distinct feature sets as there are sampled texts. Scoring is a narrow pass over all texts."""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm import common
from custodia.session import materialize

TOXIC_ROWS, OTHER_ROWS = 5_000, 15_000  # at most about as many labelled texts are learnt from
FEATURES = 4_000
LEAST_TEXTS, LEAST_Z = 3, 3.0  # toxic texts that have a feature; its log odds over their error
PREFIXES = (3, 4, 5, 6)
RIDGE = 1e-4
STEPS, RATE = 400, 0.05
PENALTY = 5.0  # on squared score changes between a sentence and its variants
VARIANTS = 3
WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")

# fixed values: words that name groups of people, by kind and language; a variant names its neighbours
GROUPS = """
muslim christian jewish hindu buddhist sikh catholic protestant atheist mormon
muslims christians jews hindus buddhists sikhs catholics protestants atheists mormons
black white asian latino african european arab indian hispanic indigenous
american british french german spanish chinese japanese mexican russian turkish polish nigerian
americans germans russians turks poles mexicans nigerians arabs africans europeans asians
woman man girl boy
women men girls boys
female male nonbinary transgender
gay straight lesbian bisexual queer heterosexual
gays lesbians bisexuals heterosexuals
old young elderly teenage
blind deaf disabled autistic paralyzed
immigrant refugee migrant foreigner citizen
immigrants refugees migrants foreigners citizens
muslimisch christlich jüdisch hinduistisch buddhistisch katholisch evangelisch
muslime christen juden hindus buddhisten katholiken
frauen männer mädchen jungen
ausländer flüchtlinge migranten einwanderer
femmes hommes filles garçons
musulmans chrétiens juifs hindous bouddhistes
immigrés réfugiés migrants étrangers
mujeres hombres chicas chicos
musulmanes cristianos judíos hindúes budistas
inmigrantes refugiados migrantes extranjeros
"""


def _swaps():
    other = {}
    for line in GROUPS.split("\n"):
        names = line.split()
        for i, name in enumerate(names):
            for step in range(1, min(VARIANTS, len(names) - 1) + 1):
                other.setdefault(name, []).append(names[(i + step) % len(names)])
    return other


SWAPS = _swaps()


def word_features(word: str) -> list[str]:
    """The word and its leading letters, the latter marked."""
    return [f"{word[:n]}-" for n in PREFIXES if len(word) >= n] + [word]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def variants(sentence: str):
    """The sentence with each named group replaced by another one of its kind."""
    words = WORD.findall(sentence.lower())
    named = [w for w in words if w in SWAPS]
    for step in range(max((len(SWAPS[w]) for w in named), default=0)):
        yield [SWAPS[w][step % len(SWAPS[w])] if w in SWAPS else w for w in words]


@dataclass
class Model:
    """Weights of the chosen features; scores are probabilities."""

    weights: dict
    bias: float

    def score(self, text: str, known: dict) -> float:
        """``known`` keeps the features of the words met so far; a feature counts once."""
        found = set()
        for word in set(WORD.findall(text.lower())):
            hits = known.get(word)
            if hits is None:
                hits = known[word] = tuple(f for f in word_features(word) if f in self.weights)
            if hits:
                found.update(hits)
        total = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _sample(docs, labels, id_col, text_col, label_col, learn):
    """(_text, label) of a bounded sample of the labelled rows that may be learnt from."""
    marked = (
        labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    counts = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(parts))
    limit = F.lit(0.0)
    for label, rows in ((1, TOXIC_ROWS), (0, OTHER_ROWS)):
        limit = F.when(F.col("label") == label, parts * min(1.0, rows / max(1, counts.get(label, 0)))).otherwise(limit)
    chosen = materialize(marked.filter(place < limit), "toxicity-ids")
    texts = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))
    # bounded by TOXIC_ROWS and OTHER_ROWS
    return texts.join(F.broadcast(chosen), "_id").select("_text", "label"), counts


def _count_features(block):
    counts = Counter()
    for text, label in zip(block.column("_text").to_pylist(), block.column("label").to_pylist()):
        counts.update((f, label) for f in features(text))
    names = sorted(counts)
    return pa.record_batch(
        [
            pa.array([n for n, _ in names], pa.string()),
            pa.array([counts[k] if k[1] else 0 for k in names], pa.int64()),
            pa.array([0 if k[1] else counts[k] for k in names], pa.int64()),
        ],
        ["feature", "toxic", "other"],
    )


def _choose(sample, toxic, other):
    """The features that mark toxic texts most surely."""
    counts = common.run_arrow(sample, _count_features, "feature string, toxic long, other long", "_text")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    t, o = F.col("t") + 0.5, F.col("o") + 0.5
    odds = F.log(t / (F.lit(toxic + 1.0) - t)) - F.log(o / (F.lit(other + 1.0) - o))
    surely = odds / F.sqrt(1 / t + 1 / o)
    chosen = counts.filter((F.col("t") >= LEAST_TEXTS) & (surely >= LEAST_Z)).select("feature", surely.alias("z"))
    return [r.feature for r in chosen.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]


def _rows_of(sample, names):
    """Distinct (features, label) with counts, and distinct (lost, gained) of the variants with counts."""
    number = {f: i for i, f in enumerate(names)}

    def ids(words):
        return sorted({number[f] for w in set(words) for f in word_features(w) if f in number})

    def run(block):
        kinds, lost, gained, labels = [], [], [], []
        for text, label in zip(block.column("_text").to_pylist(), block.column("label").to_pylist()):
            text = text.lower()
            kinds.append("text"), lost.append(ids(WORD.findall(text))), gained.append([]), labels.append(label)
            for sentence in SENTENCE_END.split(text):
                words = WORD.findall(sentence)
                if any(w in SWAPS for w in words):
                    own = set(ids(words))
                    for changed in variants(sentence):
                        new = set(ids(changed))
                        if new != own:
                            kinds.append("pair"), lost.append(sorted(own - new)), gained.append(sorted(new - own))
                            labels.append(0)
        lists = pa.list_(pa.int32())
        return pa.record_batch(
            [pa.array(kinds, pa.string()), pa.array(lost, lists), pa.array(gained, lists), pa.array(labels, pa.int32())],
            ["kind", "lost", "gained", "label"],
        )

    rows = common.run_arrow(sample, run, "kind string, lost array<int>, gained array<int>, label int", "_text")
    rows = rows.groupBy("kind", "lost", "gained", "label").agg(F.count("*").alias("n"))
    return rows.orderBy("kind", "lost", "gained", "label").toArrow()


def _sparse(lists: pa.ListArray):
    """Feature numbers of all lists, and the list that each is of."""
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), counts)


def train(texts, pairs, size):
    """Weights and bias of the penalised logistic fit, by gradient steps of adapted length.

    ``texts`` has a text's feature numbers (lost), label and count per row; ``pairs`` the features that
    a sentence's variant has lost and gained, whose score changes are squared and added to the loss."""
    labels, counts, pair_counts = texts["label"].to_numpy(), texts["n"].to_numpy(), pairs["n"].to_numpy()
    ids, rows = _sparse(texts["lost"].combine_chunks())
    lost, lost_rows = _sparse(pairs["lost"].combine_chunks())
    gained, gained_rows = _sparse(pairs["gained"].combine_chunks())
    y, share = np.asarray(labels, float), np.asarray(counts, float) / np.sum(counts)
    pair_share = np.asarray(pair_counts, float) / max(1.0, float(np.sum(pair_counts)))
    weights, mean, square = np.zeros((3, size + 1))
    for step in range(1, STEPS + 1):
        total = weights[-1] + np.bincount(rows, weights[ids], len(texts))
        error = share * (1 / (1 + np.exp(-total)) - y)
        change = np.bincount(gained_rows, weights[gained], len(pairs)) - np.bincount(lost_rows, weights[lost], len(pairs))
        pull = PENALTY * pair_share * change
        slope = RIDGE * weights
        slope[:-1] += np.bincount(ids, error[rows], size)
        slope[:-1] += np.bincount(gained, pull[gained_rows], size) - np.bincount(lost, pull[lost_rows], size)
        slope[-1] = error.sum()
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        weights = weights - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", learn: Column | None = None) -> Model:
    """A model of ``label_col`` (0 or 1); only label rows that meet ``learn`` are learnt from.

    Of several labels of an id the largest counts; rows without an id or label do not. Without
    labelled texts of both classes every text gets the share of toxic labels as its score."""
    sample, shares = _sample(docs, labels, id_col, text_col, label_col, F.lit(True) if learn is None else learn)
    sample = materialize(sample, "toxicity-sample")
    found = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = found.get(1, 0), found.get(0, 0)
    share = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1.0)
    if not toxic or not other:
        return Model({}, float(np.log(share / (1 - share))) if sum(shares.values()) else -30.0)
    names = _choose(sample, toxic, other)
    rows = _rows_of(sample, names)
    texts, pairs = (rows.filter(pc.equal(rows["kind"], kind)) for kind in ("text", "pair"))
    weights, bias = train(texts, pairs, len(names))
    bias += float(np.log(share / (1 - share)) - np.log(toxic / other))  # classes are sampled apart
    return Model({f: float(w) for f, w in zip(names, weights)}, bias)


KNOWN_WORDS = 500_000


def _scores(block, column, model, known):
    if len(known) > KNOWN_WORDS:
        known.clear()
    return np.array([model.score(t, known) for t in common.string_array(block.column(column)).to_pylist()], float)


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) of every row; null and empty texts are scored as texts without words."""
    rows = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))

    def run(batches):
        known = {}
        for batch in batches:
            for block in common.blocks(batch, "_text"):
                yield pa.record_batch([block.column("_id"), pa.array(_scores(block, "_text", model, known))], ["_id", "score"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def remove(docs: DataFrame, model: Model, text_col="text", threshold=0.3) -> DataFrame:
    """The documents whose score is below the threshold, all columns kept."""

    def run(batches):
        known = {}
        for batch in batches:
            for block in common.blocks(batch, text_col):
                yield block.filter(pa.array(_scores(block, text_col, model, known) < threshold))

    return docs.mapInArrow(run, docs.schema)
