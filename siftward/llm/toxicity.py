"""Operator 4: toxicity by a classifier that is regularised with counterfactuals.

A text is the set of hashed features of its distinct words (the word and its beginnings). The
classifier is a sparse logistic regression. For each labelled text with identity terms in its
sentences a second one is made in which they are swapped for other terms of the same kind, and
the change of the score is penalised, so that neutral mentions of a group do not raise it.

Fitting takes a bounded, documented sample of labelled rows; scoring is one Arrow
function over all whole texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, cut_lineage, one_row_each, raw, table, texts, within

#: Labelled documents of each kind for the fit, and features of them all.
SAMPLE_DOCUMENTS, SAMPLE_FEATURES = 4000, 8_000_000
BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.3
#: Weight of the squared score change under swapped identity terms.
COUNTERFACTUAL = 1.0
CACHE_WORDS = 400_000

#: Terms that name groups of people, by kind; each may stand for another of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "african", "european", "american", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("elderly", "young", "old", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heteros", "transsexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
)

LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SENTENCE_END = re.compile(r"[.!?\n]+")


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split()


def word_features(word: bytes) -> set[int]:
    out = {zlib.crc32(b"=" + word) % BUCKETS}
    out.update(zlib.crc32(b"^" + word[:n]) % BUCKETS for n in BEGINNINGS if len(word) >= n)
    return out


def features(words: set[bytes]) -> set[int]:
    return set().union(*map(word_features, words))


class Swaps:
    def __init__(self, groups):
        self.other: dict[bytes, list[bytes]] = {}
        for group in groups:
            terms = [t.lower().encode() for t in group]
            for k, term in enumerate(terms):
                self.other[term] = terms[k + 1 :] + terms[:k]

    def counterfactual(self, text: bytes) -> set[bytes] | None:
        """Distinct words of the text with the identity terms of its sentences swapped; None without any.

        Which term comes in depends on the sentence, so that over many texts each stands for each.
        """
        out: set[bytes] = set()
        swapped = False
        for sentence in SENTENCE_END.split(text.decode("utf-8", "replace")):
            words = words_of(sentence.encode())
            if self.other.keys().isdisjoint(words):
                out.update(words)
                continue
            swapped = True
            place = zlib.crc32(b" ".join(words))
            for word in words:
                others = self.other.get(word)
                if others:
                    word = others[place % len(others)]
                out.add(word)
        return out if swapped else None


class Classifier:
    """Sparse weights of hashed features; the score is a probability."""

    def __init__(self, weights: dict[int, float], bias: float | None):
        self.weights, self.bias = weights, bias
        self.known: dict[bytes, tuple[int, ...]] = {}

    def relevant(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def score(self, text: bytes) -> float:
        if self.bias is None:
            return 0.0
        hit: set[int] = set()
        for found in map(self.relevant, set(words_of(text))):
            if found:
                hit.update(found)
        margin = self.bias + math.fsum(self.weights[f] for f in hit)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray | None, int, float]], counterfactual: float = COUNTERFACTUAL,
    rounds: int = 16, rate: float = 1.0, l1: float = 5.0, l2: float = 0.1,
) -> Classifier:
    """Logistic regression by follow-the-regularised-leader steps, which keep unhelpful weights at zero.

    ``rows``: features, features of the counterfactual or None, label, weight. Without rows every
    score is 0.
    """
    if not rows:
        return Classifier({}, None)
    positive = sum(w for _, _, y, w in rows if y)
    total = sum(w for *_, w in rows)
    bias = math.log((positive + 0.5) / (total - positive + 0.5))
    z, n, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)

    def step(ids: np.ndarray, gradient: float) -> None:
        if not len(ids) or not gradient:
            return
        old = n[ids]
        new = old + gradient * gradient
        z[ids] += gradient - (np.sqrt(new) - np.sqrt(old)) / rate * w[ids]
        n[ids] = new
        zi = z[ids]
        w[ids] = np.where(
            np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(new)) / rate + l2)
        )

    order = np.random.default_rng(7)
    mean_weight = total / len(rows)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            ids, other, label, weight = rows[k]
            margin = bias + w[ids].sum()
            probability = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))
            gradient = (probability - label) * weight / mean_weight
            step(ids, gradient)
            bias -= 0.01 * gradient
            if other is not None:
                gone, come = np.setdiff1d(ids, other), np.setdiff1d(other, ids)
                change = w[come].sum() - w[gone].sum()
                step(come, 2 * counterfactual * change)
                step(gone, -2 * counterfactual * change)
    used = np.flatnonzero(w)
    return Classifier(dict(zip(used.tolist(), w[used].tolist())), bias)


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from the fit: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS, terms=IDENTITY_TERMS,
    counterfactual: float = COUNTERFACTUAL, most_features: int = SAMPLE_FEATURES,
) -> Classifier:
    """Fit on at most ``documents`` labelled rows of each kind, those first by a hash of the id.

    They are taken in that order until they have ``most_features`` features; one with more is passed over. Of several
    rows of an id one is taken (``one_row_each``).
    Sampled kinds are weighted back to their true share. A document with several labels is toxic if one says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = []
    for kind, count in sorted(counts.items()):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
        parts.append(part.withColumn("weight", F.lit(max(1.0, count / documents))))
    if not parts:
        return Classifier({}, None)
    ids = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # At most two times ``documents`` ids.
    rows = one_row_each(docs, ids)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps(terms)
        for batch in batches:
            start = 0
            for part in byte_slices(batch.column("text")):
                own, other = [], []
                for text in texts(part):
                    own.append(sorted(features(set(words_of(text)))))
                    swapped = swaps.counterfactual(text)
                    other.append(None if swapped is None else sorted(features(swapped)))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, ints), pa.array(other, ints),
                        batch.column("toxic").slice(start, len(part)), batch.column("weight").slice(start, len(part)),
                        batch.column("doc_id").slice(start, len(part)).cast(pa.int64()),
                    ],
                    ["own", "other", "toxic", "weight", "doc_id"],
                )
                start += len(part)

    schema = "own array<int>, other array<int>, toxic int, weight double, doc_id long"
    described = cut_lineage(rows.select("text", "toxic", "weight", "doc_id").mapInArrow(describe, schema))
    size = F.size("own") + F.greatest(F.size("other"), F.lit(0))
    described = within(described.withColumn("size", size), "size", most_features, F.xxhash64("doc_id"), F.col("doc_id"))
    # The order of tasks must not decide the result.
    found = described.orderBy("doc_id").drop("size", "doc_id").toArrow()
    own, other = found.column("own"), found.column("other")
    # Views of the collected columns, not copies.
    as_ids = lambda x: x.values.to_numpy(zero_copy_only=False) if x.is_valid else None
    kinds, weights = found.column("toxic").to_pylist(), found.column("weight").to_pylist()
    return fit([(as_ids(a), as_ids(b), y, w) for a, b, y, w in zip(own, other, kinds, weights)], counterfactual)


def toxicity(spark: SparkSession, text: str | Column, model: Classifier) -> Column:
    """Score of a text from 0 to 1; of an empty or null one that of no words."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(*shared.value)
        for batch in batches:
            yield pa.array([classifier.score(t) for part in byte_slices(batch) for t in texts(part)], pa.float64())

    return score(raw(text))


def scored(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from a score of 0.3 on); one row for each row."""
    rows = docs.select(
        "doc_id", held_out().alias("held_out"), toxicity(docs.sparkSession, text, model).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The documents below the threshold, with their columns."""
    return docs.where(toxicity(docs.sparkSession, text, model) < THRESHOLD)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, train(docs, table(spark, folder, "labels")))
