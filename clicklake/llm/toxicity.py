"""Toxicity by multiple-instance learning: sentences are scored, noisy-or combines them, document labels train it."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, read_table

#: Bounds of the training: labelled documents (those with the least hash of their id) and features.
TRAIN_DOCS, MAX_FEATURES = 20_000, 4_096
#: A feature must stand this many standard deviations above the share of toxic documents.
LEAST_Z = 5.0
#: Prefix lengths that are features beside the whole word: they cover inflected and compound forms.
PREFIXES = (3, 4, 5, 6)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def word_features(word: str) -> list[str]:
    """The word itself, and its proper prefixes marked with a final asterisk."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    """Weights by feature, the sentences' bias, and the leak: the chance of toxicity without any known feature."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    leak: float = 0.0

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that have known features."""
        text = text or ""
        known = {}
        for word in set(_WORD.findall(text.lower())):
            if found := [f for f in word_features(word) if f in self.weights]:
                known[word] = found
        if not known:
            return []
        out = []
        for m in _SENTENCE.finditer(text):
            if found := {f for w in _WORD.findall(m[0].lower()) for f in known.get(w, ())}:
                z = self.bias + sum(self.weights[f] for f in found)
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))))
        return out

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        """Noisy-or: one minus the chance that neither the leak nor any sentence makes the document toxic."""
        return 1 - (1 - self.leak) * math.prod(1 - p for _, _, p in sentences)


def fit_noisy_or(bags: list[list[list[int]]], labels: list[int], features: int, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[list[float], float, float]:
    """Weights, bias and leak that maximise the likelihood of the labels of bags of sentences (lists of feature numbers).

    With S the sum of softplus(z) over a document's sentences plus the leak's share, the chance of label 1 is 1 - exp(-S).
    Full-batch Adam; no randomness.
    """
    import numpy as np

    y = np.asarray(labels, float)
    doc, sent, feat, n = [], [], [], 0
    for i, bag in enumerate(bags):
        for s in bag:
            doc.append(i)
            sent += [n] * len(s)
            feat += s
            n += 1
    doc, sent, feat = np.asarray(doc, int), np.asarray(sent, int), np.asarray(feat, int)
    x = np.concatenate([np.zeros(features), [-4.0, -4.0]])  # weights, bias, leak (softplus is its share of S)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        z = x[features] + np.bincount(sent, x[feat], n) if n else np.zeros(0)
        s = np.bincount(doc, np.logaddexp(0, z), len(y)) + np.logaddexp(0, x[-1])
        slope = np.where(y == 1, -1 / np.expm1(np.maximum(s, 1e-6)), 1.0) / max(1, len(y))
        per = slope[doc] / (1 + np.exp(-z)) if n else np.zeros(0)
        g = np.concatenate([np.bincount(feat, per[sent] if n else None, features) if n else np.zeros(features), [per.sum(), slope.sum() / (1 + np.exp(-x[-1]))]])
        g[:features] += l2 * x[:features]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:features].tolist(), float(x[features]), float(1 - math.exp(-np.logaddexp(0, x[-1])))


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents, and toxic documents, each feature occurs."""
    every, toxic = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}
            every.update(found)
            if label == 1:
                toxic.update(found)
    names = list(every)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())], names=["feature", "n", "n_toxic"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on the labelled documents outside the held-out fold (crc32 of the id as text, modulo 5, is 0).

    `labels` has doc_id and toxic; null labels and ids are ignored, and of differing labels of one id the greater
    counts. Features are counted in Spark; only the chosen features (MAX_FEATURES at most) and the sentences of the
    bounded sample that have them reach the driver; of an id's rows and repeated rows no more than train_docs in all. No labelled document of both kinds: no document is toxic.
    """
    chosen = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))  # at most train_docs rows of two numbers
    # An id can have any number of rows: of the different ones again those with the least hash, as many at most.
    least = known.select("h").distinct().orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    sample = known.filter(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).select("text", "toxic")
    n, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return Model(leak=1.0 if n and toxic == n else 0.0)
    share = toxic / n
    counts = sample.mapInArrow(_document_features, "feature string, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    z = (F.col("n_toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    features = [r["feature"] for r in counts.withColumn("z", z).filter((F.col("z") >= LEAST_Z) & (F.col("n") >= 3)).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    number = {f: i for i, f in enumerate(features)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Model(dict.fromkeys(number, 0.0))
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append([sorted({number[f] for w in _WORD.findall(text[a:b].lower()) for f in word_features(w) if f in number}) for a, b, _ in probe.sentences(text)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.int32()))), batch.column(1)], names=["bag", "toxic"])

    rows = sample.mapInArrow(bags, "bag array<array<int>>, toxic int").collect()
    weights, bias, leak = fit_noisy_or([r["bag"] for r in rows], [r["toxic"] for r in rows], len(features))
    return Model(dict(zip(features, weights)), bias, leak)


def held_out(id_col: str):
    """The rows that no label is learned from; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, offending (start, end, score of sentences at 0.5 or more).

    Null and empty texts get the leak's score. Places are counted in characters of the text. Repeated rows are scored
    alike, an empty table gives no rows, and other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, places = [], []
            for text in batch.column(2).to_pylist():
                found = model.sentences(text)
                scores.append(min(1.0, max(0.0, model.score(found))))
                places.append([{"start": a, "end": b, "score": p} for a, b, p in found if p >= 0.5])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(places, kind)], names=["doc_id", "held_out", "score", "predicted", "offending"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start: long, end: long, score: double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score is under 0.5, all columns as they are."""
    flag = fresh(docs, "is_toxic")

    @F.pandas_udf("boolean")
    def toxic(texts):
        return texts.map(lambda t: model.score(model.sentences(t)) >= 0.5).astype(bool)

    return docs.withColumn(flag, toxic(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).filter(~F.col(flag)).drop(flag)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels"))).withColumn("n_offending", F.size("offending")).drop("offending")
