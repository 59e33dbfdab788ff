"""Language ID: nearest of several TF-IDF n-gram centroids per language, by cosine."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import map_batches, remainder, texts_of
from shelfspark.session import stored

DIMENSIONS = 1 << 13
CENTROIDS = 4
#: Training documents of a language that its centroids are fitted on; the weights of the
#: n-grams come from all training documents.
SAMPLE = 512
#: A text whose best cosine is below this share of what the centroid's own texts have is no
#: language that was learned. A short text has few n-grams and so a smaller cosine by nature:
#: what is expected of it shrinks with the root of their number.
REJECT = 0.5
SHARPNESS = 25.0
UNKNOWN = "und"
PIECE, ROWS = 1 << 20, 64
LETTER = re.compile(r"[^\W\d_]")


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Hashed counts of the byte pairs and triples of each text (A-Z lower-cased)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            b = np.frombuffer(text[at:at + PIECE + 2].lower(), np.uint8).astype(np.uint32)
            if len(b) < 2:
                continue
            two = b[:-1] << np.uint32(8) | b[1:]
            three = two[:-1] << np.uint32(8) | b[2:]
            code = np.concatenate([two[:PIECE] + np.uint32(1 << 24), three[:PIECE]]) * np.uint32(0x9E3779B1)
            out[i] += np.bincount(code >> np.uint32(19), minlength=DIMENSIONS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: farthest-first seeds, then means of the nearest, all unit vectors."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-9)
    return c.astype(np.float32)


class LanguageModel:
    """idf by dimension, unit centroids, and for each its language, least cosine and usual number of n-grams."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, of: list[int], langs: list[str], least: np.ndarray, usual: np.ndarray):
        self.idf, self.centroids, self.of, self.langs, self.least, self.usual = idf, centroids, np.array(of, np.int64), langs, least, usual

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [], [], []
        for at in range(0, len(texts), ROWS):
            part = texts[at:at + ROWS]
            if not self.langs:
                names += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                rejected += [True] * len(part)
                continue
            counts = term_counts(part)
            cos = vectors(counts, self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            expected = self.least[best] * np.sqrt(np.minimum(1, (counts > 0).sum(axis=1) / self.usual[best]))
            by_lang = np.stack([cos[:, self.of == j].max(axis=1) for j in range(len(self.langs))], axis=1)
            weight = np.exp(SHARPNESS * (by_lang - by_lang.max(axis=1, keepdims=True)))
            for row, text in enumerate(part):
                if not LETTER.search(text.decode()):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                names.append(self.langs[self.of[best[row]]])
                scores.append(float(1 / weight[row].sum()))
                rejected.append(bool(cos[row, best[row]] < expected[row]))
        return names, scores, rejected


def fit_languages(train: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, reject: float = REJECT) -> LanguageModel:
    """Fit on the rows of ``train`` (doc_id, text, lang) whose text and lang are not null.

    Document frequencies cover all rows; the centroids a sample of each language, those of
    the smallest hash of doc_id. What reaches the driver is one row per dimension and
    ``centroids`` rows per language.
    """
    train = train.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            texts = texts_of(batch)
            total[-1] += len(texts)
            for at in range(0, len(texts), ROWS):
                total[:-1] += (term_counts(texts[at:at + ROWS]) > 0).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["dim", "n"])

    found = train.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for r in found:
        df[r["dim"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1

    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = stored(train.select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("doc_id", F.col("lang").alias("fit_lang")))

    def fit(table):  # no hints: Spark would read them
        counts = term_counts([t.encode() for t in table["text"].to_pylist()])
        x = vectors(counts, idf)
        c = fit_centroids(x, centroids)
        cos = x @ c.T
        own = cos.argmax(axis=1)
        least = [float(np.median(cos[own == j, j])) * reject if (own == j).any() else 0.0 for j in range(len(c))]
        usual = [float(max(1, np.median((counts[own == j] > 0).sum(axis=1)))) if (own == j).any() else 1.0 for j in range(len(c))]
        return pa.table({"lang": [table["lang"][0].as_py()] * len(c), "vector": [v.tobytes() for v in c], "least": least, "usual": usual})

    rows = train.join(chosen, (train["doc_id"].eqNullSafe(chosen["doc_id"])) & (train["lang"] == chosen["fit_lang"])).select("lang", "text").groupBy("lang").applyInArrow(
        fit, "lang string, vector binary, least double, usual double").orderBy("lang").collect()
    langs = sorted({r["lang"] for r in rows})
    c = np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    return LanguageModel(idf, c, [langs.index(r["lang"]) for r in rows], langs, np.array([r["least"] for r in rows]), np.array([r["usual"] for r in rows]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang (the nearest), score, rejected: one row per row of ``docs``.

    The score is the softmax of the languages' best cosines. Rejected are texts that are
    null or have no letter (their language is ``und``, with score 0) and texts too far from
    every centroid, or all texts if nothing was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = sent.value.predict(texts_of(batch))
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))], ["doc_id", "lang", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, lang string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not x for x in sent.value.predict(texts_of(batch))[2]], pa.bool_()))

    return map_batches(docs, each, docs.schema)


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return remainder("doc_id", 4) == 2


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row; a quarter of the ids is not learned from.

    The prediction sees the text alone. Other columns than doc_id, text and lang are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(rows, fit_languages(rows.where(~held_out()))).select("doc_id", held_out().alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")
