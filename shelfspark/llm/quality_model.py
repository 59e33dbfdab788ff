"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import map_batches, remainder, texts_of
from shelfspark.session import stored

#: Labelled rows that the trees are fitted on at most: those of the smallest hash of doc_id.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 10

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "longest_word", "upper", "digits", "space", "not_ascii",
    "stops", "commas", "exclaims", "symbols", "pipes", "byte_entropy", "top_byte", "distinct_words", "top_word", "symbol_words",
    "short_words", "line_length", "distinct_lines", "lines_with_stop", "words_per_stop", "packed", "distinct_triples", "title_words",
)
_SETS = {
    "upper": range(65, 91), "digits": range(48, 58), "space": (32, 9, 10, 11, 12, 13), "not_ascii": range(128, 256), "stops": b".",
    "commas": b",;:", "exclaims": b"!?", "symbols": b"#$%&*+/<=>@[\\]^_`{}~", "pipes": b"|",
}
MASKS = np.zeros((len(_SETS), 256))
for _i, _s in enumerate(_SETS.values()):
    MASKS[_i, list(_s)] = 1


def statistics(text: bytes) -> list[float]:
    """The features of one whole text; an empty one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    some = shares[shares > 0]
    stripped = [x for x in lines if x.strip()]
    k = max(1, len(stripped))
    by_class = dict(zip(_SETS, MASKS @ shares, strict=True))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        *by_class.values(), float(-(some * np.log2(some)).sum()), float(shares.max()),
        len(counts) / m, max(counts.values(), default=0) / m,
        sum(c for w, c in counts.items() if not w.isalnum() and w.isascii() and not any(48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in w)) / m,
        float((lengths <= 2).mean()), n / k, len(set(stripped)) / k,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in stripped) / k, text.count(b".") / m,
        len(zlib.compress(text, 1)) / n, len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2),
        sum(c for w, c in counts.items() if w[:1].isupper() and not w.isupper()) / m,
    ]


@dataclass
class Trees:
    """Complete trees of one depth as arrays: feature and threshold by inner node, value by leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows go down a tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost logistic loss; splits are chosen on sums of gradients per node, feature and bin."""
    inner, leaves = 2**depth - 1, 2**depth
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    out = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return out
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(n, out.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(count)
            for j in range(width):
                key = at * bins + binned[:, j]
                gs, hs, ns = (np.bincount(key, w, count * bins).reshape(count, bins).cumsum(axis=1) for w in (g, h, np.ones(n)))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs)**2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < LEAST_ROWS) | (nt - ns < LEAST_ROWS)] = 0
                gain = gain[:, :len(edges[j])]
                if not gain.size:
                    continue
                cut = gain.argmax(axis=1)
                top = gain[np.arange(count), cut]
                for q in np.flatnonzero(top > best + 1e-9):
                    best[q], f[first + q], t[first + q] = top[q], j, edges[j][cut[q]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Trees(out.base, np.array(features), np.array(thresholds), np.array(values))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, features (an array of doubles): one row per row."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [statistics(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "features"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, features array<double>")


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return remainder("doc_id", 3) == 1


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Labels are learned from the ids outside the held-out third, of ``max_rows`` rows at
    most; nulls are left out, and a document labelled twice counts once, with its highest
    label. The trees see the statistics of the text alone. Null and empty texts have
    statistics of zero and get a score too. With fewer than 20 labelled rows or one label
    only, every score is the label's share (0.5 without labels).
    """
    rows = stored(document_statistics(docs))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = rows.where(~held_out()).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_rows).select("features", "y").toArrow()
    x = np.array(chosen["features"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    model = fit_trees(x, (chosen["y"].to_numpy() >= 1).astype(np.float64))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = sent.value.score(np.array(batch.column("features").to_pylist(), np.float64).reshape(-1, len(FEATURES)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(rows, each, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
