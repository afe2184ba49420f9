"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training takes a bounded, seeded sample of labelled rows (`most`); each feature is
cut into at most `bins` quantile bins and every level of a tree is grown from
histograms of gradients. A model is three flat arrays (feature, threshold, leaf),
so that a batch of documents walks all trees at once in numpy.

Defined results: null texts count as empty; empty texts get a score too; a text of any length is measured whole; label rows
that are null, or whose document is missing, teach nothing; a document or label that is repeated teaches once for each
pair of rows, within the bound; with no usable label rows every score is 0.5; null ids and repeated rows are scored as rows
of their own; an empty table gives no rows; columns other than id and text are ignored, and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import doc_stats
from .common import as_bytes, in_slices


@dataclass
class Forest:
    """Complete binary trees in heap order: tree t's node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray  # the same; a row goes right if its value is larger
    leaf: np.ndarray  # trees x 2**depth
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        at = np.zeros((len(x), trees), dtype=np.int64)
        t, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        while inner:
            at = 2 * at + 1 + (x[row, self.feature[t, at]] > self.threshold[t, at])
            inner //= 2
        return 1 / (1 + np.exp(-(self.start + self.leaf[t, at - self.feature.shape[1]].sum(axis=1))))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.12, l2: float = 2.0, least: int = 8) -> Forest:
    """Boost `trees` trees of the given depth on the logistic loss."""
    if not len(y):
        return Forest(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), 0.0)
    n, width = x.shape
    cuts = [_cuts(x[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # value <= cuts[b] iff bin <= b
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    raw, inner = np.full(n, start), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = y - p, p * (1 - p), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width_now, first = 2**level, 2**level - 1
            best = np.full(width_now, 1e-6)
            pick, cut = np.zeros(width_now, int), np.full(width_now, bins + 1)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                k = node * (bins + 1) + binned[:, f]
                gs, hs, ns = (np.bincount(k, w, width_now * (bins + 1)).reshape(width_now, -1) for w in (g, h, None))
                gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = -1
                gain[:, len(cuts[f]) :] = -1
                b = gain.argmax(1)
                won = gain[np.arange(width_now), b] > best
                best[won], pick[won], cut[won] = gain[won, b[won]], f, b[won]
            feature[t, first : first + width_now] = pick
            threshold[t, first : first + width_now] = [cuts[f][b] if b <= bins else np.inf for f, b in zip(pick, cut)]
            node = 2 * node + (binned[np.arange(n), pick[node]] > cut[node])
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = rate * gs / (hs + l2)
        raw += leaf[t][node]
    return Forest(feature, threshold, leaf, start)


def features(texts: list[bytes]) -> np.ndarray:
    """Counts on a log scale, and ratios to words, letters and lines."""
    s = doc_stats.table(texts).astype(float)
    c = {k: s[:, i] for i, k in enumerate(doc_stats.FIELDS)}
    words, chars, lines, letters = (np.maximum(x, 1) for x in (c["n_words"], c["n_chars"], c["n_lines"], c["n_upper"] + c["n_lower"]))
    return np.stack(
        [
            np.log1p(c["n_words"]), np.log1p(c["n_chars"]), np.log1p(c["n_lines"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            c["n_upper"] / letters, c["n_digits"] / chars, c["n_stops"] / words, c["n_commas"] / words, c["n_bangs"] / words, c["n_distinct"] / words, c["n_twins"] / words,
            c["n_stop_lines"] / lines, np.log1p(c["longest_word"]), c["n_pipes"] / words, c["n_cased_words"] / words, c["n_words"] / lines,
        ],
        axis=1,
    )


def held_out(doc_id):
    """True for the quarter of ids that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Forest:
    """Fit on at most `most` pairs of a label and a document, those with the smallest seeded hashes of id, label and features.

    Only the features of that sample (a few numbers a row) reach the driver: the bound holds after the join, however often an id
    is repeated. Rows that `held_out` marks are left out. Labelled ids are broadcast: `most` bounds them too.
    """
    taught = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
        .orderBy(F.xxhash64(F.lit(17), "_id"), "_id", "_y")
        .limit(most)
    )

    def rows(batches):
        for b in in_slices(batches, "t"):
            x = features(as_bytes(b.column("t")))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_id", "_y", "x"])

    kind = labels.schema[doc_id].dataType.simpleString()
    found = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("t"))
        .join(F.broadcast(taught), "_id")
        .select("_id", "_y", "t")
        .mapInArrow(rows, f"_id {kind}, _y int, x array<double>")
        .orderBy(F.xxhash64(F.lit(17), "_id"), "_id", "_y", F.xxhash64("x"))
        .limit(most)
        .collect()
    )
    found.sort(key=lambda r: (r["_id"], r["_y"], r["x"]))
    x = np.array([r["x"] for r in found], dtype=float)
    return fit(x, np.array([float(r["_y"] == 1) for r in found]))


def score(docs: DataFrame, forest: Forest, least: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= least) of every document."""

    def rows(batches):
        for b in in_slices(batches, "t"):
            p = forest.score(features(as_bytes(b.column("t"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("t")).mapInArrow(
        rows, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs with a score of `least` or more, with all their columns, whatever their names."""
    own = {f"_{i}": c for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own)
    at = next(k for k, c in own.items() if c == text)

    def rows(batches):
        for b in in_slices(batches, at):
            yield b.filter(pa.array(forest.score(features(as_bytes(b.column(at)))) >= least))

    return plain.mapInArrow(rows, plain.schema).select(*(F.col(k).alias(c) for k, c in own.items()))
