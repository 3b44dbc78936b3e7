"""Quality by positive-unlabelled learning: non-negative unbiased risk from trusted positives, plain web text and a class prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytekit import U64, Words, binary_parts, mix, release, slices
from .cluster import read, ship

#: Rows of either kind that a fit uses at most, on average: rows are taken by a hash of their id.
MOST_ROWS = 10_000
#: Bytes of text whose features are made at once.
BATCH = 1 << 20
FOLDS, CUT = 5, 0.3

_KINDS = np.zeros((7, 256), np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>|@^~=+_\\/{}[]", b"!?", b".,;:'\"()-", bytes(range(0x80, 0x100)))):
    _KINDS[_i, list(_chars)] = 1
UPPER, LOWER, DIGIT, SYMBOL, SHOUT, POINT, WIDE = range(7)
#: Hashed n-grams, of so many bytes each; numbers about the text as a whole.
GRAMS, GRAM, STATISTICS = 512, 3, 24
FEATURES = GRAMS + STATISTICS


def ngrams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of the counts of each text's byte n-grams by hash, to length 1. Texts shorter than that have none."""
    n = len(off) - 1
    counts = np.zeros(n * GRAMS)
    doc = np.repeat(np.arange(n), np.diff(off))
    for i in range(0, len(buf), BATCH):
        at = np.arange(i, min(i + BATCH, len(buf) - GRAM + 1))
        at = at[off[1:][doc[at]] - at >= GRAM]
        code = sum(buf[at + k].astype(np.uint64) << U64(8 * k) for k in range(GRAM)) * U64(0x9E3779B97F4A7C15)
        counts += np.bincount(doc[at] * GRAMS + ((code >> U64(40)) % U64(GRAMS)).astype(np.int64), minlength=len(counts))
    x = np.sqrt(counts).reshape(n, GRAMS)
    return x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: hashed n-grams, shares of kinds of characters and words, repetition, lengths. Any text has finite ones."""
    w = Words(buf, off)
    n_docs = len(off) - 1
    nw = w.count.astype(float)
    chars = np.maximum(np.diff(off).astype(float), 1)
    per = np.maximum(nw, 1)
    size = w.to - w.at

    def by_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=x, minlength=n_docs) if len(x) else np.zeros(n_docs)

    inside, cols = [], []
    for kind in _KINDS:
        sums = np.concatenate([[0], np.cumsum(kind[buf], dtype=np.int64)])
        cols.append((sums[off[1:]] - sums[off[:-1]]) / chars)
        inside.append(sums[w.to] - sums[w.at])
    letters = inside[UPPER] + inside[LOWER] + inside[WIDE]
    last = buf[w.to - 1] if len(w.at) else np.zeros(0, np.uint8)
    first = buf[w.at] if len(w.at) else np.zeros(0, np.uint8)
    h = w.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    cols += [
        by_doc((inside[LOWER] == 0) & (inside[UPPER] > 1)) / per,
        by_doc((inside[SYMBOL] > 0) & (letters > 0)) / per,
        by_doc(inside[SYMBOL] >= 3) / per,
        by_doc((inside[SHOUT] > 1) | (last == 33)) / per,
        by_doc(inside[DIGIT] > 0) / per,
        by_doc(letters == 0) / per,
        by_doc(last == 46) / per,
        by_doc(_KINDS[UPPER][first] > 0) / per,
        by_doc(size) / per / 20,
        np.sqrt(np.maximum(0, by_doc(size.astype(float) ** 2) / per - (by_doc(size) / per) ** 2)) / 10,
        by_doc(same) / per,
    ]
    doc = mix(w.doc.astype(np.uint64) + U64(1))
    for n in (1, 3):
        at, g = (np.arange(len(h)), h) if n == 1 else w.grams(h, n)
        own = np.bincount(w.doc[at], minlength=n_docs)
        u, k = np.unique(g ^ doc[at], return_index=True)
        kinds = np.bincount(w.doc[at[k]], minlength=n_docs)
        # how much fewer than a text of this length has anyway
        cols.append(1 - kinds / np.maximum(own, 1))
        cols.append((1 - kinds / np.maximum(own, 1)) / np.log2(np.maximum(own, 1) + 2))
    feeds = np.concatenate([[0], np.cumsum(buf == 10)])
    cols += [(feeds[off[1:]] - feeds[off[:-1]]) / chars * 20, np.log1p(nw) / 10]
    return np.concatenate([ngrams(buf, off), np.stack([np.asarray(c, float) for c in cols], axis=1)], axis=1).astype(np.float32)


def _feature_rows(batches):
    for b in batches:
        buf, off = binary_parts(b.column(1))
        x = np.concatenate([features(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off, BATCH)] or [np.zeros((0, FEATURES))])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], ["kind", "x"])
    release()


class Model:
    """A weight for each standardised feature; the score is a probability."""

    def __init__(self, mean, scale, weights, bias):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def value(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _chance(self.value(x).astype(float))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8).astype(np.float32)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, slope, steps: int, rate: float, decay: float) -> Model:
    """Weights after `steps` of Adam. slope: of the risk by the values of all rows, from their scores."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0, dtype=np.float64).astype(np.float32), (both.std(axis=0, dtype=np.float64) + 1e-3).astype(np.float32)
    x = _standard(both, mean, scale)
    weights = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        g = slope(_chance((x @ weights[:-1].astype(np.float32)).astype(float) + weights[-1]))
        grad = np.append(g.astype(np.float32) @ x + decay * weights[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights[:-1].astype(np.float32), weights[-1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, rate: float = 0.02, decay: float = 0.01) -> Model:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss (Kiryo et al., 2017).

    Where the part under the maximum turns negative, the step goes the other way on it, as in the paper.
    """
    n_p, n_u = len(positive), len(unlabelled)

    def slope(s: np.ndarray) -> np.ndarray:
        loss_n = -np.log(1 - s + 1e-12)  # of calling it negative
        rest = loss_n[n_p:].mean() - prior * loss_n[:n_p].mean()
        g = np.zeros(len(s))
        if rest >= 0:
            g[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
            g[n_p:] = s[n_p:] / n_u
        else:
            g[:n_p] = prior * s[:n_p] / n_p
            g[n_p:] = -s[n_p:] / n_u
        return g

    return _descend(positive, unlabelled, slope, steps, rate, decay)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from these two alone (best bin estimation, Garg et al., 2021).

    Half of either trains a classifier that tells them apart. On the other half, above a score that only positives reach, the share of
    unlabelled rows over that of positives is the prior; the score is chosen where that ratio, with room for chance, is least.
    """
    (p, q), (u, v) = ((x[::2], x[1::2]) for x in (positive, unlabelled))
    if not len(q) or not len(v):
        return 0.5
    n_p, n_u = len(p), len(u)
    apart = _descend(p, u, lambda s: np.concatenate([(s[:n_p] - 1) / n_p, s[n_p:] / n_u]) / 2, 300, 0.02, 0.01)
    zq, zv = np.sort(apart.value(q)), np.sort(apart.value(v))
    at = np.unique(np.concatenate([zq, zv]))
    above_q, above_v = 1 - np.searchsorted(zq, at) / len(zq), 1 - np.searchsorted(zv, at) / len(zv)
    chance = np.sqrt(np.log(40) / 2 / len(zq)) + np.sqrt(np.log(40) / 2 / len(zv))
    best = np.argmin(np.where(above_q > 0, (above_v + chance) / np.maximum(above_q, 1e-9), np.inf))
    return float(np.clip(above_v[best] / above_q[best], 0.05, 0.98))


def fold() -> F.Column:
    """crc32 of the id as text, modulo FOLDS; null ids are in fold 0, which nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))


def _least(hashes: DataFrame, most: int) -> int | None:
    """The hash (column h) up to which there are `most` different ones, or the greatest; None if there are none. Sorted are only some
    2 * most of them, the least by an estimate of how many there are."""
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    top = -(1 << 63) + int(2.0**64 * min(1.0, 2 * most / n)) - 1 if n else 0
    found = hashes.where(F.col("h") <= min(top, (1 << 63) - 1)).distinct().orderBy("h").limit(most)
    return found.agg(F.max("h")).first()[0] if n else None


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model | None:
    """A model from the texts of rows labelled good (positives) and of any rows (unlabelled), none of fold 0.

    The class prior is estimated from these two kinds alone; bad labels are never used. Of either kind the `most` rows of least hash
    of doc_id and text are used, repeated rows once; rows without a doc_id are in fold 0. Labels that are null, or of documents that aren't there, don't count; no good
    label or no text: no model.
    """
    spark = docs.sparkSession
    ship(spark)
    good = labels.where("quality = 1").where(fold() != 0).select("doc_id").distinct()
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(fold() != 0)
    d = d.select("doc_id", "text", *(F.xxhash64(F.lit(k), "doc_id", "text").alias(k) for k in "pu"))
    least_p = _least(d.select("doc_id", F.col("p").alias("h")).join(good, "doc_id", "left_semi").select("h"), most)
    least_u = _least(d.select(F.col("u").alias("h")), most)
    if least_p is None or least_u is None:
        return None
    p = d.where(F.col("p") <= least_p).join(good, "doc_id", "left_semi").dropDuplicates(["p"]).select(F.lit(1).alias("kind"), "text")
    u = d.where(F.col("u") <= least_u).dropDuplicates(["u"]).select(F.lit(0).alias("kind"), "text")
    rows = p.unionByName(u).mapInArrow(_feature_rows, "kind int, x array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    kind = rows.column("kind").to_numpy()
    x = rows.column("x").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    # the same sums, and halves, whatever order rows come in
    order = np.lexsort((x[:, 1], x[:, 0], x[:, GRAMS:].sum(axis=1, dtype=np.float64), kind))
    x, kind = x[order], kind[order]
    positive, unlabelled = x[kind == 1], x[kind == 0]
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def _scores(model: Model | None, keep: list[str]):
    def run(batches):
        for b in batches:
            buf, off = binary_parts(b.column(b.schema.get_field_index("text")))
            s = np.concatenate([model.score(features(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off, BATCH)] or [np.zeros(0)]) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(s)], [*keep, "_score"])
        release()

    return run


def score_documents(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns `keep` and _score (0 to 1) of every row of docs, by its whole text alone; null texts count as empty.

    Without a model (no good label to learn from) every score is 0.5. Repeated rows get equal scores.
    """
    ship(docs.sparkSession)
    d = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([d.schema[c] for c in keep] + [T.StructField("_score", T.DoubleType())])
    return d.mapInArrow(_scores(model, keep), schema)


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    d = score_documents(docs, learn(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return d.select("doc_id", (fold() == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op8_pu_quality": op8_pu_quality}
SQL: dict[str, str] = {}
