"""Quality classifier: random-indexing word vectors pooled per document and a small network.

Every word bucket has a fixed sparse ternary index vector. A bucket's word vector is the sum of
the index vectors of the words around its occurrences in all documents. A document is the mean
of its words' vectors, the mean product of neighbouring ones (large where a text repeats itself)
and its length; a two-layer network with a calibrated temperature turns that into a probability.

Words are hashed to 2^15 buckets of 32 dimensions, so what is collected and broadcast has one
size at any size of the input. The network learns from about SAMPLE_ROWS labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import WORD, WordHashes, added_blocks, expanded, held_out, slices, squeezed, text_of

BITS, DIMS, NONZERO = 15, 32, 4
BUCKETS, BLOCK = 1 << BITS, 1 << 10
REACH = 2
SAMPLE_ROWS = 20_000
HIDDEN = 32
CHARS = 1 << 20
THRESHOLD = 0.5
FEATURES = 2 * DIMS + 1


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors of all buckets, with a last row of zeros that stands between documents."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS + 1, DIMS), np.int8)
    at = rng.random((BUCKETS, DIMS)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out[:-1], at, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), 1)
    return out


def buckets_of(texts: list[str], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and marks of all texts, each text followed by REACH gaps, and the number of words."""
    words = [WORD.findall(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    own = (memo.of([w for ws in words for w in ws]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    out = np.full(lengths.sum() + REACH * len(texts), BUCKETS)
    out[np.arange(len(own)) + REACH * np.repeat(np.arange(len(texts)), lengths)] = own
    return out, lengths


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from the contexts in every document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, index, total = WordHashes(), index_vectors(), np.zeros((BUCKETS, DIMS), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), CHARS):
                at, _ = buckets_of(texts[lo:hi], memo)
                own = index[at]
                around = np.zeros_like(own)
                for step in range(1, REACH + 1):
                    around[step:] += own[:-step]
                    around[:-step] += own[step:]
                order = np.argsort(at, kind="stable")
                there = at[order]
                first = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
                real = there[first] < BUCKETS
                total[there[first][real]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)[real]
        if total.any():
            blocks = BUCKETS // BLOCK
            sub = TaskContext.get().partitionId() % max(1, parts // 8)
            columns = [np.arange(blocks, dtype=np.int32), np.full(blocks, sub, np.int32)]
            data = pa.array([squeezed(b) for b in np.split(total, blocks)], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), data], ["block", "sub", "data"])

    sums = added_blocks(docs.select(text_of()).mapInArrow(each, "block int, sub int, data binary"))
    vectors = np.zeros((BUCKETS + 1, DIMS), np.float32)
    for row in sums.collect():
        vectors[row.block * BLOCK : (row.block + 1) * BLOCK] = expanded(row.data, np.int64).reshape(BLOCK, DIMS)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str], vectors: np.ndarray, memo: WordHashes) -> np.ndarray:
    """Features of each text; an empty one has zeros."""
    out = np.zeros((len(texts), FEATURES))
    for lo, hi in slices(np.array([len(t) for t in texts], np.int64), CHARS):
        at, lengths = buckets_of(texts[lo:hi], memo)
        own = vectors[at]
        starts = np.cumsum(lengths + REACH) - lengths - REACH
        size = np.maximum(lengths, 1)[:, None]
        pairs = own.copy()
        pairs[:-1] *= own[1:]
        pairs[-1:] = 0
        out[lo:hi, :DIMS] = np.add.reduceat(own, starts, axis=0) / size
        out[lo:hi, DIMS : 2 * DIMS] = np.add.reduceat(pairs, starts, axis=0) / size
        out[lo:hi, -1] = np.log1p(lengths) / 10
    return out


class Network:
    """Two layers in numpy, trained with Adam; the probability's temperature is set on rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60):
        rng = np.random.default_rng(5)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = self._scaled(x)
        apart = np.arange(len(x)) % 5 == 0
        learn = ~apart if (~apart).any() else apart
        self.w = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / 6, np.zeros(1)]
        self.temperature = 1.0
        moments = [[np.zeros_like(w) for w in self.w] for _ in range(2)]
        own_x, own_y, t = x[learn], y[learn], 0
        for _ in range(epochs):
            order = rng.permutation(len(own_x))
            for at in np.array_split(order, max(1, len(order) // 256)):
                t += 1
                hidden = np.maximum(own_x[at] @ self.w[0] + self.w[1], 0)
                wrong = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -30, 30))) - own_y[at]) / len(at)
                back = wrong[:, None] * self.w[2] * (hidden > 0)
                slopes = [own_x[at].T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ wrong + 1e-4 * self.w[2], wrong.sum(keepdims=True)]
                for w, g, m, v in zip(self.w, slopes, *moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 3e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if apart.any():
            logit, target = self.logits(x[apart]), y[apart]
            trials = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.logaddexp(0, np.where(target == 1, -logit, logit) / trial).mean() for trial in trials]
            self.temperature = float(trials[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def logits(self, scaled: np.ndarray) -> np.ndarray:
        return np.maximum(scaled @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self._scaled(x)) / self.temperature, -30, 30)))


def _with(rows: DataFrame, shared, of, kind: str) -> DataFrame:
    """Replaces the first column, a text, by what `of` makes of the pooled features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, vectors = WordHashes(), shared.value
        for batch in batches:
            made = of(pooled(batch.column(0).to_pylist(), vectors, memo))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "made"])

    return rows.mapInArrow(each, ", ".join(f"{c} {t}" for c, t in rows.dtypes[1:]) + f", made {kind}")


def scores(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text).

    `labels` (doc_id, quality) is read for rows whose crc32(doc_id) mod 3 is not 1, of which about
    `sample_rows`, chosen by a hash of the id, train the network; word vectors come from all texts.
    Labels that are null or contradict each other for one id are left out. A null text counts as
    empty, and an empty text is scored by its zeros. A null doc_id is held out. Repeated rows are
    scored each. Without labels every score is 0.5. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(word_vectors(docs))
    known = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .drop("most")
    )
    share = min(1.0, sample_rows / max(1, known.count()))
    few = F.expr(f"pmod(xxhash64(doc_id), 1048576) < {int(share * 1048576)}")
    texts = docs.select("doc_id", text_of().alias("text")).filter(few).filter(~held_out())
    sample = texts.join(known.filter(few).hint("shuffle_hash"), "doc_id").select("text", "doc_id", "quality")
    listed = _with(sample, shared, lambda x: pa.array(list(x), pa.list_(pa.float64())), "array<double>").toPandas()
    listed = listed.sort_values("doc_id", kind="stable")
    network = Network(np.array(listed.made.tolist()), listed.quality.to_numpy(dtype=float)) if len(listed) else None

    def probability(x: np.ndarray) -> pa.Array:
        return pa.array(network.probability(x) if network else np.full(len(x), 0.5))

    rows = docs.select(text_of().alias("text"), "doc_id", held_out().alias("held_out"))
    scored = _with(rows, shared, probability, "double").withColumnRenamed("made", "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
