"""Quality scores from a byte-level convolutional network, in numpy.

A document's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by
WIDTH - 1, so that every place of the whole text is under every filter once.
FILTERS learned filters of WIDTH bytes run over each chunk (a byte's part in a
filter is a table lookup), are max-pooled and rectified; the mean and the
maximum over the chunks go through one logistic unit.

Fitted on the driver on at most SAMPLE labelled documents, those with the
smallest hash of the id among rows whose crc32(id) mod 3 is not 1; only bytes
are inputs. The weights, some 60 kB, go to the tasks.

Null and empty texts have no chunks and get the score of the bias alone. With
no labelled rows every score is one half. Repeated rows give repeated result
rows; labels that repeat or contradict count by their maximum; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table

SAMPLE, CHUNK, WIDTH, FILTERS = 1500, 512, 5, 12
SAMPLE_BYTES = 200_000  # of one text of the sample


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(2 * FILTERS) * 0.2).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.out, self.out_bias]

    def pooled(self, texts: list[bytes], want_where: bool = False):
        """Rectified maxima (chunks, FILTERS), each chunk's text, and where the maxima lie."""
        sizes = [max(0, -(-(len(t) - WIDTH + 1) // (CHUNK - WIDTH + 1))) if len(t) > WIDTH - 1 else int(bool(t)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        data = np.frombuffer(b"".join(t + b"\0" * max(0, WIDTH - len(t)) if t else b"" for t in texts), np.uint8)
        lens = np.array([max(len(t), WIDTH) if t else 0 for t in texts])
        base = np.cumsum(lens) - lens
        if not len(data):
            return np.zeros((0, FILTERS), np.float32), owner, None, data
        acc = np.take(self.table[0], data, axis=0)
        for j in range(1, WIDTH):
            acc[:-j] += np.take(self.table[j], data[j:], axis=0)
        starts = np.concatenate([np.arange(n) * (CHUNK - WIDTH + 1) + b for n, b in zip(sizes, base)] or [np.zeros(0)]).astype(np.int64)
        stops = np.minimum(starts + CHUNK - WIDTH + 1, np.repeat(base + lens - WIDTH + 1, sizes))
        edges = np.stack([starts, stops], 1).ravel()
        edges[edges >= len(acc)] = len(acc) - 1
        top = np.maximum.reduceat(acc, edges, axis=0)[::2]
        where = None
        if want_where:
            where = np.stack([a + acc[a:b].argmax(axis=0) for a, b in zip(starts, stops)])
        return np.maximum(top + self.bias, 0), owner, where, data

    @staticmethod
    def combine(top: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Features (n, 2 FILTERS): mean and maximum over each text's chunks."""
        count = np.bincount(owner, minlength=n)
        mean = np.zeros((n, FILTERS), np.float32)
        most = np.zeros((n, FILTERS), np.float32)
        full = np.flatnonzero(count)
        if len(full):
            at = (np.cumsum(count) - count)[full]
            mean[full] = np.add.reduceat(top, at, axis=0) / count[full][:, None]
            most[full] = np.maximum.reduceat(top, at, axis=0)
        return np.concatenate([mean, most], axis=1), count

    def scores(self, texts: list[bytes]) -> np.ndarray:
        top, owner, _, _ = self.pooled(texts)
        x, _ = self.combine(top, owner, len(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(w) for w in self.weights()]
        v = [np.zeros_like(w) for w in self.weights()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                part = [texts[i] for i in pick]
                top, owner, where, data = self.pooled(part, True)
                x, count = self.combine(top, owner, len(part))
                err = ((1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30)))) - labels[pick]) / len(part)
                dx = err[:, None] * self.out
                grads = [np.zeros_like(w) for w in self.weights()]
                grads[2], grads[3] = x.T @ err + 1e-4 * self.out, np.array([err.sum()])
                if len(top):
                    dtop = dx[owner, :FILTERS] / count[owner][:, None]
                    dtop = dtop + dx[owner, FILTERS:] * (top == x[owner, FILTERS:])
                    dtop = dtop * (top > 0)
                    grads[1] = dtop.sum(0)
                    col = np.broadcast_to(np.arange(FILTERS), where.shape)
                    for j in range(WIDTH):
                        np.add.at(grads[0][j], (data[np.minimum(where + j, len(data) - 1)], col), dtop)
                step += 1
                for w, g, p, q in zip(self.weights(), grads, m, v):
                    p += 0.1 * (g - p)
                    q += 0.001 * (g * g - q)
                    w -= (rate * (1 - epoch / epochs) * (p / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Network | None:
    """Network fitted on at most ``sample`` documents of at most SAMPLE_BYTES each; None without any."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    chosen = {r["doc_id"]: r["y"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not chosen:
        return None
    rows = docs.filter(F.col("doc_id").isin(list(chosen)) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)).select("doc_id", "text").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    texts = [(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows]
    return Network().fit(texts, np.array([float(chosen[r["doc_id"]]) for r in rows], np.float32)) if rows else None


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            out = np.full(len(texts), 0.5)
            a = 0
            while network is not None and a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 1_000_000):
                    size += len(texts[b])
                    b += 1
                out[a:b] = network.scores(texts[a:b])
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(scan, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def op7_quality_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit_sample(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
