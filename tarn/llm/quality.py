"""Quality classifier: a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP, over the whole text. Learned filters of
WIDTH bytes slide over each chunk byte by byte; a filter's largest response is the chunk's feature. Over a text's chunks
the features are pooled by maximum, and by mean and minimum besides, as over many chunks a maximum only grows; all are
combined into one logistic probability that the label is 1. A byte's
embedding times a filter's weights is a table of 256 rows for each place in the filter, so a convolution is WIDTH table
lookups and sums. Training follows the largest responses back to embeddings, filters and weights (Adam).

The network is fitted on a bounded sample: SAMPLE labelled rows, those of the smallest hash of their id. Of a text of
over SAMPLE_CHUNKS chunks that many, spread evenly from its first to its last, take part in fitting; they are cut out on
the executors, which bounds what the driver gathers. Scoring covers every whole text. Only the text enters a score.

Defined cases: a null or empty text is one chunk of padding and gets a score like any other; rows without a label or id
don't train, and of several rows of one id the text of the smallest hash does; repeated rows get repeated scores; with no labelled row, or labels of one kind, the score is the share of
label 1 (0.5 with none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import map_texts, on_all_cores, remainder, remainder_column, sliced, table

CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS = 256, 32, 8, 1, 8, 16
SAMPLE, SAMPLE_CHUNKS, EPOCHS, BATCH, RATE, SEED = 3000, 96, 8, 32, 0.01, 7
THRESHOLD, FOLDS = 0.3, 5
_PAD = 256


def chunks_of(text: str | None) -> np.ndarray:
    """The text's overlapping chunks as rows of byte numbers, the last one padded."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // step))
    flat = np.full((n - 1) * step + CHUNK, _PAD, np.int16)
    flat[: len(data)] = data
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (step * 2, 2))


class ByteConvNet:
    """The network's parameters, and what it makes of texts."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        f4 = np.float32
        self.p = {
            "embed": r.normal(0, 0.5, (257, EMBED)).astype(f4),
            "kernel": r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)).astype(f4),
            "bias": np.zeros(FILTERS, f4),
            "dense": r.normal(0, 0.1, 3 * FILTERS).astype(f4),
            "out": np.zeros(1, f4),
        }
        self.p["embed"][_PAD] = 0

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.p["embed"], self.p["kernel"])

    def responses(self, x: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of chunks (rows of bytes): chunk, place, filter."""
        places = (CHUNK - WIDTH) // STRIDE + 1
        out = np.zeros((len(x), places, FILTERS), np.float32)
        for w in range(WIDTH):
            out += tables[w].take(x[:, w : w + STRIDE * (places - 1) + 1 : STRIDE], axis=0)
        return out

    def chunk_features(self, x: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self.responses(x[i : i + 128], tables).max(axis=1) + self.p["bias"], 0) for i in range(0, len(x), 128)])

    @staticmethod
    def pooled(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents that start at these chunks: the maximum, mean and minimum of the features."""
        counts = np.diff(np.concatenate((starts, [len(features)])))[:, None]
        return np.concatenate([np.maximum.reduceat(features, starts), np.add.reduceat(features, starts) / counts, np.minimum.reduceat(features, starts)], axis=1)

    def scores(self, texts: list[str | None], tables: np.ndarray | None = None) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        tables = self.tables() if tables is None else tables
        rows = []
        for text in texts:
            x = chunks_of(text)
            h = self.chunk_features(x, tables)
            rows.append(np.concatenate([h.max(axis=0), h.mean(axis=0), h.min(axis=0)]))
        return 1 / (1 + np.exp(-(np.array(rows, np.float64) @ self.p["dense"].astype(np.float64) + float(self.p["out"][0]))))

    def fit(self, cut: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> ByteConvNet:
        """cut: the chunks of each text."""
        r = np.random.default_rng(seed)
        y = np.array(labels, np.float32)
        share = float(y.mean())
        self.p["out"][:] = np.log(share / (1 - share))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(cut) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(cut))
            for at in range(0, len(order), BATCH):
                step += 1
                which = order[at : at + BATCH]
                grads = self._gradients([cut[i] for i in which], y[which])
                rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-4
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.p["embed"][_PAD] = 0
        return self

    def _gradients(self, cut: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        x = np.concatenate(cut)
        counts = np.array([len(c) for c in cut])
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        doc = np.repeat(np.arange(len(cut)), counts)
        tables = self.tables()
        best, raw = np.zeros((len(x), FILTERS), np.int64), np.zeros((len(x), FILTERS), np.float32)
        for i in range(0, len(x), 128):
            out = self.responses(x[i : i + 128], tables)
            best[i : i + 128] = out.argmax(axis=1)
            raw[i : i + 128] = out.max(axis=1)
        h = np.maximum(raw + self.p["bias"], 0)
        pooled = self.pooled(h, starts)
        p = 1 / (1 + np.exp(-(pooled @ self.p["dense"] + self.p["out"])))
        dz = ((p - y) / len(y)).astype(np.float32)
        dp = dz[:, None] * self.p["dense"]
        top, mean, low = dp[:, :FILTERS], dp[:, FILTERS : 2 * FILTERS] / counts[:, None], dp[:, 2 * FILTERS :]
        dh = mean[doc]
        for d, pool in ((top, pooled[:, :FILTERS]), (low, pooled[:, 2 * FILTERS :])):
            same = h == pool[doc]
            dh = dh + same * (d / np.add.reduceat(same.astype(np.float32), starts))[doc]
        dh = dh * (h > 0)
        dt = np.zeros_like(tables)
        rows, filters = np.repeat(np.arange(len(x)), FILTERS), np.tile(np.arange(FILTERS), len(x))
        place, g = best.ravel() * STRIDE, dh.ravel()
        live = np.flatnonzero(g)
        rows, filters, place, g = rows[live], filters[live], place[live], g[live]
        for w in range(WIDTH):
            np.add.at(dt[w], (x[rows, place + w], filters), g)
        return {
            "embed": np.einsum("wbf,wef->be", dt, self.p["kernel"]) + 1e-4 * self.p["embed"],
            "kernel": np.einsum("wbf,be->wef", dt, self.p["embed"]) + 1e-4 * self.p["kernel"],
            "bias": dh.sum(axis=0).astype(np.float32),
            "dense": (dz @ pooled).astype(np.float32) + 1e-4 * self.p["dense"],
            "out": np.array([dz.sum()], np.float32),
        }


class Constant:
    """What stands in for a network where there is nothing to tell labels apart by."""

    def __init__(self, share: float) -> None:
        self.share = share

    def tables(self) -> None:
        return None

    def scores(self, texts: list, tables: None = None) -> np.ndarray:
        return np.full(len(texts), self.share)


def sampled_chunks(text: str | None, most: int) -> np.ndarray:
    """All of a text's chunks, or `most` of them evenly from the first to the last."""
    x = chunks_of(text)
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).round().astype(np.int64)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chunks: int = SAMPLE_CHUNKS, folds: int = FOLDS) -> ByteConvNet | Constant:
    """A network fitted on at most `sample` labelled ids whose remainder is not 0, at most `sample_chunks` chunks each."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("_tarn_quality")).where(F.col("doc_id").isNotNull() & F.col("_tarn_quality").isin(0, 1) & (remainder_column("doc_id", folds) != 0))
    # of each id one label, the ids in the order of a hash; the limit bounds what is broadcast and collected
    chosen = usable.groupBy("doc_id").agg(F.max("_tarn_quality").alias("_tarn_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # labels without a document take no places in the sample's rows, so rows are fewer where ids are missing
    found = docs.select("doc_id", F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))

    def cut(batches):  # noqa: ANN001, ANN202
        for batch in sliced(batches):
            chunks = [sampled_chunks(t, sample_chunks).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_tarn_quality"), batch.column("hash"), pa.array(chunks, pa.binary())], names=["doc_id", "y", "hash", "chunks"])

    kind = dict(docs.dtypes)["doc_id"]
    cut_rows = found.select("doc_id", "text", "_tarn_quality", "hash").mapInArrow(cut, f"doc_id {kind}, y int, hash bigint, chunks binary")
    one = cut_rows.groupBy("doc_id").agg(F.min(F.struct("hash", "chunks", "y")).alias("m")).select("doc_id", "m.chunks", "m.y")
    rows = sorted(one.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    y = [r["y"] for r in rows]
    if not rows or len(set(y)) == 1:
        return Constant(float(np.mean(y)) if y else 0.5)
    return ByteConvNet().fit([np.frombuffer(r["chunks"], np.int16).reshape(-1, CHUNK) for r in rows], y)


def classify(docs: DataFrame, model: ByteConvNet | Constant, threshold: float = THRESHOLD, folds: int = FOLDS, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; keep: instead the rows themselves that are predicted 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if keep:

        def chosen(batches):  # noqa: ANN001, ANN202
            model = shared.value
            tables = model.tables()
            for batch in sliced(batches):
                score = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist(), tables)
                yield batch.filter(pa.array(score >= threshold))

        return docs.mapInArrow(chosen, docs.schema)

    def run(batch: pa.RecordBatch) -> dict:
        model, ids = shared.value, batch.column("doc_id").to_pylist()
        score = model.scores(batch.column("text").to_pylist(), model.tables())
        return {"doc_id": ids, "held_out": [remainder(i, folds) == 0 for i in ids], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_texts(docs, ["doc_id", "text"], run, "doc_id bigint, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole document, by a network fitted on labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return classify(on_all_cores(docs.select("doc_id", "text")), train(docs, table(spark, sf_dir, "labels")))
