"""Benchmark decontamination by winnowing.

A text's words are its runs of ASCII letters (A-Z lower-cased), ASCII digits and characters beyond ASCII. Every window
of `window` consecutive words of a benchmark item keeps one fingerprint: the smallest hash of the k-grams in it. The
same rule on the document side selects the same k-gram of any shared window, so a join of the kept fingerprints finds
every shared span of `window` words or more; each hit is then extended to its window and compared word by word. An item
of fewer words is one window, its own k-gram.

A benchmark of at most BLOCK_CHARS characters (and so half as many words) is broadcast as one index. A larger one stays
distributed: its windows join the documents' kept fingerprints by shuffle, each document gathers the windows that share
one with it, and is compared with those alone. Documents are read a fixed number of times, whatever the benchmark.

Defined cases: a null or wordless text has no words and no hits; a wordless item never occurs; rows that repeat are
judged each on its own, told apart by their place in the input, which must be a stored table if the benchmark is large;
repeated item ids count once; a null item id is written as `null`; either table may be empty; a text may be very long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import _arrow_schema, on_all_cores, sha256, sliced, table

WINDOW, K = 10, 6
#: Characters of a benchmark that is broadcast, at most a million words; about 200 MB of index at most.
BLOCK_CHARS = 2_000_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def gram_hashes(grid: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers."""
    out = np.zeros(len(grid), np.uint64)
    for j in range(grid.shape[1]):
        out = (out ^ (grid[:, j].astype(np.uint64) + np.uint64(1))) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def kept_fingerprints(grid: np.ndarray, k: int) -> np.ndarray:
    """Winnowing: the smallest k-gram hash of each window (a row of word numbers)."""
    best = gram_hashes(grid[:, :k])
    for j in range(1, grid.shape[1] - k + 1):
        np.minimum(best, gram_hashes(grid[:, j : j + k]), out=best)
    return best


def windows_of(text: str | None, window: int) -> list[list[bytes]]:
    """An item's windows; an item of fewer words is one."""
    words = words_of(text)
    size = min(window, len(words))
    return [words[s : s + size] for s in range(len(words) - size + 1)] if words else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Words as numbers, without a vocabulary."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class BenchmarkIndex:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[str, list[list[bytes]]]], k: int = K) -> None:
        """items: names with windows."""
        self.k, self.vocabulary = k, {}
        windows: dict[int, dict[bytes, set[int]]] = {}
        numbers: dict[str, int] = {}
        for name, of in items:
            for words in of:
                n = numbers.setdefault(name, len(numbers))
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
                windows.setdefault(len(ids), {}).setdefault(ids.tobytes(), set()).add(n)
        self.names = list(numbers)
        self.windows = {size: {key: tuple(v) for key, v in found.items()} for size, found in windows.items()}
        self.fingerprints = {
            size: np.unique(kept_fingerprints(np.frombuffer(b"".join(found), np.int32).reshape(-1, size), min(k, size)))
            for size, found in self.windows.items()
        }

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are inside an occurring window, and the items that have such windows."""
        n = len(words)
        hit, items = np.zeros(n, bool), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, n)
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for size, found in self.windows.items():
            if n < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            for at in range(0, len(starts), 1 << 16):
                block = starts[at : at + (1 << 16)]
                grid = ids[block[:, None] + np.arange(size)]
                kept, prints = kept_fingerprints(grid, min(self.k, size)), self.fingerprints[size]
                where = np.minimum(np.searchsorted(prints, kept), len(prints) - 1)
                for i in np.flatnonzero(prints[where] == kept):
                    of = found.get(grid[i].tobytes())
                    if of is not None:
                        hit[block[i] : block[i] + size] = True
                        items.update(of)
        return hit, [self.names[i] for i in items]


def _items(benchmark: DataFrame, item: str, text: str, block_chars: int) -> tuple[DataFrame, bool]:
    """(item, text), and whether they are few enough to be broadcast."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    # each row counts, so that their number is bounded, too
    return rows, (rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16)).first()[0] or 0) <= block_chars


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def _judged(doc_id: int | None, words: list[bytes], index: BenchmarkIndex) -> tuple:
    hit, items = index.hits(words)
    items.sort()
    n_hit = int(hit.sum())
    return doc_id, len(words), n_hit, len(items), sha256(",".join(items).encode()), n_hit > 0, items


def _rows_of(schema: str, per_batch: Callable[[pa.RecordBatch], list[tuple]]) -> Callable:
    from pyspark.sql.types import _parse_datatype_string

    arrow = _arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = per_batch(batch)
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_chars: int = BLOCK_CHARS,
    doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document: how many words it has and how many are inside benchmark windows, and the items concerned."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and window")
    items, few = _items(benchmark, item, item_text, block_chars)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    if few:
        shared = docs.sparkSession.sparkContext.broadcast(_index(items, window, k))
        judge = lambda batch: [_judged(d, words_of(t), shared.value) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return rows.select("doc_id", "text").mapInArrow(_rows_of(SCHEMA, judge), SCHEMA)
    met = _shared_windows(rows, items, window, k)

    def judge_own(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for d, t, found in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            out.append(_judged(d, words_of(t), BenchmarkIndex([(x["item"], [x["words"].split(b" ")]) for x in found or []], k)))
        return out

    return rows.join(met, "row", "left").select("doc_id", "text", "found").mapInArrow(_rows_of(SCHEMA, judge_own), SCHEMA)


def _index(items: DataFrame, window: int, k: int) -> BenchmarkIndex:
    return BenchmarkIndex([(r["item"], windows_of(r["text"], window)) for r in items.collect()], k)


def _shared_windows(rows: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """(row, found): the benchmark's windows (item, words) that share a kept fingerprint with each document."""

    def cut(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of = windows_of(t, window)
            if of:
                kept = kept_fingerprints(np.stack([word_hashes(w) for w in of]), min(k, len(of[0])))
                out += [(name, len(w), p, b" ".join(w)) for w, p in zip(of, kept.view(np.int64).tolist(), strict=True)]
        return out

    cuts = "item string, size int, print bigint, words binary"
    windows = items.mapInArrow(_rows_of(cuts, cut), cuts).distinct()
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most as many as a window has words

    def prints(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = word_hashes(words_of(t))
            for size in sizes:
                kept: set[int] = set()
                for at in range(0, len(h) - size + 1, 1 << 16):
                    n = min(1 << 16, len(h) - size + 1 - at)
                    kept |= set(np.unique(kept_fingerprints(np.lib.stride_tricks.sliding_window_view(h[at : at + n + size - 1], size), min(k, size))).view(np.int64).tolist())
                out += [(row, size, p) for p in kept]
        return out

    own = "row bigint, size int, print bigint"
    told = rows.select("row", "text").mapInArrow(_rows_of(own, prints), own)
    return told.join(windows, ["size", "print"]).groupBy("row").agg(F.collect_set(F.struct("item", "words")).alias("found"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_chars: int = BLOCK_CHARS, text: str = "text", item: str = "item_id", item_text: str = "text", most: int = 0) -> DataFrame:
    """docs without those that have more than `most` words inside occurring windows, with their columns."""
    items, few = _items(benchmark, item, item_text, block_chars)
    if few:
        shared = docs.sparkSession.sparkContext.broadcast(_index(items, window, k))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([int(shared.value.hits(words_of(t))[0].sum()) <= most for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    rows = docs.withColumn("_tarn_row", F.monotonically_increasing_id())
    met = _shared_windows(rows.select(F.col("_tarn_row").alias("row"), F.col(text).alias("text")), items, window, k)
    met = rows.select(F.col("_tarn_row").alias("row"), F.col(text).alias("text")).join(met, "row")

    def hit(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for row, t, found in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if int(BenchmarkIndex([(x["item"], [x["words"].split(b" ")]) for x in found], k).hits(words_of(t))[0].sum()) > most:
                out.append((row,))
        return out

    gone = met.select("row", "text", "found").mapInArrow(_rows_of("row bigint", hit), "row bigint")
    return rows.join(gone, F.col("_tarn_row") == F.col("row"), "left_anti").drop("_tarn_row")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, with windows of 10 words."""
    return decontaminate(on_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark")).drop("items")


#: Windows as arrays of words, joined by equality; hit words are the union of the occurring windows' positions.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n
), h AS (
  SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
