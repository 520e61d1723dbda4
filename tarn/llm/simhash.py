"""SimHash near-duplicates, compared bit-sliced.

A text's words (A-Z lower-cased, cut at ASCII white space) give shingles; a fingerprint bit is 1 if it is set in over
half of the shingles' XXH64 values. Fingerprints that differ in at most `radius` bits are linked.

Search is exact. The bits are cut into radius + c blocks, so two linked fingerprints agree on at least c of them; each
choice of c blocks is a table, and only fingerprints with equal bits there are compared. c follows the number of
distinct fingerprints, so that buckets stay small at any size; each c finds the same links. A bucket over CHUNK
fingerprints is cut into chunks by hash and compared chunk against chunk, each two in a group of their own.

Inside a group the fingerprints are stored as bit planes, 64 to a word. A fingerprint's distances to 64 others are
counted together: the differing planes go through carry-save adders into bit-sliced counters, and words in which all
64 distances are beyond the radius are abandoned. A group passes on a spanning forest of its links, which joins
what the links join; components are found over distinct fingerprints.

A bucket over SPLIT chunks is first divided by the bits that its key leaves: of radius + 1 parts of them two linked
fingerprints agree on one.

For similarity thresholds that 64 bits can't resolve, `similar` only searches with fingerprints: WIDE words of 64 bits
over distinct shingles. Bits differ in the share acos(cosine) / pi of places, which turns a resemblance (Jaccard) into a
radius, taken some deviations wider; as that is far too large for blocks, candidates share one of several keys of sampled
bits, whose number gives the wanted recall at the threshold. Chunks, planes and counters are the same. Texts of equal
sets are one node. Candidate links are passed on as spanning forests, never as all pairs, and make families of nodes that
may be alike. A family is compared as a whole once more, now together with its texts' whole shingle sets (64-bit hashes):
two nodes are linked only if the Jaccard similarity of their sets reaches the threshold. A large family is cut into
chunks, by rows and by shingles, and compared chunk against chunk.

Defined cases: a null, empty or wordless text has fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; rows that repeat each get a row; a null id never names a component unless all its ids are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import checkpoint, map_texts, on_all_cores, stored, table
from tarn.llm.graph import components

SHINGLE, RADIUS, SEED = 4, 4, 42
CHUNK = 2048
#: Most hot buckets whose chunk numbers are broadcast (24 bytes each); more are joined by shuffle.
HOT_KEYS = 200_000
_SLICE = 1 << 15


#: 64-bit words of a wide fingerprint, and the recall of its candidate search over pairs at the threshold.
WIDE, RECALL = 4, 0.995
#: Standard deviations that the candidate radius is wider than expected; sets up to FEW shingles differ in more bits than
#: the angle says, as ties are zeros.
WIDER, FEW, WIDER_FEW = 3, 32, 4.5
#: Keys of the first pass over candidates; the second, over the others, only looks at what the first hasn't joined.
FIRST_KEYS = 3
#: Shingles in a chunk of a family (8 bytes each).
CHUNK_SHINGLES = 2_000_000
#: Chunks of a bucket beyond which it is divided by the bits that its key leaves.
SPLIT = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    return fingerprint_words(text, shingle, 1, False)[0]


def fingerprint_words(text: str | None, shingle: int, words: int, distinct: bool) -> list[int]:
    """The fingerprint's words; the first comes from XXH64, the others from its values mixed on.

    distinct: each shingle counts once."""
    h = shingle_hashes(text, shingle)
    return _set_bits(np.unique(h) if distinct else h, words)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    tokens = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(tokens) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(tokens)) - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def _set_bits(hashes: np.ndarray, words: int) -> list[int]:
    out = []
    for word in range(words):
        h = hashes if not word else _mixed(hashes, word)
        set_bits = np.zeros(64, np.int64)
        for at in range(0, len(h), _SLICE):
            part = np.ascontiguousarray(h[at : at + _SLICE]).astype("<u8").view(np.uint8).reshape(-1, 8)
            set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<u8")[0]))
    return out


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Other 64 bits of the same shingles (the finalising steps of splitmix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc: str = "doc_id", text: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """doc_id, the columns of extra (bigint) and fp0, the fingerprint as a signed number."""
    rows = docs.select(F.col(doc).alias("doc_id"), *(extra or []), F.col(text).alias("text"))
    names = [c for c in rows.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> dict:
        return {n: batch.column(n) for n in names} | {"fp0": [_signed(fingerprint(t, shingle)) for t in batch.column("text").to_pylist()]}

    return map_texts(rows, rows.columns, run, ", ".join(f"{n} bigint" for n in names) + ", fp0 bigint")


def _names(shingles: np.ndarray) -> tuple[int, int]:
    """A set's name: 128 bits of its hash."""
    from xxhash import xxh3_128_intdigest

    wide = xxh3_128_intdigest(shingles.astype("<u8").tobytes(), SEED)
    return _signed(wide >> 64), _signed(wide & (1 << 64) - 1)


def wide_fingerprints(docs: DataFrame, shingle: int, doc: str, text: str, extra: list[Column]) -> DataFrame:
    """doc_id, the columns of extra (bigint), the distinct shingles' name (h1, h2) and number n, and their fingerprint."""
    rows = docs.select(F.col(doc).alias("doc_id"), *extra, F.col(text).alias("text"))
    names = [c for c in rows.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> dict:
        found = []
        for t in batch.column("text").to_pylist():
            h = np.unique(shingle_hashes(t, shingle))
            found.append((*_names(h), len(h), *map(_signed, _set_bits(h, WIDE))))
        columns = zip(*found, strict=True) if found else [()] * (3 + WIDE)
        return {n: batch.column(n) for n in names} | dict(zip(["h1", "h2", "n", *[f"fp{w}" for w in range(WIDE)]], map(list, columns), strict=True))

    return map_texts(rows, rows.columns, run, "".join(f"{n} bigint, " for n in names) + "h1 bigint, h2 bigint, n bigint" + "".join(f", fp{w} bigint" for w in range(WIDE)))


# --- bit-sliced comparison -------------------------------------------------------------------------------------------

class _Counters:
    """Bit-sliced counters of differing planes, sticky beyond their levels, fed by carry-save adders."""

    def __init__(self, n: int, radius: int) -> None:
        self.levels = (radius + 1).bit_length()
        self.radius = radius
        self.c = [np.zeros(n, np.uint64) for _ in range(self.levels)]
        self.over = np.zeros(n, np.uint64)
        self.held: list[np.ndarray | None] = [None] * self.levels

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        """Two planes of a level and its counter make a new counter and one plane of the next level."""
        if level == self.levels:
            self.over |= plane
        elif self.held[level] is None:
            self.held[level] = plane
        else:
            a, b, self.held[level] = self.held[level], plane, None
            c = self.c[level]
            both = a ^ b
            carry = (a & b) | (both & c)
            self.c[level] = both ^ c
            self.add(carry, level + 1)

    def beyond(self) -> np.ndarray:
        """Lanes whose count is over the radius."""
        for level in range(self.levels):  # what is held, so that the counters are exact
            if self.held[level] is not None:
                self.add(np.zeros_like(self.over), level)
        more, equal = self.over.copy(), ~self.over
        for level in reversed(range(self.levels)):
            c = self.c[level]
            if self.radius >> level & 1:
                equal = equal & c
            else:
                more |= equal & c
                equal = equal & ~c
        return more

    def keep(self, which: np.ndarray) -> None:
        self.c = [c[which] for c in self.c]
        self.over = self.over[which]


def sliced_links(groups: list[np.ndarray], radius: int = RADIUS, block: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j), i < j, as places in the groups' concatenation; pairs of different groups aren't compared.

    A group is an array of fingerprints, or of rows of fingerprint words."""
    if not groups:
        return
    groups = [g.reshape(len(g), -1) for g in groups]
    width = groups[0].shape[1]
    sizes = np.array([len(g) for g in groups])
    words = -(-sizes // 64)
    first_word, first_row = np.concatenate(([0], np.cumsum(words))), np.concatenate(([0], np.cumsum(sizes)))
    total = int(first_word[-1])
    lanes = np.zeros((total * 64, width), np.uint64)
    valid = np.zeros(total * 64, bool)
    row_of = np.zeros(total * 64, np.int64)
    for g, w, r in zip(groups, first_word[:-1], first_row[:-1], strict=True):
        at = slice(int(w) * 64, int(w) * 64 + len(g))
        lanes[at], valid[at], row_of[at] = g, True, np.arange(r, r + len(g))
    planes = np.empty((width * 64, total), np.uint64)
    for w in range(width):
        bits = np.unpackbits(np.ascontiguousarray(lanes[:, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lane, bit
        packed = np.packbits(bits.reshape(total, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")
        planes[w * 64 : w * 64 + 64] = np.ascontiguousarray(packed).reshape(64, total * 8).view("<u8")
    lives = np.packbits(valid.reshape(total, 64), axis=1, bitorder="little").view("<u8").reshape(total)
    values = np.concatenate(groups)
    # a row meets its own word and the later words of its group
    own = np.concatenate([first_word[k] + np.arange(len(g)) // 64 for k, g in enumerate(groups)])
    meets = np.repeat(first_word[1:], sizes) - own
    upto_row, done = np.cumsum(meets), 0
    while done < len(values):
        before = int(upto_row[done - 1]) if done else 0
        upto = max(done + 1, int(np.searchsorted(upto_row, before + block, side="right")))
        n = meets[done:upto]
        rows = np.repeat(np.arange(done, upto), n)
        at = np.repeat(own[done:upto], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield from _compare(values, planes, lives, row_of, rows, at, radius)
        done = upto


def _compare(values: np.ndarray, planes: np.ndarray, lives: np.ndarray, row_of: np.ndarray, rows: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    counters, x = _Counters(len(rows), radius), values[rows]
    last = len(planes) - 1
    first = min(last, 2 * radius + 15) | 7  # sooner than this, hardly a word is beyond the radius in all its lanes
    for b in range(last + 1):
        counters.add(planes[b][at] ^ (np.uint64(0) - (x[:, b // 64] >> np.uint64(b % 64) & np.uint64(1))))
        if b >= first and b % 8 == 7 or b == last:
            near = ~counters.beyond() & lives[at]
            if b < last:
                alive = np.flatnonzero(near)
                if not len(alive):
                    return
                if len(alive) < 0.7 * len(rows):
                    counters.keep(alive)
                    rows, at, x = rows[alive], at[alive], x[alive]
    for part in range(0, len(rows), 1 << 12):
        hit = np.unpackbits(near[part : part + (1 << 12)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(hit)
        i, j = rows[part + k], row_of[at[part + k] * 64 + lane]
        keep = i < j
        if keep.any():
            yield i[keep], j[keep]


class Forest:
    """Which of some rows are joined by the links seen so far."""

    def __init__(self, n: int, labels: np.ndarray | None = None) -> None:
        """labels: rows of the same one are joined from the start."""
        self.parent = np.arange(n)
        if labels is not None:
            _, first, of = np.unique(labels, return_index=True, return_inverse=True)
            self.parent = first[of]

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the links that join what wasn't joined yet; at most one fewer than there are rows in all."""
        parent, kept = self.parent, [(i[:0], j[:0])]
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                return np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            parent[high] = np.minimum(a, b)[first]
            kept.append((i[first], j[first]))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.parent = parent


def spanning(groups: list[np.ndarray], radius: int, keep=None, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Links that join what all links of a group join, as places in the groups' concatenation; at most one a row.

    keep: which of some linked pairs (i, j) count, as a mask. labels: of each row; rows of the same one are joined."""
    trees = Forest(sum(map(len, groups)), labels)
    found = [(trees.parent[:0], trees.parent[:0])]
    for i, j in sliced_links(groups, radius):
        if keep is not None:
            wanted = keep(i, j)
            i, j = i[wanted], j[wanted]
        found.append(trees.join(i, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


# --- candidates ------------------------------------------------------------------------------------------------------


def layout(radius: int, n: int, chunk: int = CHUNK) -> list[int]:
    """Bit masks of the tables for n fingerprints: every choice of c of radius + c blocks, c as small as buckets allow."""
    for c in range(1, 5):
        blocks = radius + c
        if n / 2 ** (64 * c // blocks) <= chunk / 4 or c == 4:
            cuts = [64 * i // blocks for i in range(blocks + 1)]
            masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
            return [_signed(sum(masks[i] for i in which)) for which in itertools.combinations(range(blocks), c)]
    raise AssertionError


def _share(similarity: float) -> float:
    """The share of bits in which two texts differ, given the Jaccard similarity of their shingle sets. Sets of equal
    number differ most."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def bands(similarity: float, words: int, n: int, chunk: int = CHUNK, recall: float = RECALL, seed: int = 1) -> list[list[int]]:
    """Bit numbers of each key: so many keys that of all pairs of the similarity the share recall has one in common.

    The keys' length follows the number of fingerprints, so that a bucket has a chunk or two on average: longer keys need
    more of them, and each is a row for every fingerprint."""
    size, share = 64 * words, _share(similarity)
    bits = max(11, math.ceil(math.log2(max(1, n) / (2 * chunk))))
    apart = [math.comb(size, d) * share**d * (1 - share) ** (size - d) for d in range(size)]
    keys = 1
    while sum(p * (1 - (1 - d / size) ** bits) ** keys for d, p in enumerate(apart)) > 1 - recall:
        keys += 1
    r = np.random.default_rng(seed)
    return [sorted(r.choice(size, bits, replace=False).tolist()) for _ in range(keys)]


def radius_of(similarity: float, words: int, deviations: float) -> int:
    """Bits in which texts of the similarity are expected to differ, and some standard deviations more."""
    n, share = 64 * words, _share(similarity)
    return max(0, round(n * share + deviations * math.sqrt(n * share * (1 - share))))


def keyed_by_masks(classes: DataFrame, masks: list[int]) -> DataFrame:
    """classes (node, fp0) with t and key, the fingerprint's bits under each mask."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp0").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    return classes.select("*", F.explode(keys).alias("k")).select(*classes.columns, "k.t", "k.key")


def _parts(mask: int, radius: int) -> list[int]:
    """The bits outside a mask in radius + 1 parts: two fingerprints within the radius agree on one of them."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(rest) * i // (radius + 1) for i in range(radius + 2)]
    return [_signed(sum(1 << b for b in rest[s:e])) for s, e in itertools.pairwise(cuts)]


def divided(keyed: DataFrame, masks: list[int], radius: int, chunk: int) -> DataFrame:
    """keyed (node, fp0, t, key) with the members of buckets over SPLIT chunks under keys of more bits, radius + 1 each.

    The new t holds the old one and the part's number, the new key the bits under the mask and the part."""
    hot = _hot(keyed, ["t", "key"], SPLIT * chunk)
    if hot is None:
        return keyed
    parts = F.array(*[F.array(*[F.lit(p) for p in _parts(m & (1 << 64) - 1, radius)]) for m in masks])
    own = F.element_at(parts, F.col("t") + 1)
    finer = F.transform(own, lambda m, i: F.struct((F.col("t") + F.lit(len(masks)) * (i + 1)).cast("int").alias("t"), F.col("key").bitwiseOR(F.col("fp0").bitwiseAND(m)).alias("key")))
    same = F.array(F.struct(F.col("t").cast("int").alias("t"), F.col("key").alias("key")))
    columns = [c for c in keyed.columns if c not in ("t", "key")]
    dealt = keyed.join(hot, ["t", "key"], "left").select(*columns, F.explode(F.when(F.col("chunks").isNull(), same).otherwise(finer)).alias("k"))
    return dealt.select(*columns, "k.t", "k.key")


def keyed_by_bits(classes: DataFrame, bits: list[list[int]], first: int = 0) -> DataFrame:
    """classes with key, a row for each of the keys: the fingerprint's bits of some numbers, and the key's number (from
    first) above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = {w: batch.column(f"fp{w}").to_numpy(zero_copy_only=False).view(np.uint64) for w in range(WIDE)}
            for t, places in enumerate(bits):
                key = np.full(batch.num_rows, first + t << 48, np.uint64)
                for i, b in enumerate(places):
                    key |= (prints[b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(i)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=[*batch.schema.names, "key"])

    return classes.mapInArrow(run, ", ".join(f"{c} bigint" for c in classes.columns) + ", key bigint")


def _hot(rows: DataFrame, keys: list[str], most: int, size: str | None = None, per: int = 1) -> DataFrame | None:
    """keys and chunks of those with over `most` rows, broadcast if they are few; None if there are none.

    size: a column whose sum counts besides, in chunks of `per`."""
    chunks = F.ceil(F.count("*") / most)
    if size is not None:
        chunks = F.greatest(chunks, F.ceil(F.sum(size) / per))
    return _few(rows.groupBy(*keys).agg(chunks.cast("int").alias("chunks")).where("chunks > 1"))


def _few(hot: DataFrame) -> DataFrame | None:
    hot = checkpoint(hot)
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= HOT_KEYS else hot


def _in_chunks(rows: DataFrame, keys: list[str], hot: DataFrame | None, by: str) -> DataFrame:
    """rows with lo and hi: a row of a key with n chunks is in n pairs of chunks, any other in one."""
    if hot is None:
        return rows.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    columns = [c for c in rows.columns if c not in keys]
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    own = F.pmod(F.xxhash64(by), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    dealt = rows.join(hot, keys, "left").select(*keys, *columns, F.explode(F.when(F.col("chunks").isNull(), one).otherwise(pairs)).alias("p"))
    return dealt.select(*keys, *columns, "p.lo", "p.hi")


def grouped(keyed: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """of: lists of classes (structs of their columns) with equal keys; every two of these share some list."""
    columns = [c for c in keyed.columns if c not in keys]
    dealt = _in_chunks(keyed, keys, _hot(keyed, keys, chunk), "fp0")
    return dealt.groupBy(*keys, "lo", "hi").agg(F.collect_list(F.struct(*columns)).alias("of")).where(F.size("of") > 1).select("of")


def _some_groups(batches: Iterator[pa.RecordBatch], rows: int = 16384) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The groups' columns, some thousands of rows at a time, and where each group ends among them (from 0)."""
    for batch in batches:
        lists = batch.column(0)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        columns = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + rows, side="right")) - 1)
            yield [c[offsets[at] : offsets[upto]] for c in columns], offsets[at : upto + 1] - offsets[at]
            at = upto


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def linked(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between classes (node, fp0, t, key) that join exactly what links inside equal keys join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (nodes, prints), ends in _some_groups(batches):
            values = prints.view(np.uint64)
            a, b = spanning([values[s:e] for s, e in itertools.pairwise(ends)], radius)
            if len(a):
                yield _edges(nodes[a], nodes[b])

    return grouped(keyed, ["t", "key"], chunk).mapInArrow(run, "a bigint, b bigint")


class Alike:
    """Which pairs may have the similarity, by the numbers of their shingles and the bits in which they differ."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.radius, self.few = similarity, radius_of(similarity, WIDE, WIDER), radius_of(similarity, WIDE, WIDER_FEW)

    def __call__(self, values: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        may = low >= self.similarity * high - 1e-6
        may[may] = (high[may] <= FEW) | (np.bitwise_count(values[i[may]] ^ values[j[may]]).sum(axis=1) <= self.radius)
        return may


def candidates(keyed: DataFrame, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between roots that join what the candidate links between classes (root, n, fp0, ..., key) of equal
    keys join."""
    alike = Alike(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (roots, n, *prints), ends in _some_groups(batches):
            values = np.stack(prints, axis=1).view(np.uint64)
            which = [np.arange(s, e) for s, e in itertools.pairwise(ends) if (roots[s:e] != roots[s]).any()]
            if which:
                place = np.concatenate(which)
                i, j = spanning([values[w] for w in which], alike.few, lambda i, j, place=place, values=values, n=n: alike(values, n, place[i], place[j]), roots[place])
                if len(i):
                    a, b = roots[place[i]], roots[place[j]]
                    yield _edges(np.maximum(a, b), np.minimum(a, b))

    return grouped(keyed, ["key"], chunk).mapInArrow(run, "a bigint, b bigint").distinct()


def families_of(classes: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """(node, root): what candidate links join, of all classes (node, n, fp0, ...) that have any.

    A few keys join most of what is to be joined; over the other ones only links between different roots are passed on,
    so a large family doesn't send its forest once a key."""
    # a bucket may be several times a family's chunk: fingerprints are small, and smaller buckets need more keys
    names, chunk = [f"fp{w}" for w in range(WIDE)], 4 * chunk
    bits = bands(similarity, WIDE, classes.count(), chunk // 4)
    single = classes.select("node", F.col("node").alias("root"), "n", *names)
    first = components(candidates(keyed_by_bits(single.drop("node"), bits[:FIRST_KEYS]), similarity, chunk))
    joined = first.select("node", F.col("root").alias("_root"))
    rooted = checkpoint(single.join(joined, "node", "left").select(F.coalesce("_root", "root").alias("root"), "n", *names))
    more = candidates(keyed_by_bits(rooted, bits[FIRST_KEYS:], FIRST_KEYS), similarity, chunk)
    found = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def verified_links(values: np.ndarray, sets: list[np.ndarray], alike: Alike) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs of the similarity join, of the candidate pairs between rows that aren't joined yet.

    sets: the rows' distinct shingles, in order. A row's shingles are looked up in all its candidates' at once."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    trees, found = Forest(len(sets)), [(n[:0], n[:0])]
    for i, j in sliced_links([values], alike.few):
        may = alike(values, n, i, j)
        i, j = i[may], j[may]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for s, e in itertools.pairwise(np.concatenate((np.flatnonzero(np.diff(i, prepend=-1)), [len(i)])).tolist()):
            a, of = int(i[s]), j[s:e]
            of = of[trees.parent[of] != trees.parent[a]]
            if not len(of):
                continue
            flat = np.concatenate([sets[b] for b in of.tolist()])
            ends = np.cumsum(n[of])
            at = np.minimum(np.searchsorted(sets[a], flat), len(sets[a]) - 1)
            both = np.add.reduceat((sets[a][at] == flat).astype(np.int64), ends - n[of])
            of = of[both >= alike.similarity * (len(sets[a]) + n[of] - both)]
            found.append(trees.join(np.full(len(of), a), of))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def verified(families: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, chunk: int) -> DataFrame:
    """Edges (a, b) that join what the links inside families (node, root) join; two nodes are linked if their shingle sets
    have the similarity. classes: (node, n); texts: (node, text), each node's among others."""
    alike, names = Alike(similarity), [f"fp{w}" for w in range(WIDE)]
    members = checkpoint(classes.select("node", "n").join(families, "node"))
    dealt = _in_chunks(members, ["root"], _hot(members, ["root"], chunk, "n", CHUNK_SHINGLES), "node")
    wanted = texts.join(dealt.groupBy("node").agg(F.collect_list(F.struct("root", "lo", "hi")).alias("to")), "node")

    def cut(batch: pa.RecordBatch) -> dict:
        found = [np.unique(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
        bits = [_set_bits(h, WIDE) for h in found]
        return {"to": batch.column("to"), "node": batch.column("node"), "of": [h.astype("<u8").tobytes() for h in found]} | {name: [_signed(b[w]) for b in bits] for w, name in enumerate(names)}

    place = "root:bigint,lo:int,hi:int"
    sets = map_texts(wanted, ["node", "text", "to"], cut, f"to array<struct<{place}>>, node bigint, of binary, " + ", ".join(f"{c} bigint" for c in names))
    rows = sets.select(F.explode("to").alias("to"), "node", "of", *names).select("to.root", "to.lo", "to.hi", "node", "of", *names)
    keys = ["root", "lo", "hi"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        one = pa.Table.from_batches(held)
        nodes = one.column("node").to_numpy()
        values = np.stack([one.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
        a, b = verified_links(values, [np.frombuffer(x.as_buffer(), np.uint64) for x in one.column("of")], alike)
        return _edges(nodes[a], nodes[b]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before: tuple | None = None
        for batch in batches:
            own = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            cuts = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
            for s, e in itertools.pairwise([0, *cuts.tolist(), len(own)]):
                if s == e:
                    continue
                if (now := tuple(own[s].tolist())) != before and held:
                    if (out := compare(held)) is not None:
                        yield out
                    held = []
                before = now
                held.append(batch.slice(s, e - s))
        if held and (out := compare(held)) is not None:
            yield out

    return rows.mapInArrow(run, "a bigint, b bigint")


def _met(rows: DataFrame, values: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """rows joined with values, one row a key; rows of a hot key are dealt to as many tasks as it has chunks."""
    if hot is None:
        return rows.join(values, keys)
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.col("chunks")).cast("int")
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("chunks")
    copies = values.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def _named(prints: DataFrame, classes: DataFrame, edges: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """prints with component_id; classes: (node, keys, least, copies), least the smallest id of those that have the keys."""
    roots = checkpoint(components(edges))
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "least"), "node")
    names = every.groupBy("root").agg(F.min("least").alias("component_id"))
    named = _met(every.select("node", "root"), names, ["root"], _hot(every, ["root"], chunk)).select("node", F.col("component_id").alias("_name"))
    found = classes.select("node", "least", *[F.col(k).alias(f"_{k}") for k in keys]).join(named, "node", "left")
    found = found.select(*[F.col(f"_{k}").alias(k) for k in keys], F.coalesce("_name", "least").alias("component_id"))
    copied = classes.where(F.col("copies") > chunk).select(*keys, F.ceil(F.col("copies") / chunk).cast("int").alias("chunks"))
    return _met(prints, found, keys, _few(copied))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, chunk: int = CHUNK, doc: str = "doc_id", text: str = "text", extra: list[Column] | None = None, least: str = "doc_id") -> DataFrame:
    """Per row: doc_id, the columns of extra, fp0 and component_id, the smallest `least` of those it reaches over links."""
    if not 0 <= radius <= 6:
        raise ValueError("radius must be between 0 and 6")
    prints = checkpoint(fingerprints(docs, shingle, doc, text, extra))
    classes = checkpoint(prints.groupBy("fp0").agg(F.min(least).alias("least"), F.count("*").alias("copies")).withColumn("node", F.col("fp0")))
    masks = layout(radius, classes.count(), chunk)
    keyed = divided(keyed_by_masks(classes.select("node", "fp0"), masks), masks, radius, chunk)
    return _named(prints, classes, linked(keyed, radius, chunk), ["fp0"], chunk)


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, chunk: int = CHUNK, doc: str = "doc_id", text: str = "text", extra: list[Column] | None = None, least: str = "doc_id") -> DataFrame:
    """The same with links between texts whose sets of shingles have the Jaccard similarity; fp0, ... are wide.

    docs must be a stored table: texts to check are read again by their place in it."""
    names, at = [f"fp{w}" for w in range(WIDE)], F.monotonically_increasing_id()
    prints = checkpoint(wide_fingerprints(docs, shingle, doc, text, [*(extra or []), at.alias("_at")]))
    classes = checkpoint(prints.groupBy("h1", "h2", "n", *names).agg(F.min(least).alias("least"), F.min("_at").alias("node"), F.count("*").alias("copies")))
    texts = docs.select(F.col(text).alias("text"), at.alias("node"))
    families = families_of(classes.select("node", "n", *names), similarity, chunk)
    return _named(prints.drop("n", "_at"), classes, verified(families, classes, texts, shingle, similarity, chunk), ["h1", "h2"], chunk)


def distinct_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but the row of the smallest id (a null id last) of each group of near-duplicates.

    Rows are told apart by their place in the input, which must be a stored table: it is read twice."""
    row = F.monotonically_increasing_id()
    found = similar(docs, shingle, similarity, extra=[row.alias("_row")], least="_row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row")).alias("m"))
    kept = first.select(F.col("m._row").alias("_tarn_row"))
    return docs.withColumn("_tarn_row", row).join(kept, "_tarn_row", "left_semi").drop("_tarn_row")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(on_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", hex_of("fp0").alias("fingerprint"), "component_id")
