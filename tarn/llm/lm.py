"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text (A-Z lower-cased) is its words and then one end. A word of the dictionary (the DICTIONARY most frequent training
tokens) is written with its Huffman code; any other is an escape and then its bytes and a space, each byte with a code
of its own. So a text is a run of bits, and every bit is predicted after all that stands before it. For each bit three
predictors look at different contexts. The first knows the place in the code alone, from the counts behind the codes:
exact ones of words; of bytes, how often the dictionary's words have them, each word once. The other two are of a dictionary word's bits the word before and the last very frequent word of the text; of a
byte's bits the last three bytes (the word before included) and the word's bytes so far. A context and the place in the
code are hashed to a slot that counts zeros and ones; slots of three bits in a row lie side by side.

A predictor's stretched probability enters a logistic mixer whose weights are chosen by a gate, the kind of bit and how
much two of the contexts have been seen. Learning is online: a shard of the training texts is read once, batch after
batch. Every batch is first predicted from what was seen before it, moves the weights and an adaptive probability map
behind the mixer, and is counted. Counters and maps of the shards are added up, weights averaged by their events. A
text's score is the sum over its bits, in log10; bits_per_byte is the same in bits for each byte of its tokens.

Every training text is read. What is kept of them grows with the input: the exact counts of all tokens as a table, the
shards (one for each SHARD_TOKENS tokens) and the slots, up to 2^SLOTS a predictor, as counters, codes and weights
are broadcast. Tokens outside the dictionary join the table of counts by shuffle, a row for each document and token;
frequent tokens never travel.

Defined cases: a null or empty text is the end alone; a null id counts as held out; repeated rows are scored each on its
own; with nothing to learn from, every bit has probability one half. Counts are whole numbers and added exactly; weights
depend on how the input is cut into shards, which is the same in every run over the same files and settings.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import on_all_cores, remainder, sliced, stored, table

FOLDS = 10
END = "\n"
#: Most words of the dictionary (about 60 MB in a worker with their codes), and those that count as very frequent.
DICTIONARY, FREQUENT = 200_000, 256
#: log2 of the most slots of a predictor (8 bytes each while counting, 2 when done) and of the fewest.
SLOTS, LEAST_SLOTS = 21, 12
#: Rows and bytes of texts that are cut into words at a time (a longer text alone), and tokens that are turned into bits at
#: a time.
ROWS, BYTES, BATCH = 4000, 1 << 21, 4096
#: Training tokens for each shard; there are as many shards as cores at least, if the input has as many partitions.
SHARD_TOKENS = 1 << 25
#: Counters in a row on its way between tasks, and shards whose counters are added up in one go.
BLOCK, ADDED = 1 << 11, 64
RATE, PRIOR = 0.02, 0.3
#: Batches of a shard that all move the mixer, and which of the later ones do: every one, none is left out.
LEARNED, EACH = 0, 1
#: Predictors, the first one without slots.
PREDICTORS, LEVELS = 3, 6
_GATES, _APM = 2 * LEVELS * LEVELS, 33
#: Counts beyond which a level ends.
_BOUNDS = [np.float32(x) for x in (0.5, 1.5, 3.5, 15.5, 127.5)]
#: A slot when done: its level and its stretched probability in steps of 1/128.
_STEP = 128
_STRETCH = ((np.arange(4096) - 2048) / _STEP).astype(np.float32)
_C1, _C2, _C3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_R = np.random.default_rng(11).integers(1, 1 << 31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_END, _ESCAPE, _WORDS = 0, 1, 2
#: Bits of a hash of 31 besides the first ones that the dictionary is looked up by.
_FIRST = 13
#: Of a packed bit: its value, its place in the group and the group.
_PLACE = (1 << 32) - 1
#: What a bit that is 0 or 1 adds to a slot's two counters as one number.
_PAIR = np.array([[1, 0], [0, 1]], np.uint32).view(np.uint64).ravel()


class Words:
    """The words of some texts (A-Z lower-cased, cut at ASCII white space), as numbers of distinct words."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = lists.flatten()
        text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        some = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(some).dictionary_encode()
        self.text = text[some.to_numpy(zero_copy_only=False)]
        self.index, self.distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.sizes = np.bincount(self.text, minlength=len(texts))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text) in parts of at most ROWS rows and about BYTES bytes."""
    for batch in sliced(batches, ROWS):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + BYTES, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([remainder(i, FOLDS) == 0 for i in ids.to_pylist()], bool)


# --- bits -----------------------------------------------------------------------------------------------------------------


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    ratio = n1 + np.float32(PRIOR)
    ratio /= n0 + np.float32(PRIOR)
    return np.log(ratio, out=ratio)


class Codes:
    """Huffman's codes of symbols with counts: for each the inner nodes from the root on, and the bit taken at each.

    Every three bits share a group, named by the node of the first one; inside it, places 1 to 7 go by the bits so far."""

    def __init__(self, counts: list[int]) -> None:
        n = len(counts)
        parent, bit = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        for new in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = new
            bit[y] = 1
            heapq.heappush(heap, (a + b, new))
        at, levels = np.arange(n), []
        live = np.arange(n) if n > 1 else np.arange(0)
        depth = np.zeros(n, np.int64)
        while len(live):
            levels.append((live, parent[at] - n, bit[at]))
            depth[live] += 1
            up = parent[at]
            rest = up != 2 * n - 2
            live, at = live[rest], up[rest]
        path, bits = np.zeros(int(depth.sum()), np.int32), np.zeros(int(depth.sum()), np.uint8)
        starts = np.cumsum(depth) - depth
        for k, (symbols, nodes, values) in enumerate(levels):
            place = starts[symbols] + depth[symbols] - 1 - k
            path[place], bits[place] = nodes, values
        passing = np.zeros((2, max(1, n - 1)))  # how often a bit is 0 or 1 at a node
        np.add.at(passing, (bits.astype(np.int64), path), np.repeat(np.array(counts, np.float64), depth))
        third = (np.arange(len(path)) - np.repeat(starts, depth)) % 3
        group, inside = path[np.arange(len(path)) - third], np.ones(len(path), np.uint8)
        for k in (1, 2):
            later = np.flatnonzero(third == k)
            inside[later] = 2 * inside[later - 1] + bits[later - 1]
        # one number for each bit: its value, its place in the group, the group and the node
        self.packed = bits.astype(np.int64) | inside.astype(np.int64) << 1 | group.astype(np.int64) << 4 | path.astype(np.int64) << 34
        self.lengths, self.starts, self.static, self.nodes = depth, starts, stretched(*passing).astype(np.float32), max(1, n - 1)

    @property
    def path(self) -> np.ndarray:
        return (self.packed >> 34).astype(np.int32)

    @property
    def bits(self) -> np.ndarray:
        return (self.packed & 1).astype(np.uint8)

    def spelled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a run of symbols: which one each bit belongs to, and the bit's place in packed."""
        n = self.lengths.take(symbols)
        of = np.repeat(np.arange(len(symbols)), n)
        at = (self.starts.take(symbols) - (np.cumsum(n) - n)).take(of)
        at += np.arange(len(of))
        return of, at

    def beside(self, other: Codes) -> Codes:
        """Both codes as one table, the other's symbols after the own ones; of each bit packed has what static says of the
        node, as 32 bits of a float, instead of the node, so that one look at the table is enough."""
        out = copy.copy(self)
        out.lengths, packed, path = (np.concatenate((getattr(self, k), getattr(other, k))) for k in ("lengths", "packed", "path"))
        out.starts = np.concatenate((self.starts, other.starts + len(self.packed)))
        out.static = np.concatenate((self.static, other.static))
        path[len(self.packed) :] += len(self.static)
        out.packed = packed & _PLACE | out.static.take(path).view(np.uint32).astype(np.int64) << 32
        return out


class Language:
    """The dictionary, and the codes of its words and of bytes."""

    def __init__(self, words: dict[bytes, int], others: int) -> None:
        """words: training tokens of the dictionary and their counts; others: how many tokens are none of them."""
        ordered = sorted((w for w in words if w != END.encode()), key=lambda w: (-words[w], w))
        self.dictionary = pa.array(ordered, pa.binary())
        self.counts = np.array([words.get(END.encode(), 0), 0, *(words[w] for w in ordered)], np.int64)
        self.words = Codes([int(self.counts[_END]) + 1, others + 1, *self.counts[_WORDS:].tolist()])
        letters = np.ones(256, np.int64)
        for w in ordered:
            np.add.at(letters, np.frombuffer(w + b" ", np.uint8), 1)
        self.bytes = Codes(letters.tolist())
        self.both, self.letters = self.words.beside(self.bytes), len(self.words.lengths)

    def __getstate__(self) -> dict:
        """Without the two codes on their own: workers go by both as one."""
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "bytes", "_places")}

    @cached_property
    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The dictionary's places by hash, the hashes (and one beyond all), and where those of the same first bits begin; made
        once in a worker."""
        parts = [self.dictionary.slice(at, 1 << 14) for at in range(0, len(self.dictionary), 1 << 14)]
        hashes = np.concatenate([np.zeros(0, np.uint32), *map(_hashed, parts)])
        order = np.argsort(hashes, kind="stable")
        hashes = np.append(hashes[order], np.uint32(1 << 31))
        return order, hashes, np.searchsorted(hashes, np.arange(1 << 31 - _FIRST, dtype=np.uint32) << np.uint32(_FIRST))

    def symbols(self, words: pa.Array, hashed: np.ndarray) -> np.ndarray:
        """Each word's symbol: its place in the dictionary, or the escape. hashed: see _hashed."""
        order, hashes, first = self._places
        at, out = first.take(hashed >> np.uint32(_FIRST)), np.full(len(words), _ESCAPE, np.int64)
        left = np.flatnonzero(hashes.take(at) < hashed)
        while len(left):
            at[left] += 1
            left = left[hashes.take(at[left]) < hashed[left]]
        left = np.flatnonzero(hashes.take(at) == hashed)
        while len(left):  # again for words that share a hash only
            place = order.take(at[left])
            same = pc.equal(words.take(pa.array(left)), self.dictionary.take(pa.array(place))).to_numpy(zero_copy_only=False)
            out[left[same]] = place[same] + _WORDS
            left = left[~same]
            at[left] += 1
            left = left[hashes.take(at[left]) == hashed[left]]
        return out


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes one after the other, and each word's number of bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8), np.diff(offsets).astype(np.int64)


def _hashed(words: pa.Array) -> np.ndarray:
    """31 bits of a hash of each word (none is empty)."""
    data, sizes = _flat(words)
    if not len(sizes):
        return np.zeros(0, np.uint32)
    starts = np.cumsum(sizes) - sizes
    mixed = (data.astype(np.uint32) + np.uint32(1)) * _R[(np.arange(len(data)) - np.repeat(starts, sizes)) & 63]
    mixed ^= mixed >> np.uint32(15)
    total = np.add.reduceat(mixed * _C2, starts, dtype=np.uint32)
    return (total ^ total >> np.uint32(13)) & np.uint32((1 << 31) - 1)


class Tokens:
    """The tokens of whole texts, each text's end included, and what stands before each of them."""

    def __init__(self, language: Language, texts: pa.Array) -> None:
        self.language, self.words = language, Words(texts)
        words = self.words
        distinct = words.distinct.cast(pa.binary())
        hashed = _hashed(distinct)
        known = language.symbols(distinct, hashed)
        n = len(words.index) + len(texts)
        place = np.arange(len(words.index)) + words.text
        self.ids, self.text = np.full(n, _END, np.int64), np.repeat(np.arange(len(texts)), words.sizes + 1)
        symbols = known[words.index]
        self.ids[place] = symbols
        self.unknown = np.flatnonzero(symbols == _ESCAPE)  # places among the words
        self.missing = place[self.unknown]
        # words that aren't in the dictionary, after the last letters of what stands before them (at the start an end)
        number = np.full(n, len(distinct))
        number[place] = words.index
        index = words.index[self.unknown]
        before = pa.concat_arrays([distinct, pa.array([END.encode()])]).take(pa.array(number[self.missing - 1]))
        before = pc.binary_slice(pc.binary_join_element_wise(b"  ", before, b""), -3)
        self.spelled = pc.binary_join_element_wise(before, distinct.take(pa.array(index)), b"", b" ")
        # what each token is known by as a context; an end is 0, so nothing reaches over texts
        key = self.ids.astype(np.uint32)
        key[self.missing] = hashed[index] | np.uint32(1 << 31)
        one, common = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        one[1:] = key[:-1]
        marks = (self.ids < _WORDS + FREQUENT) & (self.ids != _ESCAPE)
        seen = np.maximum.accumulate(np.where(marks, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        common[1:] = np.where(seen[:-1] >= 0, self.ids[seen[:-1]], _END)
        self.contexts = [(one + np.uint32(1)) * _C3, ~common * _C3]


class Bits:
    """The bits of the tokens from lo to hi: the slot of each predictor, the value, and the token (from lo on).

    What is written is the tokens and after them the letters of those spelled out; bits of tokens come first."""

    def __init__(self, tokens: Tokens, lo: int, hi: int, slots: int) -> None:
        code, symbols, contexts = tokens.language.both, tokens.ids[lo:hi], [c[lo:hi] for c in tokens.contexts]
        self._token = np.arange(hi - lo)
        first, last = np.searchsorted(tokens.missing, (lo, hi)).tolist()
        if first < last:
            word, letters, more = _letters(tokens.spelled.slice(first, last - first))
            symbols = np.concatenate((symbols, letters + tokens.language.letters))
            contexts = [np.concatenate(x) for x in zip(contexts, more, strict=True)]
            self._token = np.concatenate((self._token, tokens.missing[first:last][word] - lo))
        self._written, at = code.spelled(symbols)
        packed = code.packed.take(at, mode="clip")  # no place is out of range here; this mode is faster than the check
        self.words, self.tokens, self.size = int(np.searchsorted(self._written, hi - lo)), hi - lo, len(symbols)
        self.value, self.static = packed & 1, packed.view(np.float32)[1::2]
        inside = packed.astype(np.uint32)
        mixed = inside >> np.uint32(4)
        mixed[: self.words] *= _C1
        mixed[self.words :] *= _C3
        inside >>= np.uint32(1)
        inside &= np.uint32(7)
        self.slots = []
        for k, context in enumerate(contexts):
            hashed = context.take(self._written, mode="clip")
            hashed ^= mixed
            hashed *= _C2
            hashed ^= hashed >> np.uint32(15)
            hashed *= _C1
            hashed >>= np.uint32(35 - slots)
            hashed <<= np.uint32(3)
            hashed += inside
            hashed += np.uint32(k << slots)
            self.slots.append(hashed.astype(np.int64))

    def summed(self, of_bits: np.ndarray) -> np.ndarray:
        """Each token's sum over its bits."""
        of_symbols = np.bincount(self._written, weights=of_bits, minlength=self.size)
        return np.bincount(self._token, weights=of_symbols, minlength=self.tokens)


def _letters(spelled: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of words spelled out, each with four bytes in front that aren't predicted: the word, the byte and the contexts of each byte."""
    data, sizes = _flat(spelled)
    word = np.repeat(np.arange(len(spelled)), sizes)
    place = np.arange(len(data)) - (np.cumsum(sizes) - sizes)[word] - 4
    where = np.flatnonzero(place >= 0)
    word, place = word[where], place[where]
    wide = data.astype(np.uint32) + np.uint32(1)
    terms = wide[where] * _R[place & 63]
    running = np.cumsum(terms, dtype=np.uint32) - terms
    prefix = running - running[np.flatnonzero(place == 0)][word] + np.minimum(place, 255).astype(np.uint32)
    last = (wide[where - 1] << np.uint32(20)) + (wide[where - 2] << np.uint32(10)) + wide[where - 3]
    return word, data[where].astype(np.int64), [last * _C3 + np.uint32(7), prefix * _C3 + np.uint32(5)]


def slots_of(slots: int) -> int:
    """All predictors' slots; the first one has none."""
    return PREDICTORS - 1 << slots


# --- model ------------------------------------------------------------------------------------------------------------------


def level(n: np.ndarray) -> np.ndarray:
    """How much was seen, in LEVELS steps."""
    out = np.zeros(n.shape, np.uint8)
    for bound in _BOUNDS:
        out += n > bound
    return out


def done(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Slots in two bytes each: levels and stretched probabilities."""
    step = np.clip(np.rint(stretched(n0, n1) * _STEP), -2048, 2047).astype(np.int64) + 2048
    return (level(n0 + n1).astype(np.int64) << 12 | step).astype(np.uint16)


class Mixer:
    """Gated weights over the predictors, and the adaptive probability map behind them."""

    def __init__(self, weights: np.ndarray | None = None, apm: np.ndarray | None = None) -> None:
        self.weights = np.full((_GATES, PREDICTORS + 1), 0.3, np.float32) if weights is None else weights
        if weights is None:
            self.weights[:, -1] = 0
        self.square = np.full(self.weights.shape, 1e-3, np.float32)
        self.apm = np.zeros((2, _GATES * _APM)) if apm is None else apm

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(self.weights.T)
        total = columns[PREDICTORS].take(gate)
        for k in range(PREDICTORS):
            part = columns[k].take(gate)
            part *= x[k]
            total += part
        return np.clip(total, np.float32(-16), np.float32(16), out=total)

    def bucket(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        place = mixed * np.float32(2)
        np.rint(place, out=place)
        place += np.float32(_APM // 2)
        at = np.clip(place, np.float32(0), np.float32(_APM - 1), out=place).astype(np.int64)
        at += gate * _APM
        return at

    def refined(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mixed probability averaged with what its bucket has shown, the more the more it has shown."""
        p = 1 / (1 + np.exp(-mixed))
        at = self.bucket(mixed, gate)
        share = 4 / (self.apm[0] + self.apm[1] + 4)  # of the mixed probability in what the bucket says
        shown = (1 - share) * self.apm[1] / np.maximum(self.apm[0] + self.apm[1], 1)
        p *= (0.5 * (1 + share)).astype(np.float32).take(at)
        p += (0.5 * shown).astype(np.float32).take(at)
        return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)

    def learn(self, x: list[np.ndarray], gate: np.ndarray, value: np.ndarray, rate: float) -> None:
        """Moves each gate's weights and the map towards what came."""
        mixed = self.mix(x, gate)
        push = value.astype(np.float32) - 1 / (1 + np.exp(-mixed))
        at = self.bucket(mixed, gate)
        at *= 2
        at += value
        came = np.bincount(at, minlength=2 * self.apm.shape[1]).reshape(-1, 2)
        self.apm += came.T
        total = came.reshape(_GATES, -1).sum(axis=1)
        # four sums for each gate in turn, as neighbours mostly have the same one and would wait for each other
        turn = gate * 4
        turn += np.arange(len(gate)) & 3
        moved = np.stack([np.bincount(turn, weights=push * x[k] if k < PREDICTORS else push, minlength=4 * _GATES).reshape(_GATES, 4).sum(axis=1) for k in range(PREDICTORS + 1)], axis=1)
        step = (moved / np.maximum(total, 1)[:, None]).astype(np.float32)
        some = (total > 0)[:, None]
        self.square += np.where(some, 0.02 * (step * step - self.square), 0)
        self.weights += np.where(some, rate * step / np.sqrt(self.square), 0)


def gates(bits: Bits, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gate = a.astype(np.uint8) * np.uint8(LEVELS)
    gate += b.astype(np.uint8)
    gate[bits.words :] += LEVELS * LEVELS
    return gate.astype(np.int64)


class Learner:
    """One shard's counters (zeros and ones of each slot, 32 bits each) and mixer."""

    def __init__(self, language: Language, slots: int) -> None:
        self.language, self.slots, self.mixer = language, slots, Mixer()
        self.n = np.zeros(2 * slots_of(slots), np.uint32)
        self.steps, self.events = 0, 0

    def learn(self, texts: pa.Array) -> None:
        tokens = Tokens(self.language, texts)
        for lo in range(0, len(tokens.ids), BATCH):
            self._step(Bits(tokens, lo, min(lo + BATCH, len(tokens.ids)), self.slots))

    def _step(self, bits: Bits) -> None:
        pairs = self.n.view(np.uint64)
        x, seen, counted = [bits.static], [], _PAIR.take(bits.value)
        for slot in bits.slots:
            pair = pairs.take(slot, mode="clip").view(np.uint32)
            np.add.at(pairs, slot, counted)  # now, as the slots are at hand; each predictor has its own
            n0, n1 = pair[::2].astype(np.float32), pair[1::2].astype(np.float32)
            x.append(stretched(n0, n1))
            seen.append(level(n0 + n1))
        self.mixer.learn(x, gates(bits, *seen), bits.value, RATE / math.sqrt(1 + self.steps / 16))
        self.steps += 1
        self.events += len(bits.value)


class Model:
    """What has been learned: each slot (see done), and the mixer; the language travels on its own."""

    def __init__(self, language: Language | None, slots: int, known: np.ndarray, mixer: Mixer) -> None:
        self.language, self.slots, self.known, self.mixer = language, slots, known, mixer

    def probabilities(self, bits: Bits) -> np.ndarray:
        """Of each bit the probability that it is 1."""
        x, seen = [bits.static], []
        for slot in bits.slots:
            known = self.known.take(slot, mode="clip")
            x.append(_STRETCH.take(known & np.uint16(4095)))
            seen.append(known >> np.uint16(12))
        gate = gates(bits, *seen)
        return self.mixer.refined(self.mixer.mix(x, gate), gate)

    def log10(self, tokens: Tokens) -> np.ndarray:
        """Of each token the log10 of its probability after those before it."""
        out = np.zeros(len(tokens.ids))
        for lo in range(0, len(out), BATCH):
            hi = min(lo + BATCH, len(out))
            bits = Bits(tokens, lo, hi, self.slots)
            p = self.probabilities(bits)
            p -= 1 - bits.value.astype(np.float32)  # of a bit that is 0 the probability, negative
            np.log(np.abs(p, out=p), out=p)
            out[lo:hi] = bits.summed(p)
        return out / math.log(10)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Of each text."""
        tokens = Tokens(self.language, texts)
        return np.bincount(tokens.text, weights=self.log10(tokens), minlength=len(texts))


# --- the corpus ---------------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c): every token of the texts and how often the training documents have it.

    Words travel by the part of their hash, many in a row (no word has a space in it), and as many parts as the input has
    partitions add them up: a row for each word would cost several times that."""
    parts = max(32, docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words, train = Words(piece.column(1)), ~held_out(piece.column(0))
            c = np.append(np.bincount(words.index, weights=train[words.text], minlength=len(words.distinct)).astype(np.int64), train.sum())
            distinct = pa.concat_arrays([words.distinct.cast(pa.binary()), pa.array([END.encode()])])
            part = _hashed(distinct) % np.uint32(parts)
            order = np.argsort(part, kind="stable")
            some, starts = np.unique(part[order], return_index=True)
            ends = np.append(starts, len(order)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), distinct.take(pa.array(order))), b" ")
            counts = [x.tobytes() for x in np.split(c[order], starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), joined, pa.array(counts, pa.binary())], names=["part", "words", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, n = None, [], 0
        for batch in sliced(batches, 64):
            more.append(pa.table({"word": pc.split_pattern(batch.column("words"), " ").flatten(), "c": np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("counts")])}))
            n += more[-1].num_rows
            if n > max(1 << 20, held.num_rows if held else 0):
                held, more, n = _summed([held, *more]), [], 0
        if held or more:
            for batch in _summed([held, *more]).to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([batch.column("word").view(pa.string()), batch.column("c")], names=["word", "c"])

    sent = docs.select("doc_id", "text").mapInArrow(count, "part int, words binary, counts binary")
    return sent.repartitionById(parts, "part").mapInArrow(add, "word string, c bigint")


def _summed(tables: list[pa.Table | None]) -> pa.Table:
    return pa.concat_tables([t for t in tables if t is not None]).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])


def _least_count(words: DataFrame, most: int) -> int:
    """A count that at most so many tokens reach; counts are tallied by powers of a root of two, a bounded number."""
    step = F.floor(F.log2("c") * 16).cast("int")
    tally = {r[0]: (r[1], r[2]) for r in words.where("c > 0").groupBy(step).agg(F.count("*"), F.min("c")).collect()}
    total, least = 0, 1 << 62
    for k in sorted(tally, reverse=True):
        total += tally[k][0]
        if total > most:
            break
        least = tally[k][1]
    return least


def dictionary(words: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent training tokens and their counts; the end is always among them."""
    # words that were seen once stay outside, so that an escape is as likely as a new word
    chosen = words.where((F.col("c") >= max(2, _least_count(words, most))) | (F.col("word") == END)).toArrow()
    return {w.encode("utf-8", "surrogatepass"): c for w, c in zip(chosen.column("word").to_pylist(), chosen.column("c").to_pylist(), strict=True)}


#: What a block's counters travel as, by the largest.
_KINDS = (np.uint8, np.uint16, np.uint32)


def _added(rows: DataFrame, final: bool, by: int) -> DataFrame:
    """Rows (block, shard, data) of a block, and of `by` shards, added up in one pass. Counters are whole numbers, in any
    order; the mixers' row (block -1) is added in the order of shards. final: counters become slots as models hold them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        mixers: list[tuple[int, np.ndarray]] = []
        for batch in sliced(batches, 256):
            for block, shard, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block < 0:
                    mixers.append((shard, np.frombuffer(data, np.float64)))
                else:
                    n = np.frombuffer(data, f"u{len(data) // BLOCK}")
                    if (key := (block, shard // by)) in held:
                        held[key] += n
                    else:
                        held[key] = n.astype(np.uint64)
        sums: dict[int, np.ndarray] = {}
        for shard, data in sorted(mixers, key=lambda x: x[0]):
            sums[shard // by] = sums[shard // by] + data if shard // by in sums else data
        out = [(-1, shard, x.tobytes()) for shard, x in sums.items()]
        for (block, shard), n in held.items():
            if final:
                n = n.astype(np.float64).reshape(-1, 2)
            out.append((block, shard, (done(n[:, 0], n[:, 1]) if final else n).tobytes()))
        for at in range(0, len(out), 512):
            yield _batch(out[at : at + 512])

    tasks = max(32, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "block", F.floor(F.col("shard") / by)).mapInArrow(add, "block int, shard int, data binary")


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "shard", "data"])


def fit(rows: DataFrame, words: DataFrame, n_train: int, most: int = DICTIONARY) -> tuple[Broadcast, Broadcast]:
    """The language and the model learned from the training texts of rows (doc_id, text), broadcast."""
    context = rows.sparkSession.sparkContext
    known = dictionary(words, most)
    slots = min(SLOTS, max(LEAST_SLOTS, round(math.log2(max(1, n_train)))))
    language = Language(known, n_train - sum(known.values()))
    shared, size = context.broadcast(language), slots_of(slots)
    shards = max(context.defaultParallelism, -(-n_train // SHARD_TOKENS))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, own = TaskContext.get().partitionId(), Learner(shared.value, slots)
        for piece in pieces(batches):
            own.learn(piece.column(1).filter(pa.array(~held_out(piece.column(0)))))
        if not own.events:
            return
        mixer = np.concatenate(([own.events], (own.mixer.weights.astype(np.float64) * own.events).ravel(), own.mixer.apm.ravel()))
        out = [(-1, shard, mixer.tobytes())]
        for at in range(0, len(own.n), BLOCK):
            if (part := own.n[at : at + BLOCK]).any():
                least = next(t for t in _KINDS if part.max() <= np.iinfo(t).max)
                out.append((at // BLOCK, shard, np.pad(part, (0, BLOCK - len(part))).astype(least).tobytes()))
            if len(out) >= 512:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    learned = rows.coalesce(int(shards)).mapInArrow(learn, "block int, shard int, data binary")
    if shards > ADDED:
        learned = _added(learned, False, ADDED)
    found = _added(learned, True, 1 << 30).toArrow()
    # so many rows as there are blocks of slots, whatever the input
    known_slots, mixer = np.full(-(-2 * size // BLOCK) * BLOCK // 2, done(np.zeros(1), np.zeros(1))[0]), Mixer()
    for block, data in zip(found.column("block").to_pylist(), found.column("data"), strict=True):
        if block < 0:
            flat = np.frombuffer(data.as_buffer(), np.float64)
            n = mixer.weights.size
            mixer = Mixer((flat[1 : 1 + n] / flat[0]).reshape(mixer.weights.shape).astype(np.float32), flat[1 + n :].reshape(mixer.apm.shape))
        else:
            known_slots[block * BLOCK // 2 : (block + 1) * BLOCK // 2] = np.frombuffer(data.as_buffer(), np.uint16)
    return shared, context.broadcast(Model(None, slots, known_slots, mixer))


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int = DICTIONARY) -> DataFrame:
    """Per row: token counts, the unigram base score, the model's score and its bits for each byte."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    words = stored(vocabulary(rows))
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct")).first()
    n_train, n_distinct = int(size["tokens"]), int(size["distinct"])
    language, model = fit(rows, words, n_train, most)
    base_of = math.log10(n_train + 0.1 * (n_distinct + 1))
    names = ["row", "doc_id", "word", "tf", "tokens", "known", "base", "p", "n"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with its score and sums over its tokens in the dictionary, and a row for each other token."""
        from pyspark import TaskContext

        own, row = model.value, TaskContext.get().partitionId() << 33
        own.language = language.value
        logs, seen = np.log10(own.language.counts + 0.1), own.language.counts > 0
        logs[_ESCAPE] = 0

        def part(columns: list, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for piece in pieces(batches):
            n = piece.num_rows
            tokens = Tokens(own.language, piece.column(1))
            total = lambda x, text=tokens.text, n=n: np.bincount(text, weights=x, minlength=n)
            words, rows_ = tokens.words, row + np.arange(n)
            sizes = pc.add(pc.binary_length(words.distinct), 1).to_numpy(zero_copy_only=False)
            n_bytes = np.bincount(words.text, weights=sizes[words.index] if len(sizes) else [], minlength=n).astype(np.int64) + 1
            # no token has a space in it: this row meets no token, and the rows are spread evenly
            yield part([rows_, piece.column(0), [f" {r}" for r in rows_.tolist()], None, words.sizes + 1, total(seen[tokens.ids]).astype(np.int64), total(logs[tokens.ids]), total(own.log10(tokens)), n_bytes], n)
            pairs, tf = np.unique(words.text[tokens.unknown] << 32 | words.index[tokens.unknown], return_counts=True)
            if len(pairs):
                yield part([row + (pairs >> 32), None, words.distinct.take(pa.array(pairs & 0xFFFFFFFF)), tf, None, None, None, None, None], len(pairs))
            row += n

    spread_rows = rows.mapInArrow(spread, "row bigint, doc_id bigint, word string, tf bigint, tokens bigint, known bigint, base double, p double, n bigint")
    met = spread_rows.join(words.select("word", "c"), "word", "left")
    tf = F.col("tf")
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, tf).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", tf * F.log10(F.col("c") + F.lit(0.1)))).alias("base"),
        F.sum("p").alias("score"), F.sum("n").alias("n_bytes"),
    )
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    return sums.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(base_of)).alias("base_score"), "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document, by a model learned from all documents outside the held-out fold."""
    return score(on_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text")))
