"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation walks the text with the longest prefix found in the model's compiled character map (a double-array trie
and its replacement strings), records for every normalised byte the source byte it came from, puts the dummy prefix in
front and turns spaces into U+2581. An empty map leaves the text as it is, which is done for whole texts at once. The
model's pieces then tile the normalised bytes, so their running lengths, sent through the alignment, give each piece's
span in the original UTF-8 bytes.

No piece of the vocabulary holds U+2581 after another character (checked on loading), so no merge crosses the start of
a word: the normalised text is cut there, and the pieces of a cut part are worked out once and remembered (at most
MEMO parts a worker). A model for which this doesn't hold, or whose map isn't empty, is segmented text by text.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import _arrow_schema, on_all_cores, sha256, sliced, table

SPACE = "▁"
MEMO = 80_000
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class CharacterMap:
    """A compiled character map: longest-prefix lookup in its double-array trie."""

    def __init__(self, blob: bytes) -> None:
        self.empty = not blob
        if self.empty:
            return
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that data has at a place, and what replaces it."""
        units, best = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for n in range(1, len(data) - at + 1):
            byte = data[at + n - 1]
            if byte == 0:
                break
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if (unit & 0x800000FF) != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if (unit >> 8) & 1:
                value = units[node] & 0x7FFFFFFF
                best = n, self.strings[value : self.strings.index(b"\0", value)]
        return best


class Normaliser:
    def __init__(self, charmap: CharacterMap, dummy_prefix: bool, remove_extra: bool) -> None:
        self.charmap, self.dummy_prefix, self.remove_extra = charmap, dummy_prefix, remove_extra

    def plain(self, text: str) -> str | None:
        """The normalised text if the map is empty and spaces stay."""
        if not self.charmap.empty or self.remove_extra:
            return None
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the offset of the source byte."""
        data = text.encode("utf-8", "surrogatepass")
        mark = SPACE.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.charmap.empty and not self.remove_extra:
            prefix = len(mark) * self.dummy_prefix
            wide = np.where(np.frombuffer(data, np.uint8) == 32, len(mark), 1)
            source = np.repeat(np.arange(len(data)), wide)
            return (mark * self.dummy_prefix + data.replace(b" ", mark)), np.concatenate((np.zeros(prefix, np.int64), source, [len(data)]))
        chunks: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            found = None if self.charmap.empty else self.charmap.longest(data, at)
            if found is None:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                chunks.append((data[at : at + n], at))
            else:
                n, new = found
                chunks.append((new, at))
            at += n
        out, source = bytearray(), []
        blank = self.remove_extra  # whether a space would be extra here
        if self.dummy_prefix:
            out += mark
            source += [0] * len(mark)
            blank = self.remove_extra
        for new, where in chunks:
            for i in range(len(new)):
                if new[i] == 32:
                    if self.remove_extra and blank:
                        continue
                    blank = True
                    out += mark
                    source += [where] * len(mark)
                else:
                    blank = False
                    out.append(new[i])
                    source.append(where + i if len(new) > 1 and data[where : where + len(new)] == new else where)
        if self.remove_extra:
            while out.endswith(mark) and len(out) > len(mark) * self.dummy_prefix:
                del out[-len(mark) :], source[-len(mark) :]
        if len(out) == len(mark) * self.dummy_prefix and self.remove_extra:
            return b"", np.array([len(data)])
        return bytes(out), np.array([*source, len(data)], np.int64)


class Encoder:
    def __init__(self, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto.FromString(blob)
        spec = proto.normalizer_spec
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.normaliser = Normaliser(CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        whole = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
        self.by_part = whole and proto.trainer_spec.model_type == 2 and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        self.lengths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = proto.trainer_spec.unk_id
        self.memo: dict[str, list[int]] = {SPACE: [self.sp.piece_to_id(SPACE)]}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_part:
            return self.sp.encode(texts, num_threads=1)
        parts = [_PARTS.findall(self.normaliser.plain(t)) for t in texts]
        missing = list({p for of in parts for p in of if p not in self.memo})
        found = dict(zip(missing, self.sp.encode([p[1:] for p in missing], num_threads=1), strict=True))
        memo = self.memo
        if len(memo) + len(found) <= MEMO:
            memo.update(found)
            found = memo
        elif found:
            room = MEMO - len(memo)
            known = {p: memo[p] for of in parts for p in of if p in memo}
            memo.update(list(found.items())[: max(0, room)])
            found |= known
        else:
            found = memo
        out = []
        for of in parts:
            ids: list[int] = []
            for p in of:
                ids += found[p]
            out.append(ids)
        return out

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """Start and end of each piece in the text's UTF-8 bytes, as rows."""
        normalised, source = self.normaliser.aligned(text)
        lengths = self.lengths[np.array(ids, np.int64)]
        if self.unknown in ids:  # an unknown piece is as long as the run of characters that it stands for
            lengths = np.array([n if i != self.unknown else len(p.encode()) for n, i, p in zip(lengths.tolist(), ids, self.sp.encode(text, out_type=str), strict=True)], np.int64)
        ends = np.cumsum(lengths)
        if len(ids) and ends[-1] != len(normalised):
            raise ValueError("the pieces don't tile the normalised text")
        if not len(ids):
            return np.zeros((0, 2), np.int64)
        starts, stops = source[np.concatenate(([0], ends[:-1]))], source[ends]
        inside = np.flatnonzero(stops <= source[ends - 1])  # the piece ends within what replaces one source character
        stops[inside] = source[np.searchsorted(source, source[ends[inside] - 1], side="right")]
        stops[ends <= len(SPACE.encode()) * self.normaliser.dummy_prefix] = 0  # the dummy prefix has no source
        return np.stack((starts, stops), axis=1)


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """One encoder a worker and model."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, doc: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Ids, spans of the pieces in the original bytes and the decoded text of each document; digests: their digests instead.

    model: a path that every executor can open; by default the public 32k model of each executor's own installation.
    """
    if digests:
        schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    else:
        schema = "doc_id bigint, n_tokens bigint, ids array<int>, starts array<int>, ends array<int>, decoded string"
    from pyspark.sql.types import _parse_datatype_string

    arrow = _arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model or default_model())
        decimal = [str(i) for i in range(own.sp.get_piece_size())]
        for part in sliced(batches):
            texts = ["" if t is None else t for t in part.column(1).to_pylist()]
            rows = []
            for doc_id, t, ids in zip(part.column(0).to_pylist(), texts, own.encode(texts), strict=True):
                spans, decoded = own.spans(t, ids), own.sp.decode(ids) if ids else ""
                if digests:
                    rows.append((doc_id, len(ids), sha256(",".join([decimal[i] for i in ids]).encode()), sha256(decoded.encode()), sha256(spans.astype("<i8").tobytes())))
                else:
                    rows.append((doc_id, len(ids), ids, spans[:, 0], spans[:, 1], decoded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, the decoded text and the pieces' byte spans of every whole document."""
    return encode(on_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text")), digests=True)
