"""Encoding, chat formatting, the quality classifier, language-model scores and the pipeline."""

import hashlib
import math
import pickle
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import chat, lm, pieces, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return pieces.encoder(pieces.default_model())


TEXTS = ["", " ", "  ", "a", " a  b ", "▁", "x▁ y", "Hello\nworld\t!", "é漢字🙂 <s> </s> <unk> <0x41>", "a" * 5000, " " * 500 + "end", "tab\x00nul", "The the  the", "trailing "]


def test_ids_and_decoding_equal_the_library_s(encoder):
    texts = TEXTS + [" ".join(random.Random(i).choices(["of", "the", "▁", "", "né", "\n", "zzqx"], k=40)) for i in range(30)]
    got = encoder.encode(texts)
    assert got == encoder.sp.encode(texts)


def test_spans_cover_the_source(encoder):
    for t in TEXTS:
        ids, data = encoder.encode([t])[0], t.encode()
        spans = encoder.spans(t, ids)
        assert len(spans) == len(ids)
        at = 0
        for (s, e), i in zip(spans.tolist(), ids, strict=True):
            piece = encoder.sp.id_to_piece(i)
            assert s == at and e >= s
            if encoder.sp.is_byte(i):
                assert data[s:e] == bytes([int(piece[3:5], 16)])
            else:
                source = data[s:e].decode().replace(" ", "▁")
                assert piece == source or piece == "▁" + source and s == 0
            at = e
        assert at == len(data)


def compiled(table):
    """A compiled character map: a small double array with a node for each prefix, and the strings."""
    strings, values = b"", {}
    for k, v in table.items():
        values[k] = len(strings)
        strings += v + b"\0"
    nodes = {b""}
    for k in table:
        nodes |= {k[: i + 1] for i in range(len(k))}
    units, at, taken, starts, todo = {}, {b"": 0}, {0}, set(), [b""]
    while todo:
        node = todo.pop(0)
        labels = sorted({k[len(node)] for k in nodes if len(k) == len(node) + 1 and k.startswith(node)}) + ([0] if node in values else [])
        base = next(b for b in range(1, 1 << 20) if all((at[node] ^ b ^ x) not in taken for x in labels) and at[node] ^ b not in starts)
        starts.add(at[node] ^ base)
        for x in labels:
            taken.add(at[node] ^ base ^ x)
            if x:
                at[node + bytes([x])] = at[node] ^ base ^ x
                todo.append(node + bytes([x]))
            else:
                units[at[node] ^ base] = 0x80000000 | values[node]
        label = node[-1] if node else 0
        units[at[node]] = base << 10 | (node in values) << 8 | label
    flat = [units.get(i, 0) for i in range(-(-(max(units) + 257) // 256) * 256)]
    blob = struct.pack(f"<{len(flat)}I", *flat)
    return struct.pack("<I", len(blob)) + blob + strings


def test_character_map_takes_the_longest_prefix():
    table = {b"a": b"A", b"abc": b"X", "ﬁ".encode(): b"fi", b"\t": b" ", "é".encode(): "é".encode()}
    charmap = pieces.CharacterMap(compiled(table))
    assert charmap.longest(b"abd", 0) == (1, b"A") and charmap.longest(b"zabcd", 1) == (3, b"X") and charmap.longest(b"z", 0) is None
    text = "zabcab\tﬁé"
    out, source = pieces.Normaliser(charmap, True, False).aligned(text)
    assert out.decode() == "▁zXAb▁fié"
    data, mark = text.encode(), 3
    assert source[0] == 0 and source[mark : mark + 4].tolist() == [0, 1, 4, 5] and source[-1] == len(data)
    assert source[out.index(b"fi")] == source[out.index(b"fi") + 1] == data.index("ﬁ".encode())
    out, _ = pieces.Normaliser(charmap, True, True).aligned("  z  z ")
    assert out.decode() == "▁z▁z"
    assert pieces.Normaliser(charmap, True, True).aligned("   ")[0] == b""


def changed_model(tmp_path, **spec):
    """The public model with another normalisation, or without the pieces of single bytes."""
    from sentencepiece import sentencepiece_model_pb2

    with open(pieces.default_model(), "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if spec.pop("bytes", True) is False:
        proto.trainer_spec.byte_fallback = False
        kept = [p for p in proto.pieces if p.type != 6]
        del proto.pieces[:]
        proto.pieces.extend(kept)
    for k, v in spec.items():
        setattr(proto.normalizer_spec, k, v)
    path = str(tmp_path / "changed.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return path


def test_a_model_with_a_character_map(spark, tmp_path):
    """The map walk inside the operator: ids are the library's, pieces cover the source."""
    table = {"ﬁ".encode(): b"fi", "Å".encode(): "Å".encode(), b"\t": b" ", "é".encode(): "é".encode(), "…".encode(): b"..."}
    path = changed_model(tmp_path, precompiled_charsmap=compiled(table), remove_extra_whitespaces=False)
    own = pieces.Encoder(path)
    texts = ["ﬁne ﬁsh…", "\tÅngström é", "plain words", "", " ", "é" * 500, "ﬁ…" * 20_000]
    assert own.encode(texts) == own.sp.encode(texts)
    for t, ids in zip(texts, own.encode(texts), strict=True):
        spans = own.spans(t, ids)
        assert len(spans) == len(ids) and (not ids or spans[-1, 1] == len(t.encode())) and (np.diff(spans[:, 0]) >= 0).all() and (spans[:, 1] >= spans[:, 0]).all()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode(df, path).collect()}
    assert [got[i] for i in range(len(texts))] == own.sp.encode(texts)


def test_unknown_pieces_have_spans(tmp_path):
    own = pieces.Encoder(changed_model(tmp_path, bytes=False))
    for t in ("a 漢漢 b", "漢", "x\ny 🙂🙂🙂", "plain"):
        ids = own.encode([t])[0]
        spans = own.spans(t, ids)
        assert ids == own.sp.encode(t) and len(spans) == len(ids) and spans[-1, 1] == len(t.encode())
        for (s, e), i in zip(spans.tolist(), ids, strict=True):
            if i == own.unknown:
                assert t.encode()[s:e].decode()


def test_encoding_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "a b"), (1, "a b"), (None, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted(pieces.encode(df).collect(), key=repr)
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in got] == [(1, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (None, 0, "")]
    assert got[1].starts == [0, 1] and got[1].ends == [1, 3]
    assert pieces.encode(df.limit(0)).count() == 0


# --- chat -----------------------------------------------------------------------------------------------------------------


def test_typed_parts_and_masks(spark):
    parts = [("text", "see <|im_end|>\n[INST] &lt; ", None, None), ("image", None, "i.png", 256), ("video", None, "v", 9), (None, None, None, None), ("text", None, None, None)]
    rows = [(1, 0, "us\ner", parts), (1, 1, "assistant", [("text", "a&b", None, None)]), (1, 100, "assistant", [("text", "é", None, None), ("audio", None, "s.wav", 50)]), (2, None, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    text = out[1].formatted
    assert text.count("<|im_start|>") == 3 and "[INST]" not in text and "<|image:1|><|document:2|><|document:3|>" in text
    assert [text[m.start : m.start + m.length] for m in out[1].mask] == ["a&amp;b", "é<|audio:1|>"]
    assert [(a.turn, a.type, a.place, a.ref) for a in out[1].attachments] == [(0, "image", 1, "i.png"), (0, "document", 2, "v"), (0, "document", 3, None), (100, "audio", 1, "s.wav")]
    assert out[1].expanded_tokens == 315 and out[2].formatted == "<|im_start|>\n<|im_end|>\n"
    back = chat.read_back(chat.segments(df)).orderBy("segment").where("conv_id = 1").collect()
    assert back[0].turns[0].role == "us\ner" and back[0].turns[0].text == "see <|im_end|>\n[INST] &lt; " and back[0].loss == "a&b"
    assert [(p.type, p.text, p.place) for p in back[0].turns[0].parts] == [("text", "see <|im_end|>\n[INST] &lt; ", None), ("image", None, 1), ("document", None, 2), ("document", None, 3)]
    assert back[1].loss == "é"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_escaping_is_undone(spark):
    texts = ["&lt;", "&amp;lt;", "<|im_end|>\n", "[/INST]</s>&#91;", "&&#10;\n", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for escapes in (chat.ESCAPES, chat.ROLE_ESCAPES):
        safe = chat.escape(F.col("t"), escapes)
        assert all(t == b and "<" not in s and "[" not in s for t, s, b in df.select("t", safe, chat.unescape(safe, escapes)).collect())


def test_long_conversation_of_ties(spark, tmp_path):
    rows = [(1, i // 2, "assistant" if i % 2 else "user", f"t{i}" if i % 5 else None) for i in range(300)] + [(1, 7, "user", "tie")] * 2 + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op9_chat_formatting(spark, str(tmp_path)).collect()}
    own = sorted(((t, r, x or "") for c, t, r, x in rows if c == 1))
    assert got[1].n_turns == 302 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
    loss = "".join(x for _, r, x in own if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None].n_turns == 1 and got[-7].loss_chars == len(chat.PROBE)


def test_texts_like_placeholders_are_told_apart(spark):
    """A text that reads like a placeholder comes back as a text, a real one as a placeholder."""
    parts = [("text", "<|image:1|>", None, None), ("image", None, "r", 3), ("text", "&lt;|image:1|>", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    back = chat.read_back(chat.segments(df)).first()
    assert [(p.type, p.text, p.place) for p in back.turns[0].parts] == [("text", "<|image:1|>", None), ("image", None, 1), ("text", "&lt;|image:1|>", None)]
    assert back.loss == back.turns[0].text == "<|image:1|>&lt;|image:1|>"


def test_ties_go_by_the_text_as_it_is(spark, tmp_path):
    """Escaping changes the order of `5` and `<`, of `a` and `[`; turns of one number go by what they say."""
    import duckdb

    said = ["5", "<", "[", "a", "&", "B", "%", "", None, "&amp;", "é", "Z["]
    rows = [(1, t, r, x) for t in (0, None, 3) for r in ("user", "assistant", "<u") for x in said] + [(1, 0, "user", "x" * 70_000 + "<")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(chat.ORACLE_SQL).fetchall())
    got = chat.op9_chat_formatting(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()) == want


def test_chat_plan_is_native(spark):
    plan = chat.op9_chat_formatting(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- quality ----------------------------------------------------------------------------------------------------------------


def test_chunks_cover_the_text():
    for n in (0, 1, 7, 255, 256, 257, 480, 481, 1000):
        x = quality.chunks_of("ab" * n)
        flat = np.concatenate([x[0], *[c[quality.OVERLAP :] for c in x[1:]]])
        assert bytes(flat[flat < 256].astype(np.uint8)) == b"ab" * n and len(x) >= 1


def test_gradients():
    """Against differences: the loss's change with a parameter."""
    net = quality.ByteConvNet(3)
    for k in ("bias", "dense", "out"):
        net.p[k] = net.p[k].astype(np.float64) + 0.1
    texts, y = ["some text " * 60, "### junk ###" * 9, "x"], np.array([1, 0, 1], np.float32)
    cut = [quality.chunks_of(t) for t in texts]

    def loss():
        p = net.scores(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = net._gradients(cut, y)
    seen = [b for b in b"some text#" for _ in range(2)]
    places = {k: [(i,) for i in range(min(5, len(net.p[k])))] for k in ("dense", "bias", "out")}
    places |= {"embed": [(b, i % quality.EMBED) for i, b in enumerate(seen)], "kernel": [(w, w % quality.EMBED, 3 * w % quality.FILTERS) for w in range(quality.WIDTH)]}
    for k, of in places.items():
        net.p[k] = net.p[k].astype(np.float64)
        for i in of:
            old = net.p[k][i]
            net.p[k][i] = old + 1e-3
            up = loss()
            net.p[k][i] = old - 1e-3
            down = loss()
            net.p[k][i] = old
            decay = 1e-4 * old if k in ("embed", "kernel", "dense") else 0
            assert abs((up - down) / 2e-3 + decay - got[k][i]) < 2e-3, (k, i)


def plain_score(net, text):
    """The network by loops: every filter at every place of every chunk."""
    data = [*(text or "").encode()]
    step = quality.CHUNK - quality.OVERLAP
    starts = [0]
    while starts[-1] + quality.CHUNK < len(data):
        starts.append(starts[-1] + step)
    p, rows = net.p, []
    for s in starts:
        chunk = (data[s : s + quality.CHUNK] + [256] * quality.CHUNK)[: quality.CHUNK]
        x = p["embed"][chunk].astype(np.float64)
        best = [max(float((x[i : i + quality.WIDTH] * p["kernel"][:, :, f]).sum()) for i in range(quality.CHUNK - quality.WIDTH + 1)) for f in range(quality.FILTERS)]
        rows.append([max(0.0, b + p["bias"][f]) for f, b in enumerate(best)])
    h = np.array(rows)
    z = np.concatenate([h.max(axis=0), h.mean(axis=0), h.min(axis=0)]) @ p["dense"] + p["out"][0]
    return 1 / (1 + math.exp(-z))


def test_scores_against_loops():
    net = quality.ByteConvNet(4)
    net.p["bias"] += 0.05
    texts = [None, "", "short", "é" * 128, "x" * 257, "The quick brown fox. " * 40]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_long_texts_train(spark):
    """Only long texts are labelled, what tells them apart stands anywhere in them, and ids repeat."""
    r = random.Random(2)
    rows = []
    for i in range(40):
        words = r.choices(["lorem", "ipsum", "dolor", "sit"], k=9000)
        if i % 2:
            words[::40] = ["@@##!!%%"] * len(words[::40])
        rows.append((i, " ".join(words)))
    rows += [rows[3], (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(40)] + [(999, 1, 0)], "doc_id long, quality int, toxic int")
    assert min(len(t) for _, t in rows[:-1]) > 40_000
    model = quality.train(df, labels, sample_chunks=48)
    assert isinstance(model, quality.ByteConvNet)
    got = quality.classify(df, model).where("doc_id <> 3").collect()
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 2 == 0) for x in got]) > 0.9


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert got[got.quality == 1].predicted.mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality_cases(spark):
    rows = [(1, "a", 5), (1, None, 5), (None, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    out = quality.classify(df, model).collect()
    assert [r.score for r in out] == [0.5] * 3 and {r.held_out for r in out if r.doc_id is None} == {True}
    assert quality.classify(df, model, keep=True).columns == df.columns
    assert quality.classify(df.limit(0), quality.ByteConvNet()).count() == 0
    assert len(quality.classify(df, quality.ByteConvNet()).collect()) == 3


# --- language model -----------------------------------------------------------------------------------------------------------


def test_base_scores_and_cases(spark):
    rows = [(i, t) for i, t in enumerate(["the cat Sat", "the\tdog", "", None, "a rare zebra", "the the the", " \u00c9 x\x0by\x1cz\u2003w \r\n"] * 4)] + [(5, "the dog"), (5, "the dog"), (None, "unseen token")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    for most in (3, lm.DICTIONARY):
        got = lm.score(df, most=most).collect()
        held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
        tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
        counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
        n, v = sum(counts.values()), len(counts)
        want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert lm.score(df.limit(0)).count() == 0


LM_TEXTS = ["the cat sat on the mat", "the cat the dog", "a cat sat", "", "of the mat and the cat", "the dog sat on a mat"] * 3


def words_of(text):
    return (text or "").encode().lower().split()


def learned(texts, slots=18, most=4):
    """A language, a learner that has read the texts, and the model it makes."""
    counts = Counter(w for t in texts for w in [*words_of(t), b"\n"])
    known = dict(counts.most_common(most)) | {b"\n": counts[b"\n"]}
    language = lm.Language(known, sum(counts.values()) - sum(known.values()))
    learner = lm.Learner(language, slots)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for piece in lm.pieces(iter([batch])):
        learner.learn(piece.column(1))
    n = learner.n.reshape(-1, 2).astype(np.float64)
    return language, learner, lm.Model(language, slots, lm.done(n[:, 0], n[:, 1]), learner.mixer)


def token_logs(model, texts):
    return model.log10(lm.Tokens(model.language, pa.array(texts, pa.string())))


def ids_of(language):
    return {w: i + 2 for i, w in enumerate(language.dictionary.to_pylist())}


def plain_bits(language, text):
    """For each token of a text its bits: what each predictor knows as its context, the bit, and the kind."""
    common, words = b"\n", [*words_of(text), b"\n"]
    place = lambda code, symbol: [(int(x >> 34), int(x & 1)) for x in code.packed[code.spelled(np.array([symbol]))[1]]]
    for i, w in enumerate(words):
        one = words[i - 1] if i else b"\n"
        symbol = 0 if w == b"\n" else ids_of(language).get(w, 1)
        token = [((("1", one, n), ("c", common, n)), b, 0, language.words.static[n]) for n, b in place(language.words, symbol)]
        if symbol == 1:
            line = (b"  " + one)[-3:] + b" " if i else b"  \n "
            for k, byte in enumerate(w + b" "):
                s = line + (w + b" ")[:k]
                token += [((("b", s[-3:], n), ("p", (w + b" ")[:k], n)), b, 1, language.bytes.static[n]) for n, b in place(language.bytes, byte)]
        if ids_of(language).get(w, 1 << 30) < 2 + lm.FREQUENT or w == b"\n":
            common = w
        yield token


def test_scores_against_a_plain_model(monkeypatch):
    """The same model with dictionaries of contexts instead of slots and loops over bits, learned in small batches."""
    monkeypatch.setattr(lm, "BATCH", 8)
    monkeypatch.setattr(lm, "LEARNED", 3)
    language, learner, model = learned(LM_TEXTS)
    tokens, seen = [x for t in LM_TEXTS for x in plain_bits(language, t)], {}
    weights, square, apm = np.full((lm._GATES, 4), 0.3), np.full((lm._GATES, 4), 1e-3), np.zeros((lm._GATES, 33, 2))
    weights[:, 3] = 0

    def look(keys, kind, static, step=None):
        n = [seen.get(k, (0, 0)) for k in keys]
        steps = [sum(sum(pair) > b for b in (0.5, 1.5, 3.5, 15.5, 127.5)) for pair in n]
        x = [math.log((b + 0.3) / (a + 0.3)) for a, b in n]
        return [float(static), *([round(v * step) / step for v in x] if step else x), 1.0], kind * 36 + steps[0] * 6 + steps[1]

    mixed = lambda x, gate: max(-16.0, min(16.0, float(weights[gate] @ x)))
    place = lambda z: int(max(0, min(32, round(2 * z) + 16)))
    for step, at in enumerate(range(0, len(tokens), 8)):
        batch = [(*look(keys, kind, static), keys, bit) for t in tokens[at : at + 8] for keys, bit, kind, static in t]
        moved, total = np.zeros_like(weights), np.zeros(lm._GATES)
        drawn = [(gate, place(z), bit, bit - 1 / (1 + math.exp(-z)), x) for x, gate, _, bit in batch for z in [mixed(x, gate)]]
        for gate, _, _, push, x in drawn:
            moved[gate] += push * np.array(x)
            total[gate] += 1
        learns = step < 3 or step % lm.EACH == 0
        for gate in np.flatnonzero(total) if learns else ():
            g = moved[gate] / total[gate]
            square[gate] += 0.02 * (g * g - square[gate])
            weights[gate] += lm.RATE / math.sqrt(1 + step / 16) * g / np.sqrt(square[gate])
        for gate, at_map, bit, _, _ in drawn if learns else ():
            apm[gate, at_map, bit] += 1
        for _, _, keys, bit in batch:
            for k in keys:
                a, b = seen.get(k, (0, 0))
                seen[k] = (a + (not bit), b + bit)
    assert learner.steps == -(-len(tokens) // 8) and np.allclose(learner.mixer.weights, weights, atol=1e-4)
    fresh = ["the cat sat on a hat", "", "the the", "zebra the mat"]
    want = []
    for t in [*LM_TEXTS, *fresh]:
        total = 0.0
        for token in plain_bits(language, t):
            for keys, bit, kind, static in token:
                x, gate = look(keys, kind, static, 128)
                z = mixed(x, gate)
                p = 1 / (1 + math.exp(-z))
                n0, n1 = apm[gate, place(z)]
                p = max(1e-6, min(1 - 1e-6, 0.5 * p + 0.5 * (n1 + 4 * p) / (n0 + n1 + 4)))
                total += math.log10(p if bit else 1 - p)
        want.append(total)
    assert np.allclose(model.texts(pa.array([*LM_TEXTS, *fresh])), want, atol=2e-3)


def test_probabilities_sum_up():
    """After the same words, all dictionary words, the end and the escape together; and all bytes of an escaped word."""
    language, _, model = learned(LM_TEXTS)
    first = token_logs(model, ["the cat"])
    total = 10 ** first[-1] + sum(10 ** token_logs(model, ["the cat " + w.decode()])[2] for w in ids_of(language))
    bits = lm.Bits(lm.Tokens(language, pa.array(["the cat zz"])), 2, 3, model.slots)
    p = model.probabilities(bits)
    escape = np.prod(np.where(bits.value > 0, p, 1 - p)[: bits.words])
    assert abs(total + escape - 1) < 1e-6
    for c in (language.words, language.bytes):  # complete prefix codes
        assert abs(sum(2.0 ** -c.lengths) - 1) < 1e-9


def test_codes_are_huffman_s():
    counts = [3, 1, 1, 9, 27, 2, 2, 40]
    codes = lm.Codes(counts)
    strings = []
    for i in range(len(counts)):
        at = codes.spelled(np.array([i]))[1]
        strings.append("".join(map(str, codes.bits[at])))
        assert len(set(codes.path[at].tolist())) == len(at) and codes.path[at[0]] == codes.nodes - 1
        below = [sum(c for j, c in enumerate(counts) if set(codes.path[codes.spelled(np.array([j]))[1]].tolist()) >= {n}) for n in codes.path[at].tolist()]
        assert below[0] == sum(counts) and sorted(below, reverse=True) == below
        assert (codes.packed[at] >> 1 & 7).tolist() == [int("1" + strings[-1][k - k % 3 : k], 2) for k in range(len(at))]
        assert (codes.packed[at] >> 4 & (1 << 30) - 1).tolist() == [codes.path[at[k - k % 3]] for k in range(len(at))]
    assert not any(a != b and b.startswith(a) for a in strings for b in strings)
    merged, h = 0, sorted(counts)
    while len(h) > 1:
        merged += h[0] + h[1]
        h = sorted([h[0] + h[1], *h[2:]])
    assert sum(c * len(s) for c, s in zip(counts, strings, strict=True)) == merged
    left, right = (sum(c for c, s in zip(counts, strings, strict=True) if s[0] == bit) for bit in "01")
    assert abs(codes.static[codes.nodes - 1] - math.log((right + 0.3) / (left + 0.3))) < 1e-5


def test_scores_through_spark(spark, tmp_path):
    """One shard gives the same numbers as one process, and the same twice; word order matters; a very long text is scored whole."""
    r = random.Random(6)
    texts = [" ".join(r.choices(["the", "cat", "sat", "on", "mat", "x%d" % r.randrange(50)], k=r.randrange(60))) for _ in range(120)] + ["the cat sat on mat " * 30_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = {x.doc_id: x.score for x in lm.score(df, most=5).collect()}
    assert got == {x.doc_id: x.score for x in lm.score(df, most=5).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in [*words_of(t), b"\n"])
    language, _, model = learned(train, slots=min(lm.SLOTS, max(lm.LEAST_SLOTS, round(math.log2(sum(counts.values()))))), most=5)
    want = model.texts(pa.array(texts))
    assert len(language.dictionary) <= 5 and np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5)
    ordered, mixed = model.texts(pa.array(["the cat sat on mat", "mat on sat cat the"]))
    assert ordered > mixed


def test_many_shards_are_added_in_steps(spark, monkeypatch, tmp_path):
    """The same scores whether counters of all shards are added up at once or by twos first."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(6, "doc_id").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    scores = lambda: {r.doc_id: r.score for r in lm.score(df, most=500).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 10_000)
    once = scores()
    monkeypatch.setattr(lm, "ADDED", 2)
    assert once == scores() and len(set(once.values())) > 10


def test_words_are_found_without_building_the_dictionary_anew():
    """A few words in a large dictionary take far less time than a new table of it."""
    language = pickle.loads(pickle.dumps(lm.Language({b"w%d" % i: 9 for i in range(50_000)} | {b"\n": 5}, 3)))
    texts, ids = pa.array(["w7 new W49999"]), {w: i for i, w in enumerate(language.dictionary.to_pylist(), 2)}
    assert lm.Tokens(language, texts).ids.tolist() == [ids[b"w7"], 1, ids[b"w49999"], 0]

    def least(call):
        times = []
        for _ in range(7):
            began = time.process_time()
            call()
            times.append(time.process_time() - began)
        return min(times)

    assert least(lambda: lm.Tokens(language, texts)) < least(lambda: pc.index_in(pa.array([b"w7"]), language.dictionary)) / 2


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    words = [b"w%d" % i for i in range(300)]
    language = lm.Language({w: 3 for w in words[::2]} | {b"\n": 5}, 3)
    for share in (1, 2, 40, 1 << 31):
        monkeypatch.setattr(lm, "_hashed", lambda x, share=share: np.array([zlib.crc32(w) % share for w in x.to_pylist()], np.uint32))
        language.__dict__.pop("_places", None)
        got = lm.Tokens(language, pa.array([" ".join(w.decode() for w in words)])).ids.tolist()
        assert got == [ids_of(language).get(w, 1) for w in words] + [0]


def test_counters_count_on_beyond_floats():
    language = lm.Language({b"a": 5, b"\n": 1}, 0)
    learner = lm.Learner(language, 12)
    learner.n[:] = 1 << 24
    learner.learn(pa.array(["a"] * 3))
    assert learner.n.max() == (1 << 24) + 3


def test_every_batch_moves_the_mixer(spark, monkeypatch, tmp_path):
    """No training text is left out of the weights and the map: each bit of each is in the map once, late batches move weights."""
    texts = ["the cat sat on a mat zebra%d" % (i % 7) for i in range(2)] + ["the cat sat on a mat by the dog " * 40_000]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    rows = spark.read.parquet(str(tmp_path / "d"))
    words = lm.vocabulary(rows)
    language, model = lm.fit(rows, words, words.agg(F.sum("c")).first()[0])
    train = pa.array([t for i, t in enumerate(texts, 1) if zlib.crc32(str(i).encode()) % 10])
    tokens = lm.Tokens(language.value, train)
    assert len(tokens.ids) > 80 * lm.BATCH
    assert model.value.mixer.apm.sum() == sum(len(lm.Bits(tokens, lo, min(lo + 999, len(tokens.ids)), 12).value) for lo in range(0, len(tokens.ids), 999))
    monkeypatch.setattr(lm, "BATCH", 8)
    learner = learned(LM_TEXTS)[1]
    while learner.steps < 100:
        before, steps = learner.mixer.weights.copy(), learner.steps
        learner.learn(pa.array(["the cat sat"]))
        assert learner.steps == steps + 1 and not np.array_equal(before, learner.mixer.weights)


def test_model_beats_the_base_score_on_held_out(spark):
    got = lm.score(spark.read.parquet(f"{SF}/../sf0.1/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()
    assert 1.5 < got.bits_per_byte.mean() < 4.0


# --- pipeline -----------------------------------------------------------------------------------------------------------------


def test_stages_keep_columns_and_rows(spark, tmp_path):
    """Each stage alone on awkward rows, then the whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(random.Random(1).choices(["words", "of", "a", "very", "long", "text", "4111"], k=120_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, long, "en", "s", len(long))], docs.schema)
    docs.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("pattern", F.lit(1)).coalesce(2).write.parquet(str(tmp_path / "d"))
    mixed = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, mixed, SF)
        assert out.count() > 0
        if name != "pieces":
            assert out.columns == mixed.columns
        if name in ("pii", "pieces"):
            assert out.count() == mixed.count()
        assert stage(spark, mixed.limit(0), SF).count() == 0
    done = corpus_pipeline.run(spark, SF)
    assert 0 < done.count() <= docs.count() and done.select("doc_id").distinct().count() == done.count()
