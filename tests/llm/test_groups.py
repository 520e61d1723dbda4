"""Near-duplicates, decontamination, fingerprints: against brute force, and the defined cases."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tarn.llm import decontaminate, digest, graph, simhash


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints():
    for t in (" ".join(random.Random(2).choices(["a", "B", "cd", "é"], k=40_000)), None, "", " \n", "one", "A b c", "a b c d", "É é\x0bx Y\x1cz\u2003w " * 7, "word " * 300):
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


@pytest.mark.parametrize("words,radius", [(1, 4), (1, 0), (1, 6), (4, 42)])
def test_sliced_links(words, radius):
    r = np.random.default_rng(words + radius)
    groups = []
    for n in (1, 2, 64, 65, 200):
        g = r.integers(0, 1 << 63, (n, words), dtype=np.uint64)
        for i in range(1, n, 2):  # near the row before
            g[i] = g[i - 1]
            for b in r.choice(64 * words, r.integers(0, 2 * radius + 2), replace=False):
                g[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        groups.append(g)
    got = {(i, j) for a, b in simhash.sliced_links(groups, radius, block=64) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want, at = set(), 0
    for g in groups:
        d = np.bitwise_count(g[:, None] ^ g[None]).sum(axis=2)
        want |= {(i + at, j + at) for i, j in zip(*np.nonzero(np.triu(d <= radius, 1)), strict=True)}
        at += len(g)
    assert got == want


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_layouts_are_exact(n):
    """Any two fingerprints within the radius agree on some table's bits."""
    masks = [m & (1 << 64) - 1 for m in simhash.layout(4, n)]
    r = random.Random(n)
    for _ in range(300):
        differ = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("chunk", [4, 2048])
def test_components_of_documents(spark, chunk):
    """A long chain of texts that change little by little, hot buckets in chunks, copies, empty and null texts."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, " \t"), (903, "short"), (903, "short"), (None, "short")]
    for i in range(60):
        rows.append((100 + i * 7 % 60, " ".join(words)))
        words[r.randrange(len(words))] = f"x{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = simhash.near_duplicates(df, chunk=chunk).select("doc_id", "fp0", "component_id").collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints, 4)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, 10**9), i if i is not None else 10**9)
    want = sorted((str(i), simhash._signed(p), least[root]) for (i, _), p, root in zip(rows, prints, roots, strict=True))
    assert sorted((str(r.doc_id), r.fp0, r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_divided_buckets_are_exact(spark):
    """One bucket of many near fingerprints, far over the chunks: divided by their other bits they link as they should."""
    r = random.Random(4)
    base = r.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 9))) for _ in range(250)} | {r.getrandbits(64) for _ in range(50)})
    classes = spark.createDataFrame([(simhash._signed(v), simhash._signed(v)) for v in values], "node long, fp0 long")
    masks = simhash.layout(4, len(values))
    keyed = simhash.keyed_by_masks(classes, masks)
    parted = simhash.divided(keyed, masks, 4, 4)
    assert parted.select("t").distinct().count() > len(masks) and parted.count() > keyed.count()
    want = plain_components(values, 4)
    for rows in (keyed, parted):
        root = {x.node: x.root for x in graph.components(simhash.linked(rows, 4, 4)).collect()}
        got = [root.get(simhash._signed(v), simhash._signed(v)) for v in values]
        assert [got.index(x) for x in got] == want


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140)) and got[201] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_keep_one(spark):
    """Near copies of similarity over 0.9 go, unrelated texts and null ids stay; other columns stay as they are."""
    r = random.Random(5)
    make = lambda: [f"t{r.randrange(10**6)}" for _ in range(300)]
    base, rows = [make() for _ in range(8)], []
    for i, words in enumerate(base):
        rows.append((i * 10, " ".join(words), i))
        for j in (1, 2):
            near = list(words)
            near[r.randrange(300)] = "changed"
            rows.append((i * 10 + j, " ".join(near), i))
    rows += [(None, " ".join(base[0]), 9), (500, None, 9), (501, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    out = simhash.distinct_documents(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 10, 20, 30, 40, 50, 60, 70, 500]


def test_similarity_is_exact(spark):
    """Pairs of similarity 0.75 to 0.85 (and lower), chains, short texts: what stays is what brute force over sets says."""
    r = random.Random(8)
    rows, sets = [], []
    for group in range(150):
        n = r.choice([9, 14, 60, 200, 500])
        words = [f"g{group}w{i}" for i in range(n)]
        for _ in range(3):  # a run of new words takes a share of the shingles
            rows.append(" ".join(words))
            cut = max(1, round((n - 4) * r.uniform(0.06, 0.2)) - r.choice([0, 0, 4]) if n > 40 else 1)
            at = r.choice([0, n - cut])
            words = words[:at] + [f"x{r.random()}" for _ in range(cut)] + words[at + cut :]
    sets = [frozenset(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in rows]
    root = list(range(len(rows)))
    shares = []
    for i in range(len(rows)):
        for j in range(i - i % 3, i):
            shares.append(len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
            if shares[-1] >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    assert sum(0.75 <= s < 0.8 for s in shares) > 20 and sum(0.8 <= s < 0.85 for s in shares) > 20
    want = sorted({x: min(k for k in range(len(rows)) if root[k] == x) for x in root}.values())
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.distinct_documents(df).collect()) == want


def shared_pairs(texts, threshold):
    """Pairs of texts whose five-word shingle sets have the similarity, by an inverted index; equal sets apart."""
    sets = [frozenset(zip(*[w[i:] for i in range(5)], strict=False)) or frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for t in texts)]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    places, counts = {}, {}
    for i in first.values():
        for g in sets[i]:
            places.setdefault(g, []).append(i)
    for of in places.values():
        for k, a in enumerate(of):
            for b in of[:k]:
                counts[b, a] = counts.get((b, a), 0) + 1
    pairs = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in counts.items()}
    return sets, first, {p for p, j in pairs.items() if j >= threshold}


@pytest.mark.parametrize("chunk", [16, 2048])
def test_one_large_family(spark, monkeypatch, chunk):
    """Many near copies of one text with few or many changes, in small chunks too: the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 100 * chunk)
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(220):
        words = list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(150)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += texts[:40] + [" ".join(f"z{r.randrange(10**6)}" for _ in range(120)) for _ in range(30)]
    sets, first, links = shared_pairs(texts, 0.8)
    root = {i: i for i in first.values()}
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if v == old else v for k, v in root.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar(df, chunk=chunk).collect()}
    assert [got[i] for i in range(len(texts))] == [root[first[s]] for s in sets]
    assert 40 < len(set(got.values())) < 200


def test_near_duplicates_of_documents(spark):
    """On given documents: recall of the links between different texts against all pairs, and no text goes without a
    neighbour at the threshold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets, first, links = shared_pairs([t for _, t in rows], 0.8)
    root = {i: i for i in first.values()}
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if v == old else v for k, v in root.items()}
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    named = [got[i] for i, _ in rows]
    met = sum(named[a] == named[b] for a, b in links)
    assert len(links) > 2 and met >= 0.9 * len(links)
    assert all(named[i] == named[first[s]] for i, s in enumerate(sets))  # equal sets always meet
    assert all(root[first[sets[i]]] == root[first[sets[j]]] for i in range(len(rows)) for j in [[d for d, _ in rows].index(named[i])])


# --- decontamination ------------------------------------------------------------------------------------------------------


def plain_hits(text, items, window=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, names = fold(text), set(), set()
    for name, item in items:
        w = fold(item)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if w else ():
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(str(name) if name is not None else "null")
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 20])
def test_windows_against_brute_force(spark, block):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)] + ["É", "x9"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((1, 3, 9, 10, 11, 25))))) for i in range(25)] + [(None, "only nine words are in this item here now"), (99, None), (98, " .. "), (3, "v1 v1 v1 v1")]
    docs = []
    for i in range(60):
        text = r.choices([*vocabulary, "other"], k=r.randrange(80))
        for _ in range(r.randrange(3)):
            item = (r.choice(items)[1] or "").split()
            at = r.randrange(len(text) + 1)
            text[at:at] = item[: r.randrange(8, 26)]
        docs.append((i % 50, "-".join(text).upper()))
    docs += [(None, items[0][1]), (70, None), (71, ""), (72, " ".join([*r.choices(["other", "words", "v1"], k=70_000), items[5][1], *r.choices(["other", "v2"], k=9)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.items, x.items_sha256, x.contaminated) for x in decontaminate.decontaminate(df, bench, block_chars=block).collect())
    want = []
    for i, t in docs:
        n, h, names = plain_hits(t, items)
        want.append((str(i), n, h, names, hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0))
    assert got == sorted(want)
    clean = decontaminate.clean_documents(df, bench, block_chars=block)
    assert clean.columns == df.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------------------------------


def canon(text):
    n = lambda t: unicodedata.normalize("NFKC", t)
    return re.sub(r"\s+", " ", n(n(text or "").casefold())).strip(" ")


def test_canonical_fingerprints(spark):
    rows = [(1, "Straße  ÉÈ"), (2, "STRASSE éè\n"), (3, "ﬁn"), (4, "FIN"), (5, None), (6, ""), (6, " \t"), (None, "fin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit(0))
    got = digest.fingerprints(df).collect()
    by = {}
    for (_, t) in rows:
        by[canon(t)] = by.get(canon(t), 0) + 1
    assert len({r.fingerprint for r in got}) == len(by) == 3
    assert sorted(r.copies for r in got) == sorted(by[canon(t)] for _, t in rows)
    assert digest.fingerprints(df.limit(0)).count() == 0


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(digest, "wide_hash", lambda c: [(F.length(c) * 0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2")])
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in digest.fingerprints(df).collect()}
    assert got[1] == got[3] != got[2] == got[4]


@pytest.mark.parametrize("n", [0, 1, 2, 157])
def test_next_document(spark, tmp_path, n):
    r = random.Random(n)
    rows = [(r.choice((i, i, i + 10**9, -i)), "x" * r.randrange(1, 9) + str(i % 50)) for i in range(n)]
    if n > 5:
        rows += [rows[0], (None, "first"), (rows[1][0], "tie")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = digest.with_next(spark.read.parquet(str(tmp_path / "documents.parquet")), []).select("doc_id", "text", "next_doc_id", "next_text").collect()
    assert len(got) == len(rows)
    h = {t: x for t, x in df.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]], x[1]))
    want = [(*a, *b) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_next_document_of_hot_ids(spark, tmp_path):
    """Most rows have one id, or none: they are dealt out by hash and still follow one another."""
    r = random.Random(3)
    rows = [(7, f"seven {r.random()}") for _ in range(300)] + [(None, f"none {r.random()}") for _ in range(200)] + [(i, f"own {i}") for i in range(-20, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = digest.with_next(df, []).collect()
    h = {t: x for t, x in df.select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]], x[1]))
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*a, *b)) for a, b in zip(order, order[1:] + order[:1], strict=True))
    buckets = digest._buckets(df, "doc_id", "text").groupBy("_c", "_s").count()
    assert max(x["count"] for x in buckets.collect()) < 60


def check_fingerprints(spark, tmp_path, rows):
    """The query of all documents against a plain version."""
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = digest.op7_document_fingerprints(spark, str(tmp_path)).collect()
    h = {t: x for t, x in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]], x[1]))
    copies, want, prints = {}, [], {}
    for _, t in order:
        copies[canon(t)] = copies.get(canon(t), 0) + 1
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(edited) == canon(t)), float(canon(after) == canon(t)), copies[canon(t)], canon(t), canon(edited)))
    got = sorted(((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.copies), r.fingerprint, r.edited_fingerprint) for r in got)
    want.sort()
    assert [g[0] for g in got] == [w[:6] for w in want]
    for (_, own, edited), w in zip(got, want, strict=True):
        for c, p in ((w[6], own), (w[7], edited)):
            assert prints.setdefault(c, p) == p, c
    return prints


def test_query_of_fingerprints(spark, tmp_path):
    """Every column; equal canonical texts have equal fingerprints and others don't, the edited ones' included."""
    r = random.Random(11)
    texts = ["Straße  ÉÈ", "STRASSE éè", "ﬁn", "FIN", "", None, " \t", "a", "ab", "AB", "x" * 70_000, "y " * 30_000] + ["".join(r.choices("aB \u00e9", k=r.randrange(12))) for _ in range(60)]
    rows = [(i * 3 % 71, t) for i, t in enumerate(texts)] + [(500 + i, "the same text") for i in range(12)] + [(None, "no id"), (5, "ab"), (5, "ab")]
    prints = check_fingerprints(spark, tmp_path, rows)
    assert len(set(prints.values())) == len(prints)


def test_edited_texts_of_one_hash_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digest, "wide_hash", lambda c: [(F.length(c) * 0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2")])
    prints = check_fingerprints(spark, tmp_path, [(1, "abcd"), (2, "abcd"), (3, "efgh"), (4, "")])
    assert len(set(prints.values())) == len(prints)


def test_native_plans(spark):
    plan = digest.op7_document_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
