"""Exact, passage, embedding and near duplicates, mixing and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import common, embedding_dedup, exact_dedup, kernels, minhash_dedup, mixing, quality, queries, suffix_dedup


def small_docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, ids string, kept string")


def components_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k + 1001, k + 1000) for k in range(60)] + [(2000 + k, 2000) for k in range(40)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame([(max(e), min(e)) for e in edges], "hi long, lo long")).collect()}
    ids = {i for e in edges for i in e}
    assert {i: got.get(i, i) for i in ids} == components_of(ids, edges)
    assert common.components(spark.createDataFrame([], "hi long, lo long")).count() == 0


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3)
    f = common.IdFilter.build(ids, "id", 14)
    assert f.has(np.arange(0, 3000, 3)).all() and f.has(np.arange(1, 3000, 3)).mean() < 0.3
    may, rest = f.split(spark.range(3000), "id")
    assert may.count() + rest.count() == 3000


TEXTS = ["a  b", "a b", "a\tb", None, "", " ", "x" * 200_000, "x" * 200_000, "A b", "a b ", "\x0b", "é", "é"]


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 7)
    rows = [(i, TEXTS[(i * 7) % len(TEXTS)] if i % 3 else f"text {i % 200}") for i in range(400, 0, -1)]
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.index(small_docs(spark, rows).repartition(5), bits).collect()}
    assert len(got) == len(rows)
    for i, t in norm.items():
        assert (got[i]["keep_id"], got[i]["group_size"], bytes(got[i]["sha"]).hex()) == (min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_cases(spark):
    rows = small_docs(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "z"), (2, "a"), (None, "z")])
    got = sorted(((r["doc_id"] or 0), r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.dedup(rows).collect())
    assert got == [(0, 0, 2, False), (0, 0, 2, True), (0, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False)]
    assert exact_dedup.dedup(rows.limit(0)).count() == 0 and exact_dedup.survivors(rows.limit(0)).count() == 0
    kept = exact_dedup.survivors(rows)
    assert kept.columns == rows.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "None"]
    clash = spark.createDataFrame([(1, "a", "x", 1), (2, "a ", "y", 2), (3, "a ", "y", 3)], "doc_id long, text string, __sha string, keep_id int")
    assert sorted(map(tuple, exact_dedup.survivors(clash).collect())) == [(1, "a", "x", 1), (2, "a ", "y", 2)]


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup_hot_group_and_repeated_rows(spark, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 50)
    monkeypatch.setattr(exact_dedup, "ENTRY_IDS", 7)
    rows = [(i % 90, "the same") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(40)] + [(2000, "own 3")]
    got = exact_dedup.index(small_docs(spark, rows).repartition(3), bits).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 41
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted((i, 0 if t == "the same" else 1003 if t == "own 3" else i, 300 if t == "the same" else 2 if t == "own 3" else 1) for i, t in rows)
    assert sorted(r["doc_id"] for r in exact_dedup.survivors(small_docs(spark, rows)).collect()) == [0, *range(1000, 1040)]


def test_runs_are_sorted_and_lookups_skip_them(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 20)
    rows = small_docs(spark, [(i, f"text {i}") for i in range(200)] + [(500 + i, f"text {i}") for i in range(10)]).repartition(4)
    runs = exact_dedup.build_runs(rows)
    by_run = defaultdict(list)
    for r in runs.collect():
        by_run[r["run"]].append(bytes(r["digest"]))
    assert len(by_run) >= 10 and all(d == sorted(d) and len(d) <= 20 for d in by_run.values())
    merged = exact_dedup.compact(runs)
    assert merged.level == 1 and {r["keep_id"] for r in merged.entries.where("parts > 1").collect()} <= set(range(10)) and merged.entries.count() == 200
    probes = runs.where("n > 0").select("digest", "least")
    some, others = exact_dedup.passing(probes, merged)
    asked = some.count()
    assert asked + others.count() == probes.count()
    found = [r["least"] for r in exact_dedup.lookup(probes, merged).where("keep_id IS NOT NULL").collect()]
    assert len(found) <= asked < 60  # most digests never reach the run
    assert set(found) == {i for r in merged.entries.where("parts > 1").collect() for i in (r["keep_id"], r["keep_id"] + 500)}


def test_batches_are_looked_up_and_merged(spark, monkeypatch):
    """Three batches one after the other: each row's copies over all batches so far, runs merged level by level."""
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 15)
    r = random.Random(8)
    rows = [(i, r.choice(["", " ", "a  b", "a b", None, *(f"text {k}" for k in range(40))])) for i in r.sample(range(1000), 240)]
    index, seen = exact_dedup.Index(), []
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for k in range(0, 240, 60):
        batch = rows[k : k + 60]
        got = {x["doc_id"]: x for x in index.add(small_docs(spark, batch).repartition(3)).collect()}
        seen += batch
        assert sorted(got) == sorted(i for i, _ in batch)
        for i, t in batch:
            copies = [j for j, u in seen if plain(u) == plain(t)]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(copies), len(copies), i == min(copies))
    assert [run.level for run in index.runs] == [3]
    (run,) = index.runs
    held = {bytes(e["digest"]): (e["keep_id"], e["group_size"]) for e in run.entries.collect()}
    assert len(held) == len({plain(t) for _, t in rows}) and sum(n for _, n in held.values()) == 240


def test_suffix_array():
    r = random.Random(2)
    for _ in range(1500):
        s = [r.randrange(1, r.choice([2, 3, 5, 250]) + 1) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7, 10, 33, 100]))]
        assert suffix_dedup.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_segments(monkeypatch):
    """Each string is in one segment, with the leftmost of its least hashed 20 bytes as the anchor, in any tiles."""
    r = random.Random(9)
    texts = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 10, 49, 50, 51, 90, 300]))) for _ in range(60)] + [b"x" * 200, b""]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = [x.tolist() for x in suffix_dedup.segments(raw, offsets)]
    starts = [(row, first + i) for row, first, n, *_ in zip(*found) for i in range(n)]
    assert starts == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 49)]
    anchors = {}
    for row, first, n, h, place in zip(*found):
        own = texts[row][first + place : first + place + 20]
        assert place >= n - 1 and place + 20 <= 50 and anchors.setdefault(h, own) == own
        for i in range(n):  # equal strings have their anchor at the same place
            string = texts[row][first + i : first + i + 50]
            assert anchors.setdefault(string, place - i) == place - i
    for tile in (1, 7, 100):
        monkeypatch.setattr(suffix_dedup, "TILE", tile)
        assert [x.tolist() for x in suffix_dedup.segments(raw, offsets)] == found


def brute_removal(docs, width=50):
    first = {}
    for i, b in sorted(docs.items()):
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], i)
    out = {}
    for i, b in docs.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_passages(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    docs = {}
    for i in range(120):
        parts = [" ".join(word() for _ in range(r.randrange(40)))]
        for _ in range(r.randrange(3)):
            passage = r.choice(shared)
            cut = r.randrange(len(passage) // 2)
            parts += [passage[cut:], word()]
        docs[i] = "".join(parts)
    docs |= {200: None, 201: "", 202: "a" * 5000, 203: "a" * 777, 204: "ab" * 400, 205: docs[3], 206: "x" * 49, 207: "x" * 49, 208: "x" * 50, 209: "x" * 51}
    want = brute_removal({i: (t or "").encode() for i, t in docs.items()})
    rows = small_docs(spark, list(docs.items())).repartition(6)
    for tile, hot, sort in ((suffix_dedup.TILE, suffix_dedup.HOT_SEGMENTS, suffix_dedup.SORT_BYTES), (64, 20_000, 300), (1000, 1, 300)):
        monkeypatch.setattr(suffix_dedup, "TILE", tile)
        monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort)
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.digests(rows).collect()}
        assert got == want


def test_passages_in_slices(spark, monkeypatch):
    """What is moved and written behind the segments is a slice of them at a time, and the filter's bits follow the strings."""
    r = random.Random(11)
    shared = ["".join(r.choice("abcdefgh ") for _ in range(150)) for _ in range(12)]
    docs = [(i, " ".join(r.choice(shared) if r.random() < 0.5 else "".join(r.choice("ijklmnop ") for _ in range(60)) for _ in range(8))) for i in range(40)]
    rows, counted = spark.createDataFrame(docs, "doc_id long, text string"), []

    def counting(df, label, *more):
        out = common.staged(df, label, *more)
        counted.append((label, out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "staged", counting)
    marks = suffix_dedup.repeated_strings
    monkeypatch.setattr(suffix_dedup, "repeated_strings", lambda d: marks(d, slices=3))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.digests(rows).collect()}
    assert got == brute_removal({i: t.encode() for i, t in docs}) and any(x[1] for x in got.values())
    parts = [n for label, n in counted if label == "distinct"]
    assert len(parts) == 3 and all(0 < n < 0.7 * sum(parts) for n in parts)
    # at 6 GB of input (10 GB of text), 24 million listed anchors (extrapolated in proportion from 0.5 GB) set few of the bits
    assert 24e6 / 2 ** suffix_dedup.filter_bits(10 << 30) < 0.05 and suffix_dedup.filter_bits(1 << 20) < 20


def test_passage_cases(spark):
    rows = small_docs(spark, [(None, "y" * 60), (1, "y" * 60), (1, "y" * 60), (2, "y" * 60)])
    got = sorted((str(x["doc_id"]), x["n_removed"]) for x in suffix_dedup.digests(rows).collect())
    assert got == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]
    assert suffix_dedup.digests(rows.limit(0)).count() == 0


def test_passages_query(spark, sf):
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in queries.op5_suffix_dedup(spark, sf).collect()} == brute_removal(docs)


def brute_near(docs, size, percent):
    sets = {}
    for i, t in docs.items():
        t = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return {i: len(s) for i, s in sets.items()}, components_of(sets, links)


def test_words():
    import pyarrow as pa

    texts = ["The the\tTHE x", None, "", "y" * 100 + " " + "Y" * 100, "a", " b"]
    raw, offsets = kernels.column_bytes(pa.array(texts))
    h, row = kernels.words(raw, offsets)
    assert row.tolist() == [0, 0, 0, 0, 3, 3, 4, 5] and len(set(h[:3].tolist())) == 1 and h[4] == h[5] and len(set(h.tolist())) == 5


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    r = random.Random(6)
    vocabulary = [f"W{k}" for k in range(3000)]
    docs, n = {}, 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randrange(30, 200))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(r.randrange(1 + len(own) // 40)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            docs[n] = " ".join(own)
            n += 1
    docs |= {n: None, n + 1: "", n + 2: " \t", n + 3: "One", n + 4: "one", n + 5: "two", n + 6: "z " * 40_000, n + 7: "z " * 30_000}
    sizes, comps = brute_near(docs, size, 80)
    got = {x["doc_id"]: x for x in minhash_dedup.dedup(small_docs(spark, list(docs.items())).repartition(4), size).collect()}
    assert {i: x["n_shingles"] for i, x in got.items()} == sizes
    assert {i: x["component_id"] for i, x in got.items()} == comps
    assert all(x["kept"] == (i == x["component_id"]) for i, x in got.items())


def test_near_duplicates_across_large_groups(spark, monkeypatch):
    """Many variants of one text: links must be found although few are with a bucket's hub."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "BLOCK_GRAMS", 500)
    r = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    docs = {}
    for i in range(90):
        own = list(base)
        for k in r.sample(range(60), r.randrange(1, 7)):
            own[k] = f"u{r.randrange(10**6)}"
        docs[i] = " ".join(own)
    _, comps = brute_near(docs, 2, 80)
    got = {x["doc_id"]: x["component_id"] for x in minhash_dedup.dedup(small_docs(spark, list(docs.items())), 2).collect()}
    assert sum(got[i] != comps[i] for i in docs) <= 2  # MinHash may miss a pair just at 0.8


def test_near_duplicate_cases(spark):
    rows = small_docs(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "a b c"), (None, None)])
    got = sorted((str(x["doc_id"]), str(x["component_id"]), x["n_shingles"], x["kept"]) for x in minhash_dedup.dedup(rows).collect())
    assert got == [("3", "3", 1, True), ("5", "3", 1, False), ("5", "3", 1, False), ("None", "None", 0, True), ("None", "None", 1, True)]
    clash = spark.createDataFrame([(1, "a b", 7, 8), (2, "a b", 9, 10)], "doc_id long, text string, __id int, c0 int")
    assert [tuple(r) for r in minhash_dedup.survivors(clash).collect()] == [(1, "a b", 7, 8)]
    assert minhash_dedup.dedup(rows.limit(0)).count() == 0
    assert sorted(str(x["doc_id"]) for x in minhash_dedup.survivors(rows).collect()) == ["3", "None", "None"]


def test_near_duplicates_with_repeated_ids_are_the_same_each_time(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "a b c d e f g h i j x"), (3, "k l m n o p q r s t x")]
    runs = [sorted((x["doc_id"], x["component_id"]) for x in minhash_dedup.dedup(small_docs(spark, rows).repartition(k), 2).collect()) for k in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_near_duplicates_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sizes, comps = brute_near(docs, 2, 80)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.op10_minhash_dedup(spark, sf).collect()}
    assert got == {i: (sizes[i], comps[i]) for i in docs}


def planted_vectors():
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 64))
    rows = [(i, v, i % 3) for i, v in enumerate(x)]
    for k in range(240):  # pairs just above and below the threshold, and close ones
        v = x[k] / np.linalg.norm(x[k])
        e = r.standard_normal(64)
        e -= (e @ v) * v
        e /= np.linalg.norm(e)
        c = [0.935, 0.94, 0.925, 0.99][k % 4]
        rows.append((1000 + k, 3 * (c * v + np.sqrt(1 - c * c) * e), k % 3))
    rows += [(2000 + k, x[7], 7 % 3) for k in range(40)] + [(3000 + k, x[9] + 0.01 * r.standard_normal(64), 0) for k in range(60)]
    return rows


def brute_links(rows, threshold=0.93):
    """Number of links and component of every row (id, vector, label), by the definition."""
    m = np.array([np.array(v, float) / np.abs(v).max() for _, v, _ in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    labels = np.array([l for *_, l in rows])
    linked = (m @ m.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    ids = [i for i, *_ in rows]
    comps = components_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(linked)))])
    return linked.sum(axis=1).tolist(), [comps[i] for i in ids]


@pytest.mark.parametrize("cell", [8, 512])
def test_embeddings(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "SPLIT", 16)
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rows = planted_vectors()
    odd = [(5000, None, 0), (5001, [0.0] * 64, 0), (5002, [None] + [1.0] * 63, 0), (5003, [float("nan")] + [1.0] * 63, 0), (5004, [float("inf")] * 64, 0), (5005, rows[0][1].tolist(), None), (5008, [], 1), (None, rows[0][1].tolist(), 0)]
    small = [(5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1), (5010, [1e-200, 0.0], 1), (5011, [1e-200, 1e-203], 1), (5012, [1e200, 0.0], 1), (5013, [-0.0, 3.0], 2), (5014, [0.0, 3.0], 2)]
    df = spark.createDataFrame([(i, v.tolist(), l, "x") for i, v, l in rows] + [(*o, "x") for o in odd + small], "vec_id long, embedding array<double>, label int, rep string")
    every = embedding_dedup.dedup(df).collect()
    got = {x["vec_id"]: x for x in every}
    assert len(every) == len(got) == len(rows) + len(odd) + len(small)
    n, comps = brute_links(rows)
    assert all(got[i]["n_links"] <= k for (i, *_), k in zip(rows, n))
    assert sum(got[i]["n_links"] for i, *_ in rows) >= 0.98 * sum(n)
    assert np.mean([got[i]["component_id"] == c for (i, *_), c in zip(rows, comps)]) > 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, *_ in odd)
    for few in ([5006, 5007], [5010, 5011, 5012], [5013, 5014]):
        assert all(got[i]["n_links"] == len(few) - 1 and got[i]["component_id"] == few[0] for i in few)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embeddings_repeated_ids_and_threshold(spark):
    rows = [(1, [3.0, 4.0], 0), (1, [3.0, 4.0], 0), (1, [4.0, -3.0], 0), (2, [4.0, 3.0], 0), (3, [8.0, -6.0], 0), (4, [1.0, 0.0], 0), (1, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in embedding_dedup.dedup(df, 0.96).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4)]


def test_embeddings_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in queries.op8_embedding_dedup(spark, sf).collect()}
    n, comps = brute_links(rows)
    assert len(got) == len(rows) and np.mean([got[i] == (k, c, i == c) for (i, *_), k, c in zip(rows, n, comps)]) > 0.99


@pytest.mark.parametrize("vectors", [50, 5000, 100_000, 1_000_000])
def test_filter_recall(vectors):
    r = np.random.default_rng(5)
    x = r.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = r.standard_normal((600, 64))
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * e
    shared, size = set(), 0
    for k in range(embedding_dedup.codes_for(vectors)):
        code = embedding_dedup.ProductCode(64, vectors, k)
        a, b = (set(zip(*(v.tolist() for v in code.decode(z)))) for z in (x, y))
        shared |= {row for row, _ in a & b}
        size += len(a)
    assert len(shared) >= 0.98 * 600
    assert 0.7 < size / 600 / embedding_dedup.codes_for(vectors) / embedding_dedup.LIST < 1.4  # lists are as long as planned


def test_decode_lists_all_filters():
    r = np.random.default_rng(6)
    x = r.standard_normal((50, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = embedding_dedup.ProductCode(20, 300, 1)
    turned = x @ code.rotation
    scores = [turned[:, a:b] @ c for a, b, c in zip(code.edges, code.edges[1:], code.codes)]
    every = scores[0][:, :, None] + scores[1][:, None, :]
    row, i, j = np.nonzero(every >= code.height)
    assert set(zip(*(v.tolist() for v in code.decode(x)))) == set(zip(row.tolist(), (i * code.directions + j).tolist()))


def test_mixing_sql(spark, sf, duck):
    got = queries.op9_mixing(spark, sf).toPandas()
    want = duck.sql(mixing.SQL).df()[list(got.columns)]
    keys = ["doc_id", "copy"]
    assert got.sort_values(keys).reset_index(drop=True).equals(want.sort_values(keys).reset_index(drop=True).astype(got.dtypes.to_dict()))


def test_mixing_rates(spark):
    n = [6000, 300, 50]
    rows = spark.createDataFrame([(i, f"s{k}" if k else None, "t", 1) for i, k in enumerate([k for k, c in enumerate(n) for _ in range(c)])], "doc_id long, source string, text string, __copies int")
    rows = rows.drop("__copies")
    weights = spark.createDataFrame([(None, 1.0), ("s1", 2.0), ("s2", 5.0)], "source string, weight double")
    mixed = mixing.mix(rows, weights, budget=20_000).cache()
    by = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, weight in ((None, 1), ("s1", 2), ("s2", 5)):
        mean = 20_000 * weight / 8
        assert abs(by[source] - mean) < 5 * mean**0.5
    # the counts of a source of rate 250 follow the distribution; and rates beyond MAX_RATE are sums of pieces
    k = np.array([r["__copies"] for r in mixed.where("source = 's2' AND __copy = 1").collect()])
    assert abs(k.mean() - 250) < 12 and 100 < k.var() < 500
    big = mixing.mix(rows.where("source = 's2'"), budget=50 * 1200).count()
    assert abs(big - 60_000) < 5 * 60_000**0.5
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(rows.repartition(7), weights, budget=20_000).collect()))
    assert mixing.mix(rows.limit(0)).count() == 0


def test_mixing_cases(spark):
    rows = [(None if i < 400 else i, f"text {i}", None if i % 2 else "s", 7, 8) for i in range(2000)] + [(5000, None, "t", 7, 8)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __copy int, c0 int")
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "c0", "__copy", "__copies", "__order"]
    by = {r["source"]: r["count"] for r in mixed.where("source IS NULL OR source = 's'").groupBy("source").count().collect()}
    assert all(abs(by[k] - 2003 / 3) < 5 * 26 for k in (None, "s"))  # rows without an id do not draw alike
    drawn = mixed.where("doc_id IS NULL").select("__copies", "text").distinct().groupBy("__copies").count().count()
    assert drawn > 1 and mixing.replicated(df).columns == df.columns and mixing.replicated(df).count() == mixed.count()
    assert mixing.mix(df.where("source = 't'"), budget=30.0).select("__copies").distinct().count() <= 1
    assert mixing.replicated(df.limit(0)).count() == 0


def test_mixing_is_native(spark, sf):
    plan = queries.op9_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = {r["doc_id"]: r["score"] for r in queries.op3_quality(spark, sf).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if scored[r["doc_id"]] >= quality.CUT}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    _, comps = brute_near(rows, 5, 80)
    rows = {i: t for i, t in rows.items() if comps[i] == i}
    left = docs.where(F.col("doc_id").isin(*rows))
    want = sorted(r["doc_id"] for r in mixing.mix(left).collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest() for r in got)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty, long and repeated texts, ties, clashing columns, an empty table."""
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, "a plain text of some words", "en", "s", 26), (2, "a plain  text of some words", "en", "s", 27), (2, "a plain  text of some words", "en", "s", 27), (None, "no id here", None, None, 10), (None, "no id here", None, None, 10), (3, None, "en", "t", 0), (4, "", "en", "t", 0), (5, long, "en", "t", len(long)), (6, long + " more", "en", "t", len(long) + 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clash = spark.createDataFrame([(*r, 1, "i", "x", 2) for r in rows], schema + ", __score int, ids string, `__id` string, `__copy` int")
    for docs, n in ((spark.createDataFrame(rows, schema), 5), (clash, 5), (clash.limit(0), 0)):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:3]:
            before, at = at, stage(spark, at, str(tmp_path))
            assert at.columns == before.columns and at.schema == before.schema, name
        # one of the plain texts, one without an id, one of the empty ones (null is empty) and one of the long ones
        left = sorted(((r["doc_id"] or 0) for r in at.collect()))
        assert left == [0, 1, 3, 5][: len(left)] and len(left) == (4 if n else 0)
        mixed = corpus_pipeline.STAGES[3][1](spark, at, str(tmp_path))
        assert mixed.columns == docs.columns
        assert corpus_pipeline.STAGES[4][1](spark, at, str(tmp_path)).count() == len(left)
