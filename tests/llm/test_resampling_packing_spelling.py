"""Importance resampling, packing and spelling variants, against plain versions of their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curata.llm import chat, kernels, packing, queries, resampling, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {k: k + 32 for k in range(65, 91)}
ODD = [None, "", " \n", "A", "É×é÷ÿ Ünïcode", "x" * 3000, "Déjà vu, déjà VU; deja-vu 42 42 漢字 漢字\x1c!", "áb İI \x00b"]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], DOCS)


def prose(seed, n, words=60):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(words)]
    return [" ".join(r.choices(stock, k=r.randint(0, 60))).capitalize() + r.choice([".", "", "!\n"]) for _ in range(n)]


# --- importance resampling


def resampled(docs, target, percent=5):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t, found = collections.Counter(), collections.Counter(), [(i, *features(x)) for i, x in docs]
    for _, _, f in found:
        s.update(map(bucket, f))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    whole, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (whole + 10_000) / ((s[k] + 1) * (wanted + 10_000)))) for k in range(10_000)]
    rows = []
    for i, w, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    fit = sorted((x for x in rows if x[4] >= 20), key=lambda x: (-x[3], -1 if x[0] is None else x[0], x[2]))
    rank = {id(x): k + 1 for k, x in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*x[:4], rank.get(id(x))) for x in rows), key=repr)


def test_resampling_is_the_definition(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SHARD_STRINGS", 400)
    texts = ODD + prose(1, 150) + prose(1, 20)
    ids = [None, None, *range(2, len(texts) - 1), 5]  # null and repeated ids
    like = prose(2, 30, 40) + [None, ""]
    docs, target = table(spark, texts, ids).withColumnRenamed("lang", "weight").withColumnRenamed("source", "RANK"), table(spark, like)
    got = sorted((tuple(r) for r in resampling.resample(docs, target, percent=30).collect()), key=repr)
    assert got == resampled(list(zip(ids, texts)), like, 30)


def test_resampling_in_other_blocks_and_slices(spark, monkeypatch):
    """Blocks of a text or two, one slice or several, and words that are too many for packed numbers change nothing."""
    texts, like = ODD + prose(3, 40), prose(4, 10)
    want = resampled(list(enumerate(texts)), like, 20)
    docs, target = table(spark, texts).repartition(1), table(spark, like)
    for block, slices, bits in ((300, 1, 63), (1 << 20, 3, 12)):
        monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
        monkeypatch.setattr(resampling, "PACKED_BITS", bits)
        got = sorted((tuple(r) for r in resampling.resample(docs, target, percent=20, slices=slices).collect()), key=repr)
        assert got == want, (block, slices, bits)


def test_resampling_of_empty_tables(spark):
    none, some = table(spark, []), table(spark, prose(5, 10))
    assert resampling.resample(none, some).count() == 0
    assert resampling.resample(some, none).count() == 10


@pytest.mark.parametrize("name", ["op11_resampling", "op13_spelling"])
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    key = "doc_id" if name == "op11_resampling" else "word"
    got, want = (x[list(want.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) and got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    pt = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = pt.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


PIECES = [" ", "  ", "\n", "\n\n", " \n", "a", "b", "'s", "!", "1", "é", "漢", "\x1c", "\x85", "\xa0", "　", "🙂", " x", "'", "\t", "the", "ł", "×", "́", "<|endoftext|>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), min_size=1, max_size=4))
def test_ids_are_the_tokenizers(texts):
    path, plain = test_ids_are_the_tokenizers.given
    got = packing.Tokens.of(path).encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(autouse=True, scope="module")
def _share(tokenizer):
    test_ids_are_the_tokenizers.given = tokenizer


def test_ids_when_the_table_is_full(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_PARTS", 40)
    known = packing.Tokens(tokenizer[0])
    for seed in range(5):
        texts = prose(seed, 20)
        got = known.encode(pa.array(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer[1].encode(t, add_special_tokens=False).ids for t in texts]


def check_sequences(rows, ids, tokens, segments, bears, loss, cut=True):
    """Each id is in one piece; limits hold; offsets have no gaps; lengths are whole or powers of two."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for key, want in ids.items():
        own = sorted(pieces[key], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == want
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() if own else not want
        assert all(r["doc_tokens"] == len(want) and r["length"] > 0 for r in own)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in own)
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert total <= tokens and len(own) <= segments
        assert sum(sum(bears[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in own) <= loss
        assert not cut or total == tokens or total & (total - 1) == 0
    return sequences


def test_packing_texts(spark, tokenizer):
    path, plain = tokenizer
    texts = [t for t in ODD] + prose(7, 200) + ["word " * 5000]
    docs = table(spark, texts).withColumnRenamed("lang", "ids").withColumnRenamed("source", "START").repartition(3)
    rows = packing.pack_texts(docs, path, tokens=64, segments=5).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    check_sequences(rows, ids, 64, 5, {i: [1] * len(x) for i, x in ids.items()}, 64)
    none = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r["length"] for r in packing.pack_texts(none, path).collect()) == [1, 2, 2, 2]
    assert packing.pack_texts(table(spark, []), path).count() == 0


def test_packing_the_documents(spark, sf, tokenizer):
    rows = queries.op12_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: np.array([*tokenizer[1].encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in docs}
    assert sorted(ids) == sorted({r["doc_id"] for r in rows})
    sequences = collections.defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for own in sequences.values():
        own.sort()
        total = own[-1][0] + own[-1][1]
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and (total == 1024 or total & (total - 1) == 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 100)), max_size=60), st.integers(1, 8), st.integers(1, 32), st.booleans(), st.integers(2, 12))
def test_packer_holds_all_limits(sizes, segments, loss, cut, pool):
    r = random.Random(str(sizes))
    packer = packing.Packer(32, segments, loss, cut, pool)
    ids, bears = {}, {}
    for k, (n, share) in enumerate(sizes):
        ids[k], bears[k] = [r.randrange(1000) for _ in range(n)], [int(r.randrange(100) < share) for _ in range(n)]
        packer.add(k, np.array(ids[k], "<u4").tobytes(), bytes(bears[k]))
    packer.finish()
    names = packing.NAMES
    rows = [dict(zip(names, p)) for p in packer.out]
    check_sequences(rows, ids, 32, segments, bears, loss, cut)
    if not cut:  # examples that fit alone stay whole
        pieces = collections.Counter(x["doc_id"] for x in rows)
        assert all(pieces[k] == 1 for k in ids if 0 < len(ids[k]) <= 32 and sum(bears[k]) <= loss)


def test_packing_instructions_by_loss(spark, tokenizer, sf):
    """Conversations whose assistant turns bear loss: whole examples, under three limits at once."""
    formatted = chat.format_conversations(chat.text_messages(spark.read.parquet(f"{sf}/conversations.parquet"))).collect()
    rows, ids, bears = [], {}, {}
    for f in formatted:
        got = tokenizer[1].encode(f["formatted"], add_special_tokens=False)
        ids[f["conv_id"]] = got.ids
        bears[f["conv_id"]] = [int(any(s["start"] <= a < s["end"] for s in f["loss_spans"])) for a, _ in got.offsets]
        rows.append((f["conv_id"], np.array(got.ids, "<u4").tobytes(), bytes(bears[f["conv_id"]])))
    examples = spark.createDataFrame(rows, "doc_id long, ids binary, loss binary").repartition(1)
    out = packing.pack(examples, tokens=4096, segments=8, loss=2000, cut=False).collect()
    sequences = check_sequences(out, ids, 4096, 8, bears, 2000, cut=False)
    assert len(sequences) < len(ids)


# --- spelling variants


def spelt(docs, length=6, least=5, ratio=5):
    counted = collections.Counter()
    for i, x in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counted[w] += 1
    words = {w: n for w, n in counted.items() if len(w) >= length and n >= least}
    return forms(words, ratio)


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(words, ratio=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance_one(v, w)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def misspelt(seed, n=400):
    r = random.Random(seed)
    stock = ["".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(30)]
    out = []
    for _ in range(n):
        words = [stock[min(29, int(r.expovariate(0.15)))] for _ in range(30)]
        for k in range(0, 30, 6):
            at = r.randrange(len(words[k]))
            words[k] = words[k][:at] + r.choice(["", "a", "bé", "É", "B"]) + words[k][at + r.randint(0, 1) :]
        out.append(" ".join(words))
    return out


def test_spelling_is_the_definition(spark, monkeypatch):
    texts = ODD + misspelt(1) + ["zzzzzzzz " * 205, "zzzzzzzy " * 36, "zzzzzzyy " * 6]
    ids = [None, None, *range(len(texts) - 3), 4]
    docs = table(spark, texts, ids).withColumnRenamed("lang", "word").withColumnRenamed("source", "N")
    want = spelt(list(zip(ids, texts)))
    assert sorted(map(tuple, spelling.variants(docs).collect())) == want
    assert sum(x[1] is not None for x in want) > 50 and any(x[1] != x[2] and x[1] for x in want)
    monkeypatch.setattr(spelling, "BLOCK_BYTES", 500)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 100)
    assert sorted(map(tuple, spelling.variants(docs, group=4).collect())) == want  # halves of large groups are split


def test_spelling_of_an_empty_table(spark):
    assert spelling.variants(table(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=0, max_size=7), max_size=40), st.text("abé", max_size=7), st.integers(0, 7))
def test_automaton(words, asked, at):
    ordered = sorted(words)
    automaton = spelling.Automaton(ordered)
    for k, w in enumerate(ordered):
        state, number = automaton.walk(w, automaton.start, 0)
        assert number == k and spelling.Automaton.END in state
    found = automaton.one_error(asked[:at], asked[at:])
    assert {ordered[k] for k in found} == {w for w in words if w.startswith(asked[:at]) and distance_one(w, asked)}


def test_automaton_is_minimal():
    automaton = spelling.Automaton(sorted(a + b for a in ("ab", "cd", "ef") for b in ("ing", "ings", "ed")))
    seen, todo = set(), [automaton.start]
    while todo:
        state = todo.pop()
        if id(state) not in seen:
            seen.add(id(state))
            todo += [after for after, _ in state.values() if after]
    assert len(seen) == 1 + 3 + 1 + 2 + 1 + 1 + 1  # start; a, c, e; one shared state for all endings: i, e; n, g, end


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20), st.binary(max_size=80))
def test_joined_checksums(a, b):
    got = spelling.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got.tolist() == [zlib.crc32(a + b)]


def test_values():
    for column in (pa.array(["a", None, "é", ""]), pa.array([b"x", b"", None]), pa.array(["p", "q", "r"])[1:]):
        assert kernels.values(column) == [(x.encode() if isinstance(x, str) else x) or b"" for x in column.fill_null("" if pa.types.is_string(column.type) else b"").to_pylist()]


def test_slices_hold_each_feature_once():
    """Words' hashes follow their bytes alone; the slices' distinct features, with their counts, are those of the texts."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé") for _ in range(r.choice([1, 2, 2, 70])))
    texts = [" ".join(word() for _ in range(r.randrange(40))) for _ in range(30)] + ["", None]
    block = resampling._to_block(pa.array(range(len(texts))), pa.array(texts))
    own = resampling._features(block, 5, 3)
    words = own.words.to_pylist()
    alone = [resampling._word_hashes(pa.array([w], pa.large_string()))[0] for w in words]
    assert own.hash.tolist() == alone and len(set(alone)) == len(words)
    assert len(resampling._word_hashes(pa.array([], pa.large_string()))) == 0
    found = collections.Counter()
    for k in range(3):
        for order, (at, packed, codes, n, shard) in enumerate(own.slice(k), 1):
            assert len(codes) == order and len(packed) == n.sum() and len(n) == len(shard) and (shard < 5).all()
            for i, m in enumerate(n.tolist()):
                gram = " ".join(words[c[i]] for c in codes)
                assert gram not in found
                found[gram] = m
    want = collections.Counter()
    for t in texts:
        ws = (t or "").split()
        want.update(" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    assert found == want and np.all(own.hash[1:] != own.hash[:-1])
