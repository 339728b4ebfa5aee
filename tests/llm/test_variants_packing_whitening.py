"""Spelling variants, packing and whitening against brute force, the library and dense algebra, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from partlens.llm import packing, variants, whitening

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def one_apart(a, b):
    """One added, taken out or replaced code point, by trying each place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    """The rows of the contract from (id, text), by comparing words that agree but for one place."""
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for alike in holes.values():
        for w in alike:
            near[w] |= alike - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words.get(form.get(w), 0)) for w, n in words.items())


def told(made):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in made.collect())


def test_variants_query(spark):
    sf = "/root/testdata/sf0.01"
    made = entry.queries()["op11_variants"](spark, sf)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert told(made) == plain_variants(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("share", [variants.SHARE_WORDS, 40])
def test_variants_of_made_words(spark, share):
    """Many words of the same letters, chains of forms, accents, words beyond the compared width; shares of any size agree."""
    rng, words = random.Random(3), Counter()
    for _ in range(120):
        words["".join(rng.sample("abcdefg", 7))] += rng.choice([1, 2, 40])
        base = "".join(rng.choice("aeikÀÿ×ûz") for _ in range(rng.choice([7, 9, 70, 64, 65])))
        words[base] += 300
        for _ in range(4):
            i = rng.randrange(len(base))
            base = rng.choice([base[:i] + base[i + 1 :], base[:i] + "x" + base[i + 1 :], base[:i] + "é" + base[i:]])
            words[base] += rng.choice([2, 3, 25])
    text = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(text)
    rows = [(i if i % 5 else None, " ".join(text[i::50])) for i in range(50)] + [(7, None), (8, ""), (9, "a 1 "), (None, "UPPERCASE Uppercase uppercase")] * 2
    table = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert told(variants.variants(table, share_words=share)) == plain_variants(rows)
    assert variants.variants(table.limit(0), share_words=share).count() == 0


def test_one_edit():
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 6))).encode() for _ in range(60)}
    for a in words:
        for b in words:
            if a != b and abs(len(a) - len(b)) <= 1:
                assert variants.one_edit(a, b) == one_apart(a.decode(), b.decode()), (a, b)


def test_tree_reaches_all_boxes():
    """Every word one edit away lies in a leaf that the search reports."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(7, 9))).encode() for _ in range(400)]
    vectors = variants.letter_counts(words)
    tree = variants.Tree.over(vectors, 3)
    leaf = tree.home(vectors)
    assert sorted(tree.order.tolist()) == list(range(400))
    assert all(i in tree.order[tree.first[n] : tree.last[n]] for i, n in enumerate(leaf))
    for longer in (False, True):
        reached = set(zip(*(x.tolist() for x in tree.reach(vectors, longer)), strict=True))
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if a != b and len(b) == len(a) + longer and one_apart(a.decode(), b.decode()):
                    assert (i, leaf[j]) in reached


def odd_texts(n):
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "the", "tion", "中", "😀", "\x00", "<|endoftext|>", "in", ". ", "\r\n", "\x1c", "\x85", "\xa0", "'s", "'", "'ll", "don't", "²", "½", "12", "ª", " ", "　", "—", "€", "_", "​", "ʼ", "ǅ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_are_the_library_s(docs, monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    for size in (packing.CHARS_AT_ONCE, 5):
        monkeypatch.setattr(packing, "CHARS_AT_ONCE", size)
        own = packing.ByteCodec(VOCABULARY)
        for text in odd_texts(1500) + [r.text or "" for r in docs.limit(40).collect()]:
            assert np.frombuffer(b"".join(own.ids(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def hold(made, texts, capacity):
    """Each id once, pieces gapless in their documents and sequences; the share of padding."""
    library = Tokenizer.from_file(VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in made:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for id_, rows in by_doc.items():
        ids, at = library.encode(texts[id_] or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(rows, key=lambda r: r.start):
            piece = ids[at : at + r.length]
            assert r.start == at and r.length == len(piece) > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding, total = padding + capacity - at, total + at
    return padding / total


def test_packing_query(spark):
    sf = "/root/testdata/sf0.01"
    made = entry.queries()["op12_packing"](spark, sf)
    assert made.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert hold(made.collect(), texts, 2048) < 0.005


def test_packing_in_shares(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    made = packing.pack(docs.withColumn("start", F.lit("k")).withColumn("turn", F.lit(1)), VOCABULARY, capacity=256, share_pieces=50, with_ids=True).collect()
    assert hold(made, texts, 256) < 0.03
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in made)


def test_packing_of_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, None), (3, "x " * 30_000), (4, " word" * 2047), (5, " word" * 2048)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    made = packing.pack(table, VOCABULARY).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in made if r.start == 0) == Counter({(1, 1): 1, (2, 1): 2, (None, 3): 1, (None, 1): 1, (3, 30_002): 1, (4, 2048): 1, (5, 2049): 1})
    assert all(0 < r.length <= 2048 and r.offset + r.length <= 2048 for r in made)
    assert packing.pack(table.limit(0), VOCABULARY).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(7)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    windows, offsets = packing.best_fit(lengths, 100)
    rooms = []
    for length, window, offset in zip(lengths, windows, offsets, strict=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            assert rooms[window] == min(fits)
        else:
            assert window == len(rooms)
            rooms.append(100)
        assert offset == 100 - rooms[window]
        rooms[window] -= length


@pytest.mark.parametrize("kind", ["plain", "repeated", "flat", "sparse", "one"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(80, 1 if kind == "one" else 12)) * 10
    if kind == "repeated":
        rows = np.repeat(rows[:3], 20, axis=0)
    if kind == "flat":
        rows[:, ::2] = 0
    if kind == "sparse":
        rows = np.round(rows / 5) * (rng.random(rows.shape) < 0.2)
    made, other = whitening.Spectrum(rows.shape[1]), whitening.Spectrum(rows.shape[1])
    made.add(rows[:5])
    other.add(rows[5:])
    made.join(whitening.Spectrum.unpacked(other.packed()))
    want = rows.T @ rows
    assert np.allclose(made.vectors.T @ made.vectors, np.eye(rows.shape[1]), atol=1e-13)
    assert np.abs((made.vectors * made.values) @ made.vectors.T - want).max() <= 1e-12 * np.abs(want).max()
    assert (np.diff(made.values) >= 0).all()


def against_dense(made, vectors, components=32):
    """Rows held against a dense eigenproblem over all vectors (id, row)."""
    ids, rows = zip(*vectors, strict=True)
    x = np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes, k = values[::-1], axes[:, ::-1], min(components, x.shape[1])
    white = centred @ axes[:, :k] / np.sqrt(values[:k])
    found = {(r.vec_id, r.component): r for r in made}
    assert len(found) == len(made) == n * k
    got = np.array([[found[i, c + 1].whitened for c in range(k)] for i in ids])
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-8)
    for i, row in zip(ids, x, strict=True):
        assert found[i, 1].deviation == int(((n * row - sums) ** 2).sum()) and found[i, 1].n == n
    assert np.allclose([found[ids[0], c + 1].explained for c in range(k)], values[:k] / values.sum(), rtol=1e-9)
    errors = {r.identity_error for r in made}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_query(spark):
    made = entry.queries()["op13_whitening"](spark, SF)
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    against_dense(made.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(v) for v in rng.normal(size=5) * [1, 2, 3, 4, 5]]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "k", 2) for i, v in good + bad], "vec_id long, embedding array<double>, id string, n int").repartition(40)
    renamed = whitening.whiten(table).withColumnRenamed("id", "vec_id").collect()
    against_dense(renamed, good)
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.where("vec_id >= 100 and vec_id < 105")).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(flat) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in flat)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.component, None if r.whitened is None else round(abs(r.whitened), 9)) for r in line} == {(1, 1.0), (2, None)}
