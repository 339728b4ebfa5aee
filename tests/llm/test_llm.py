"""The training-data operators against SQL, brute force, exact round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from partlens.llm import embeddings, extract, mixing, piece_codec, pseudo_likelihood, quality, similar, simhash, suffixes, token_counts, urls
from partlens.llm.common import components, forest, keep_rows, row_key

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Nulls in any column, empty, blank and very long texts, ties, repeated rows, and a column that clashes with inner names.
ROWS = [
    (1, "one two three four five " * 60, "en", "a", 1, "k1"),
    (1, "one two three four five " * 60, "en", "a", 1, "k1"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, "k"),
    (4, " \n\t ", "de", None, 4, "k"),
    (None, "no id at all here", "en", "b", 3, None),
    (None, None, None, None, None, None),
    (6, "ünïcödé — " * 300 + "end", "de", "b", 9, "k"),
    (7, " ".join(f"w{i % 977}x{i}" for i in range(20_000)), "en", "b", 9, "k"),
    (1, "the same id with another text", "en", "a", 2, "k"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def cut(texts, length=200):
    """(bytes, removed, spans, digest) of each text: a plain count of all strings of the length."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("name", ["op1_mixing", "op2_quality", "op7_urls"])
def test_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), SF, name) is None


def test_gray_index_finds_all_pairs(spark):
    rng = random.Random(1)
    codes = set()
    for _ in range(200):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            code = base
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                code ^= 1 << bit
            codes.add(code)
    index = simhash.GrayIndex(np.array(sorted(codes), np.uint64))
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 3
    want = forest(len(codes), *np.nonzero(np.triu(near, 1)))
    assert (index.forest(3) == want).all()
    table = spark.createDataFrame([(int(c),) for c in index.codes.view(np.int64)], "code long")
    for group_rows in (20_000, 3):
        root = {r.node: r.root for r in components(simhash.links(table, 3, group_rows)).collect()}
        mine = [root.get(int(c), int(c)) for c in index.codes.view(np.int64)]
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_simhash_brute_force(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    codes = np.array([fingerprint(r.text) for r in rows], np.uint64)
    want = forest(len(rows), *np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3, 1)))
    found = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    for i, r in enumerate(rows):
        assert found[r.doc_id].fingerprint == f"{int(codes[i]):016x}" and found[r.doc_id].component == rows[want[i]].doc_id


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


@pytest.mark.parametrize("alphabet", [b"ab", b"abcd \x00\xff", b"a"])
def test_suffix_array(alphabet):
    rng = random.Random(3)
    for n in (1, 2, 7, 400):
        text = bytes(rng.choice(alphabet) for _ in range(n))
        order = suffixes.suffix_array(np.frombuffer(text, np.uint8), 20).tolist()
        assert sorted(order) == list(range(n))
        parts = [text[i : i + 20] for i in order]
        assert all(a <= b for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("most", [suffixes.MOST_STRETCHES, 2])
def test_repeats_brute_force(spark, docs, most):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    passage = "ä passage that many texts share, written out until it is over two hundred bytes long; " * 4
    texts = [r.text for r in rows] + [f"{random.Random(i).getrandbits(900):x} {passage} {i}" for i in range(12)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in suffixes.without_repeats(table, most=most).collect()}
    for i, want in enumerate(cut(texts)):
        assert tuple(found[i][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        base = rng.normal(size=16) if i % 4 else rows[-1][1] if rows else rng.normal(size=16)
        noise = rng.normal(size=16) * (0.12 if i % 4 == 0 else 0)
        rows.append((i, [float(x) for x in np.asarray(base) + noise], int(i % 3 == 0)))
    hot = rng.normal(size=16)
    rows += [(600 + i, [float(x) for x in hot + rng.normal(size=16) * 0.02], 1) for i in range(150)]
    rows += [(900, rows[5][1], rows[5][2]), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[5][1], None), (905, [1.0, None] * 8, 0), (906, [1.0], 0)]
    sound = [r for r in rows if r[0] < 901]
    unit = np.array([r[1] for r in sound])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in sound])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = forest(len(sound), *np.nonzero(near))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for sizes in ({}, {"shard_rows": 60, "block_rows": 7}):
        found = {r.id: r for r in embeddings.near_duplicates(table, **sizes).collect()}
        assert len(found) == len(rows)
        for i, r in enumerate(sound):
            assert (found[r[0]].n_links, found[r[0]].component) == (near[i].sum(), sound[want[i]][0])
        for alone in range(901, 907):
            assert (found[alone].n_links, found[alone].component, found[alone].kept) == (0, alone, True)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def odd_texts(n):
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "▁", "the", "tion", "中", "文", "😀", "\x00", "<s>", "<0x0A>", "▁▁", "in", ". ", "\r\n", "𝒳", "‍", "<unk>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_counts_are_the_library_s(docs):
    library, count = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.counter(MODEL)
    for text in odd_texts(400):
        assert count.total(text) == len(library.encode(text))
        assert count.prefixes(text).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
    own = {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}
    found = token_counts.count_tokens(docs, MODEL, budget=50, store=True).select("*", token_counts.cut_at(50).alias("cut"), token_counts.tokens_upto(F.col("fits")).alias("upto"))
    for r in found.collect():
        assert r.n_tokens == own[r.id] and r.cut == r.fits and r.upto <= 50


def test_codec_is_the_library_s(docs):
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.codec(MODEL)
    for text in odd_texts(400):
        words = codec.cut(text)
        codec.learn(set(words))
        tokens = [t for w in words for t in codec.words[w]]
        assert tokens == library.encode(text)
        assert codec.whole.encode(text, add_special_tokens=False).ids == tokens
    assert not codec.differ
    made = piece_codec.encode(docs, MODEL)
    assert made.where("not parity or not round_trip").count() == 0
    back = piece_codec.decode(made, MODEL).withColumnRenamed("text", "back").join(docs.select("doc_id", "text"), F.col("id") == F.col("doc_id"))
    assert back.count() == docs.count() and back.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0


def test_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = extract.train([r.html for r in pages.collect()])
    rng, wrong, total = np.random.default_rng(77), 0, 0
    for _ in range(200):
        page, labels = extract.layout(rng, ["some", "words", "of", "other", "pages"])
        told = model.label([extract.vectors(extract.blocks(page))])[0]
        wrong, total = wrong + int((told != np.array(labels)).sum()), total + len(labels)
    assert wrong < 0.05 * total
    for r in extract.extract(pages, model=model).join(pages.select("page_id", "html"), F.col("id") == F.col("page_id")).collect():
        found = extract.blocks(r.html)
        assert r.text == " ".join(t for (_, t, _), m in zip(found, extract.named_by_markup(found), strict=True) if m) and r.n_chars == len(r.text)


def test_blocks():
    page = "<title>no</title><p>A &amp; b&nbsp; c<b>d</b><br>e<p>next <script>var a='</p>';</script><!-- <p>x --><li class=\"x y\">i<li>j<a href='>'>k</a>"
    assert [(p, t) for p, t, _ in extract.blocks(page)] == [(("p",), "A & b cd e"), (("p",), "next"), (("li", "x", "y"), "i"), (("li",), "jk")]
    assert extract.blocks(None) == extract.blocks("") == extract.blocks("<p> <i></i>") == []


@pytest.mark.parametrize(
    "silent",
    ['<svg class="i"/>', "<math />", "<object data=x>", "<object><object></object>", "<video-player>", "<video-player></video-player>", "<title-bar></title-bar>", "<iframe src=x>", "<noscript>a</noscript>",
     "<svg><svg/><g><svg><text>a</text></svg></g>b</svg>", "<template><p>a</p></div></template>", "<SCRIPT>a</SCRIPT >", "</svg>", "<canvas><!-- </canvas> -->a</canvas>", "<video/>a</video>"],
)
def test_silent_elements(silent):
    """A silent element hides what it holds and nothing behind it, and does not cut the block it stands in."""
    page = f"<article><p>one</p>{silent}<p>two</p><p>three</p></article>"
    assert [t for _, t, _ in extract.blocks(page)] == ["one", "two", "three"]
    inside = extract.blocks(f"<p>one {silent} two</p><p>three</p>")
    assert [t for _, t, _ in inside] == ["one two", "three"] or "-" in silent


def test_pseudo_likelihood(docs):
    words = pseudo_likelihood.Words.of(pseudo_likelihood.count_words(docs))
    net = pseudo_likelihood.train(docs, words)
    row, places, _ = pseudo_likelihood.encoded([r.text for r in docs.limit(100).collect()], words)
    around, kind = row[places[:, None] + pseudo_likelihood._AROUND], words.kind[row[places]]
    fresh = pseudo_likelihood.Network(words.other + 1)
    assert net.log_probability(around, kind).mean() > fresh.log_probability(around, kind).mean() + 0.5
    total = np.exp([fresh.log_probability(around[:1], np.array([k])) for k in range(pseudo_likelihood.CLASSES)]).sum()
    assert total == pytest.approx(1, abs=1e-4)
    mass = np.bincount(words.kind[:-1], np.exp(words.within[:-1]), pseudo_likelihood.CLASSES)
    assert np.allclose(mass[mass > 0], 1)


def test_rare_words_have_their_own_probability(spark):
    """Words beyond the commonest are told apart by their counts."""
    common = " ".join(f"w{i}" for i in range(pseudo_likelihood.VOCABULARY))
    texts = [common] * 12 + ["often"] * 10 + ["seldom"] * 2
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.log_likelihood for r in pseudo_likelihood.score(table).collect()}
    assert len(found) == len(texts) and found[12] - found[23] == pytest.approx(np.log(5), abs=1e-5)


def test_every_position_is_learned_from(spark, docs):
    """Over all rounds each word is learned from once."""
    counted = pseudo_likelihood.count_words(docs).persist()
    words = pseudo_likelihood.Words.of(counted)
    rows, shared = docs.select(F.col("doc_id").alias("id"), "text"), spark.sparkContext.broadcast(words)
    flat = pseudo_likelihood.Network(words.other + 1).flat
    turns = [pseudo_likelihood._round(rows, shared, flat, t, pseudo_likelihood.ROUNDS).where("i = -1").first().v for t in range(pseudo_likelihood.ROUNDS)]
    assert sum(turns) == counted.agg(F.sum("n")).first()[0]


def test_targets_by_resharing(spark):
    sums = {"a": 10, "b": 500, "c": 3, "d": 0, None: 7}
    rows = spark.createDataFrame([(k if k is None else k, v) for k, v in sums.items()], "source string, size long")
    keyed = rows.select(F.when(F.col("source").isNull(), "b").otherwise(F.concat(F.lit("a"), "source")).alias("source_key"), "size")
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    target, full, left = dict.fromkeys(sums, 0.0), set(), float(sum(sums.values()))
    while left > 1e-9:
        open_ = [k for k in sums if k not in full]
        share = {k: target[k] + left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        left = 0.0
        for k in open_:
            target[k] = min(share[k], 3 * sums[k])
            left += share[k] - target[k]
            if share[k] >= 3 * sums[k]:
                full.add(k)
    found = {r.source_key: r.target for r in mixing.targets(keyed).collect()}
    for k, v in target.items():
        assert found["b" if k is None else "a" + k] == pytest.approx(v)


def test_urls():
    trie = urls.UrlTrie((*urls.RULES, ("block", "org"), ("allow", "org/a")))
    cases = {
        "http://WWW.Example.com/en/x?q": ("www.example.com/en/", "allow"), "http://example.com/en": ("com/", "allow"), "http://a.example.com/en/": ("example.com/en/", "block"),
        "http://x.net/es/1": ("net/es/", "block"), "http://x.net/esx": None, "http://com": None, "http://com/": ("com/", "allow"), "no url": None, None: None,
        "http://x.org": ("org", "block"), "http://x.org/abc": ("org/a", "allow"), "http://xcom/": None,
    }
    for url, want in cases.items():
        assert trie.match(*urls.split_url(url)) == want, url
    with pytest.raises(ValueError):
        urls.UrlTrie((("allow", "a/"), ("block", "a/")))


def test_edge_rows(spark, edge):
    """Every row of an odd table has its defined result, and an empty table gives none."""
    n = len(ROWS)
    empty = edge.limit(0)
    mixed = mixing.mix(edge).collect()
    assert len(mixed) == n and all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in mixed)
    judged = quality.judge(edge).collect()
    assert len(judged) == n and all(r.kept is False for r in judged if r.n_words < 20)
    assert sum(r.n_words == 0 for r in judged) == 4
    near = simhash.near_duplicates(edge).collect()
    assert len(near) == n and {r.fingerprint for r in near if r.id in (2, 3, 4)} == {"0" * 16} and {r.component for r in near if r.id in (2, 3, 4)} == {2}
    kept = {(r.doc_id, r.n_chars): r for r in suffixes.without_repeats(edge).collect()}
    assert kept[1, 1].n_removed == kept[1, 1].n_bytes == len(ROWS[0][1]) and kept[1, 1].kept_text == "" and kept[2, None].kept_text is None
    assert kept[6, 9].kept_text is not None and kept[7, 9].n_removed == 0
    tokens = piece_codec.encode(edge, MODEL).collect()
    assert len(tokens) == n and all((r.tokens is None) == (r.n_tokens is None) == (r.parity is None) for r in tokens)
    assert token_counts.count_tokens(edge, MODEL).where("n_tokens = 0").count() == 3
    scored = pseudo_likelihood.score(edge).collect()
    assert len(scored) == n and all((r.per_word is None) == (r.n_words == 0) for r in scored)
    pages = edge.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("source").alias("url"))
    assert urls.judge_urls(pages).where("host = '' and rule is null and verdict = 'allow'").count() == n
    assert extract.extract(pages, model=extract.train([], layouts=20)).where("text is not null and n_chars = length(text)").count() == n
    for made in (mixing.mix(empty), quality.judge(empty), simhash.near_duplicates(empty), suffixes.without_repeats(empty), piece_codec.encode(empty, MODEL), pseudo_likelihood.score(empty)):
        assert made.count() == 0


def test_keep_rows(edge):
    named = edge.select(F.col("doc_id").alias("id"), row_key("text", "source").alias("key"), F.lit(1).alias("times"))
    assert sorted(map(str, keep_rows(edge, named, ("text", "source")).collect())) == sorted(map(str, edge.collect()))


def word_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_similar_groups_brute_force(spark):
    """Groups of the stage are those of all pairs with a Jaccard of 0.8 or more over five-word shingles."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = table.orderBy("doc_id").collect()
    sets = word_sets([r.text for r in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    root = forest(len(rows), *np.array(pairs).T)
    found = {r.id: r.root for r in similar.similar_groups(table).collect()}
    assert len(found) == len(rows) and found[56] == found[467]
    assert len(set(found.values())) == len(set(root.tolist())) == len({(found[r.doc_id], x) for r, x in zip(rows, root.tolist(), strict=True)})


def test_similar_groups_at_the_edge(spark):
    """Pairs just over a Jaccard of 0.8 are found nearly always, those just under it never."""
    rng, rows, over = random.Random(5), [], set()
    for n in range(300):
        words = [f"{rng.getrandbits(40):x}" for _ in range(400)]
        other = words[: 354 if n % 2 else 359] + [f"{rng.getrandbits(40):x}" for _ in range(46 if n % 2 else 41)]
        a, b = word_sets([" ".join(words), " ".join(other)])
        if 5 * len(a & b) >= 4 * len(a | b):
            over.add(n)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    found = {r.id: r.root for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = {n for n in range(300) if found[2 * n] == found[2 * n + 1]}
    assert len(over) == 150 and met <= over and len(met) >= 145 and len(set(found.values())) == 600 - len(met)


def test_groups_with_null_and_repeated_ids(spark):
    """Unlike texts without an id, or with the same one, are groups of their own."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("first", "second", "third")]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[0] + " x"), (1, "other words " + texts[1][::-1]), (2, texts[2])]
    table = spark.createDataFrame([(i, t, "en", f"s{n}", len(t), "k") for n, (i, t) in enumerate(rows)], SCHEMA)
    left = [r.text for r in corpus_pipeline.one_of_each_group(spark, table, SF).collect()]
    assert {texts[1], texts[2], rows[5][1]} <= set(left) and len(left) == len(set(left)) and any(texts[0] in t for t in left)


def test_stages_on_edge_rows(spark, edge):
    """Every stage takes null and repeated ids; a stage loses no text that is unlike all others."""
    assert {r.text for r in corpus_pipeline.one_of_each_group(spark, edge, SF).collect()} >= {ROWS[i][1] for i in (0, 5, 7, 8, 9)}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, edge, SF)
        assert name == corpus_pipeline.STAGES[-1][0] or made.columns == edge.columns
        made.collect()


@pytest.mark.parametrize("names", [("__id", "__times"), ("n_bytes", "kept_text"), ("n_Bytes", "a.b"), ("__key", "__text"), ("id", "node")])
def test_stages_hand_on_columns_of_any_name(spark, docs, names):
    """A column that clashes with inner names comes back unchanged from every stage but the last."""
    table = docs.limit(60).withColumn(names[0], F.concat(F.lit("own "), F.col("doc_id"))).withColumn(names[1], -F.col("doc_id"))
    own = {r.doc_id: (f"own {r.doc_id}", -r.doc_id) for r in table.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, table, SF)
        assert made.columns == table.columns
        rows = made.collect()
        assert rows and all((r[len(r) - 2], r[len(r) - 1]) == own[r[0]] for r in rows)
    assert corpus_pipeline.token_rows(spark, table, SF).count() == 60


def test_pipeline_stages(spark, docs):
    """Each stage against a plain version on its own input."""
    judged = {r.doc_id: r.kept for r in entry.queries()["op2_quality"](spark, SF).collect()}
    good = corpus_pipeline.good_documents(spark, docs, SF).persist()
    assert sorted(r.doc_id for r in good.collect()) == sorted(k for k, v in judged.items() if v) and good.columns == docs.columns
    rows = good.orderBy("doc_id").collect()
    sets = word_sets([r.text for r in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    root = forest(len(rows), *np.array(pairs, np.int64).reshape(-1, 2).T)
    single = corpus_pipeline.one_of_each_group(spark, good, SF).persist()
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[i].doc_id for i in root})
    rows = single.orderBy("doc_id").collect()
    clean = corpus_pipeline.without_long_repeats(spark, single, SF).persist()
    lost = {r.doc_id: w[1] for r, w in zip(rows, cut([r.text for r in rows]), strict=True)}
    for r in clean.join(single.select("doc_id", F.col("text").alias("before")), "doc_id").collect():
        assert r.n_chars == len(r.text) and (r.text == r.before if not lost[r.doc_id] else len(r.text.encode()) <= len(r.before.encode()) - lost[r.doc_id])
    mixed = corpus_pipeline.mixed_sources(spark, clean, SF).persist()
    copies = {r.id: r.copies for r in mixing.mix(clean, key=corpus_pipeline.KEY).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    last = corpus_pipeline.token_rows(spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(last) == mixed.count() and all(list(r.tokens) == library.encode(texts[r.doc_id]) for r in last)
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_stars_are_components_without_a_round(spark, monkeypatch):
    from partlens.llm import common

    cuts = []
    cut = common.cut_lineage
    monkeypatch.setattr(common, "cut_lineage", lambda df: cuts.append(df.rdd.getNumPartitions()) or cut(df))
    stars = [(k, 10 * (k // 10)) for k in range(200)]
    table = spark.createDataFrame(stars, "a long, b long").repartition(5)
    assert {r.node: r.root for r in common.components(table).collect()} == dict(stars)
    assert cuts == [5]
    # A chain dealt over tasks takes rounds, and no round makes more partitions than a shuffle does.
    cuts.clear()
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long").repartition(5)
    assert {r.root for r in common.components(chain).collect()} == {0}
    assert len(cuts) > 1 and max(cuts) <= 8
