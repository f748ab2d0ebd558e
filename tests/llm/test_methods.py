"""That operators work by the method named, and where plain versions were missing."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from quire.llm import decontamination, license_scan, ngram_join, packing, quality_classifier, secret_scan, stars

SF1 = "/root/testdata/sf0.001"


def words(seed, n, most=100_000):
    r = random.Random(seed)
    return [f"w{r.randrange(most)}" for _ in range(n)]


def test_trigram_queries_follow_from_the_regex():
    """Whatever a rule's regex matches holds the query derived from it."""
    samples = {
        "assign": ["password=abcdefghijkl", "API_KEY: 'abcdefghijkl1", "apikey=\"aaaaaaaaaaaaaaa", "Secret = abcdefghijklm", "TOKEN:abcdefghijkl", "passwd'='abcdefghijkl"],
        "access": ["AKIA" + "B" * 16], "github": ["gho_" + "a" * 36, "ghs_" + "Z" * 40], "slack": ["xoxb-" + "1" * 12], "google": ["AIza" + "-" * 35],
        "pem": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----"], "jwt": [".".join(("eyJ" + "a" * 8, "eyJ" + "b" * 8, "c" * 8))],
    }
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule)
        assert bool(query) == (rule.kind != "hex")
        for text in samples.get(rule.kind, ()):
            assert re.search(rule.pattern, text)
            assert all(any(all(g in text.lower() for g in clause) for clause in part) for part in query), (rule.kind, text)


@pytest.mark.parametrize(
    ("pattern", "query"),
    [
        ("a(bcd|efg)+h", ((("bcd",), ("efg",)),)), ("(foo|bar)?baz", ((("baz",),),)), ("x{3}", ((("xxx",),),)), ("abc|d", ()), ("[^a]bc", ()),
        ("(?i:ABC)[xy]z", ((("abc", "bcx", "cxz"), ("abc", "bcy", "cyz")),)), ("abc.*def", ((("abc",),), (("def",),))),
    ],
)
def test_trigram_query(pattern, query):
    assert secret_scan.trigram_query(secret_scan.Rule("x", pattern)) == query


def test_added_kinds_and_very_many_matches(spark):
    made = {
        "github": "ghp_" + "aB3" * 12, "slack": "xoxb-" + "1234567890", "google": "AIza" + "x_-4" * 8 + "abc",
        "pem": "-----BEGIN RSA PRIVATE KEY-----", "jwt": ".".join(("eyJ" + "h" * 9, "eyJ" + "p" * 9, "s" * 9)),
    }
    texts = [(i, f"é {v} and {v}.") for i, v in enumerate(made.values())]
    many = " ".join(f"{i:016x}" for i in range(20_000))
    docs = spark.createDataFrame([*texts, (99, many)], "doc_id bigint, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in secret_scan.query(docs).collect()}
    assert time.time() - began < 60
    for (i, text), (kind, v) in zip(texts, made.items(), strict=True):
        own = [x for x in got[i]["spans"].split(",") if x.startswith(kind)]
        assert own == [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(re.escape(v), text)], kind
    assert got[99]["n_hex"] == 20_000 and got[99]["spans"].endswith(f"hex:{17 * 19_999}:{17 * 19_999 + 16}")


def test_part_enum_gives_every_similar_pair_a_common_signature():
    """Pairs at Jaccard 0.8, just so, of many sizes, also where the smaller joins the next band."""
    rng = np.random.default_rng(3)
    for n in (4, 5, 8, 9, 12, 18, 27, 40, 62, 93, 140, 210, 315, 473, 710, 1500):
        for _ in range(40 if n < 500 else 5):
            base = rng.integers(0, 1 << 63, n + n // 4 + 1).astype(np.uint64)
            both = base[:n]
            extra = n // 4  # |A & B| = n, |A | B| = n + extra <= 5 n / 4
            cut = int(rng.integers(0, extra + 1))
            a, b = np.unique(np.concatenate([both, base[n : n + cut]])), np.unique(np.concatenate([both, base[n + cut : n + extra]]))
            if len(a) == len(b) and (a == b).all():
                continue  # equal sets are one from the start
            keys, owner = ngram_join.part_enum([a, b])
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (n, cut)


def test_part_enum_signs_no_empty_subset():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in rng.integers(5, 600, 400)]
    keys, owner = ngram_join.part_enum(sets)
    _, counts = np.unique(keys, return_counts=True)
    assert counts.max() == 1, "unrelated sets share a signature"
    assert len(keys) < 2 * sum(map(len, sets))


@pytest.mark.parametrize("hot", [4, 64])
def test_join_of_near_copies_in_one_star(spark, monkeypatch, hot):
    """A hot group: copies of one text with some words changed, on both sides of the threshold."""
    monkeypatch.setattr(stars, "HOT", hot)
    base = words(1, 200)
    r = random.Random(2)
    texts = []
    for i in range(300):
        own = list(base)
        for at in r.sample(range(200), r.randrange(0, 9)):
            own[at] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in texts}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.query(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)).collect()}
    assert got == {i: root(i) for i in sets}
    assert 1 < len(set(got.values())) < 300


def test_encoder_on_random_unicode():
    from tokenizers import Tokenizer

    r, plain = random.Random(5), Tokenizer.from_file(packing.tokenizer_path())
    signs = "aAbBzZ İIıŞşÇéÈñßſKÅ.,;:!?'’\"-_()<>|012̧́̇̀ 　漢カ가ﬁ²½ΣσςД\t\n\r\x0b\x0c\u0085​😀"
    texts = ["İ;", "TÜRKİ.", "DİLİ,", "a..", "b.,c", "x. y. z.", "<|endoftext|> A", "don't.", "", " ", "İ İ. i"]
    texts += ["".join(r.choice(signs) for _ in range(r.randrange(1, 50))) for _ in range(5000)]
    for most in (0, 100_000):  # nothing kept, all kept
        got = packing.WordEncoder(packing.tokenizer_path(), most).batch([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_paraphrases_of_benchmark_items(spark):
    """Items of which a sixth of the words are replaced, set among other words: nine in ten are found."""
    bench = spark.read.parquet(f"{SF1}/benchmark.parquet")
    r, docs, want = random.Random(6), [], set()
    for row in bench.collect():
        for k in range(10):
            own = [w if r.random() > 1 / 6 else f"other{r.randrange(1000)}" for w in (row["text"] or "").split()]
            doc_id = 1000 * row["item_id"] + k
            docs.append((doc_id, " ".join([*words(doc_id, r.randrange(20, 200)), *own, *words(-doc_id - 1, 60)])))
            want.add((doc_id, row["item_id"]))
    clean = [(-1 - i, " ".join(words(10**6 + i, 300))) for i in range(200)]
    found = {(x["doc_id"], x["item_id"]) for x in decontamination.query(spark.createDataFrame(docs + clean, "doc_id bigint, text string"), bench).collect()}
    recall = len(found & want) / len(want)
    print("paraphrase recall", recall, len(want))
    assert recall >= 0.9 and all(d >= 0 for d, _ in found)


def test_quality_features_fold_and_order(spark):
    """Features and folds against plain code, and the same scores however the tables are dealt."""
    import zlib

    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    texts = {x["doc_id"]: (x["text"] or "").encode() for x in docs.collect()}
    vectors = {x["doc_id"]: x["x"] for x in quality_classifier.featured(docs).collect()}
    for i, t in texts.items():
        shares = [(sum(t.count(c) for c in own) / len(t)) ** 0.5 if t.split() else 0.0 for own in ([bytes([b]) for b in c] for c in quality_classifier.CLASSES)]
        assert np.allclose(vectors[i][: len(shares)], shares, atol=1e-6)
    one = {x["doc_id"]: x for x in quality_classifier.query(docs, labels).collect()}
    two = {x["doc_id"]: x for x in quality_classifier.query(docs.repartition(5), labels.repartition(3)).collect()}
    for i, x in one.items():
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert abs(x["score"] - two[i]["score"]) < 1e-9
    # the labels of held-out rows are never read
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    assert all(abs(x["score"] - one[x["doc_id"]]["score"]) < 1e-9 for x in quality_classifier.query(docs, flipped).collect())


def test_licences_in_wordings_that_no_fit_saw(spark):
    """Names in wordings that neither fit nor calibration has, among other words: nine in ten of each
    family; wrapped lines of notices; and mentions that are no licence."""
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    lines = license_scan.sample_lines(docs)
    scanner = license_scan.Scanner(license_scan.train(lines))
    fill, r = " ".join(lines).split(), random.Random(7)
    own = ("This package comes with the {}.", "we ship it under {} terms", "see LICENSE ({}) for details", "Code in this folder falls under the {}")
    assert not {*own} & {*license_scan.WORDINGS, *license_scan.HELD_WORDINGS}
    recall = {}
    for family, names in license_scan.NAMES.items():
        hits = []
        for name, wording in itertools.product(names, own):
            at = r.randrange(1000)
            text = " ".join([*fill[at : at + r.randrange(10)], wording.format(name), *fill[at + 50 : at + 50 + r.randrange(10)]])
            hits.append(family in {f[2] for f in scanner.scan([text.encode()])[1]})
        recall[family] = sum(hits) / len(hits)
    print(recall)
    assert min(recall.values()) >= 0.9
    wrapped = [("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"), ("GPL", "under the terms of the GNU General Public License as published by")]
    assert all(f in {x[2] for x in scanner.scan([t.encode()])[1]} for f, t in wrapped)
    assert all(not scanner.scan([t.encode()])[1] for t in (*license_scan.OTHER, "A report from MIT on public art."))


def test_condensed_signatures():
    rng = np.random.default_rng(9)
    keys, nodes = rng.integers(0, 40, 6000).astype(np.uint64), rng.integers(0, 3000, 6000)
    kept, own, (member, centre, n) = stars.condensed(keys, nodes)
    want = {(int(k), int(x)) for k, x in zip(keys, nodes, strict=True)}
    assert {(int(k), int(x)) for k, x in zip(kept, own, strict=True)} <= want and len({int(k) for k in kept}) == 40
    least = {k: min(x for q, x in want if q == k) for k, _ in want}
    assert {(int(a), int(b)) for a, b in zip(member, centre, strict=True)} == {(x, least[k]) for k, x in want if x != least[k]}
    assert (n > stars.LOCAL).all()
