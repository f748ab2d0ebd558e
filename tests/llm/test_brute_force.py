"""Each operator against a plain version over the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quire.llm import decontamination, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, queries, secret_scan, substring_dedup, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def groups(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def similar(sets):
    """Pairs of Jaccard 0.8 or more; a shared element is needed, so an index finds the partners."""
    by = defaultdict(list)
    for n, s in sets.items():
        for x in s:
            by[x].append(n)
    both = defaultdict(int)
    for ns in by.values():
        for i, a in enumerate(ns):
            for b in ns[i + 1 :]:
                both[a, b] += 1
    return [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want))


def test_licences(docs, texts):
    notices = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    }
    got = {r["doc_id"]: r["families"] for r in license_scan.query(docs).collect()}
    want = {i: ",".join(sorted(f for f, n in notices.items() if n in t)) for i, t in texts.items()}
    assert got == want


def test_every_notice_is_found(spark, docs):
    rows = [(i, f"{f}|{n}") for i, (f, n) in enumerate((f, n) for f, ns in license_scan.NOTICES.items() for n in ns)]
    model = license_scan.train(license_scan.sample_lines(docs))
    found = license_scan.findings(spark.createDataFrame([(i, x.split("|", 1)[1]) for i, x in rows], "doc_id long, text string"), model)
    got = {r["doc_id"]: r["family"] for r in found.collect()}
    assert got == {i: x.split("|")[0] for i, x in rows}


def test_secrets(docs, texts):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rules = (("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    for r in secret_scan.query(docs).collect():
        spans = sorted(
            (m.start(), k, f"{name}:{m.start()}:{m.end()}")
            for k, (name, p, group, least) in enumerate(rules)
            for m in p.finditer(texts[r["doc_id"]] or "")
            if len(m[group]) >= least
        )
        counts = [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()


def test_ngram_join(docs, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = groups(texts, similar(sets))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.query(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_substring_dedup(docs, texts):
    places = {(i, n): shingles(x) for i, t in texts.items() for n, x in enumerate((t or "").split("\n")) if len(WORD.findall(x)) >= 10}
    want = groups(sorted(places), similar(places))
    removed = {p for p, root in want.items() if p != root}
    rows = substring_dedup.query(docs).collect()
    got = {(r["doc_id"], r["line"]) for r in rows if r["removed"]}
    # a link may be missed by the bands, at most one in a thousand
    assert got <= removed and len(removed - got) <= 1 + len(removed) // 1000


def test_line_dedup(docs, texts):
    out = {r["doc_id"]: r for r in line_dedup.query(docs).collect()}
    seen = defaultdict(list)
    for i in sorted(texts):
        for n, x in enumerate((texts[i] or "").split("\n")):
            seen[x].append((i, n))
    for i, t in texts.items():
        lines = (t or "").split("\n")
        gone = set(out[i]["deleted_lines"])
        assert out[i]["text"] == (t if not gone else "\n".join(x for n, x in enumerate(lines) if n not in gone))
        for n, x in enumerate(lines):
            first = seen[x][0] == (i, n)
            assert not (first and n in gone), "a first occurrence was deleted"
            if len(x) >= line_dedup.CHARS and not first:
                assert n in gone, "a long line that repeats stayed"


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.query(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            own = ids[at : at + 4096]
            assert (r["piece"], r["start"], r["length"]) == (k, at, len(own))
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
            at += len(own)
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    # best-fit decreasing, one piece after another
    gaps = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((best or 4096) - n)
    assert len(by_sequence) == len(gaps)


def test_decontamination(spark, docs, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.query(docs, bench).collect()}
    items = {r["item_id"]: decontamination.words((r["text"] or "").encode()) for r in bench.collect()}
    held = {i: b" " + b" ".join(decontamination.words((t or "").encode())) + b" " for i, t in texts.items()}
    whole = {(i, j) for i, t in held.items() for j, w in items.items() if w and b" " + b" ".join(w) + b" " in t}
    assert whole <= got
    for i, j in got:  # what is found shares most of the item's words
        words = set(held[i].split())
        assert sum(w in words for w in items[j]) >= 0.5 * len(items[j])
    kept = {r["doc_id"] for r in decontamination.apply(docs, bench).collect()}
    assert kept == set(texts) - {i for i, _ in got}


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.query(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    print("held-out", len(rows), right, auc)
    assert auc >= 0.85 and right >= 0.75
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_ablations(docs):
    led = quality_rules.ledger(docs).cache()
    bits = [r["fail_bits"] for r in led.collect()]
    for r in quality_rules.ablations(led).collect():
        b = quality_rules.BIT[r["rule"]]
        assert r["failed"] == sum(x & b > 0 for x in bits) and r["kept_without"] == sum(x & ~b == 0 for x in bits)


def test_warc_damage():
    import io

    good = warc.member(warc.record(1, "http://x/", b"payload" * 10, "response", None))
    assert len(list(warc.read_records(io.BytesIO(good)))) == 1
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[: len(good) // 2])))
