"""The pipeline against a plain version, and its stages on odd rows."""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quire.llm import decontamination, line_dedup, packing, quality_rules

SF1 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    """Whether every rule of the strictest policy holds."""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    chars, n = sum(map(len, w)), len(w)
    capitals = sum(unicodedata.category(c) == "Lu" for c in text)
    fails = (
        n < 50, 100 * len(again) > 50 * n, 100 * sum(c in "#*$%&|<>" for c in text) > 20 * n,
        len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines), n > 0 and not 2 * n <= chars <= 20 * n,
        100 * capitals > 60 * chars, 100 * text.count("!") > 30 * n,
    )
    return not any(fails)


def plain_grams(lines):
    weight = []
    for x in lines:
        n = len(WORD.findall(x))
        weight.append(3 if n >= 3 or len(x) >= 50 else max(n, len(x) * 3 // 50) if n else 0)
    filled = [i for i, v in enumerate(weight) if v]
    at = lambda k: filled[k] if 0 <= k < len(filled) else None
    out = set()
    for k, i in enumerate(filled):
        if weight[i] >= 3:
            spans = [(i, i)]
        else:
            nxt, prev = at(k + 1), at(k - 1)
            spans = [(i, nxt if nxt is not None and weight[i] + weight[nxt] >= 3 else at(k + 2))]
            spans.append((prev if prev is not None and weight[i] + weight[prev] >= 3 else at(k - 2), i))
        nxt = at(k + 1)
        if nxt is not None and nxt > i + 1 and weight[i] + weight[nxt] >= 3:
            spans.append((i, nxt))
        out |= {s for s in spans if None not in s}
    return out


def plain_lines(docs):
    seen, gone = {}, defaultdict(set)
    for i in sorted(docs):
        lines = docs[i].split("\n")
        for a, b in sorted(plain_grams(lines)):
            key = tuple(lines[a : b + 1])
            if seen.setdefault(key, (i, a)) != (i, a):
                gone[i] |= {*range(a, b + 1)}
    out = {}
    for i, t in docs.items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if not gone[i] or WORD.search(left):
            out[i] = left
    return out


def plain_groups(docs):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: t for i, t in docs.items() if root(i) == i}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_leaks(text, items):
    """Every window against every item, whatever its cosine."""
    w = decontamination.words(text.encode())
    for at in range(0, max(1, len(w)), decontamination.STEP):
        window = w[at : at + 3 * decontamination.STEP]
        held = Counter(window)
        for item in items:
            if sum((Counter(item.words) & held).values()) < decontamination.MAYBE * len(item.words):
                continue
            share = lcs(item.words, window) / len(item.words)
            answer = item.words[item.answer :]
            if share >= decontamination.SURE or share >= decontamination.MAYBE and lcs(answer, window) >= decontamination.MAYBE * len(answer):
                return True
    return False


def test_run_against_a_plain_version(spark):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    items = decontamination.items_of([tuple(r) for r in spark.read.parquet(f"{SF1}/benchmark.parquet").select("item_id", "text").orderBy("item_id").collect()])
    kept = plain_groups(plain_lines({i: t for i, t in docs.items() if plain_rules(t)}))
    kept = {i: t for i, t in kept.items() if not plain_leaks(t, items)}
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), {}
    for i, t in kept.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END]
        for k, at in enumerate(range(0, len(ids), packing.LIMIT)):
            own = ids[at : at + packing.LIMIT]
            want[i, k] = at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
    rows = corpus_pipeline.run(spark, SF1).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    gaps = []
    for n in sorted((v[1] for v in want.values()), reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((best or packing.LIMIT) - n)
    assert len({r["sequence_id"] for r in rows}) == len(gaps)


KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, line string, bucket int, _id string, _row string, a string"
LONG = " ".join(f"w{i % 7001}" for i in range(30_000))


def odd_rows():
    good = " ".join(f"g{i}" for i in range(80))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (6, good), (None, good + " z"), (None, None), (7, "é ß 漢字 " * 30), (8, "\n" * 50 + good)]
    return [(i, t, None, "s", None, 1, "x", 1, "y", "z", "c") for i, t in texts]


STAGES = {
    "policy": lambda docs, bench: quality_rules.apply_policy(docs),
    "lines": lambda docs, bench: line_dedup.apply(docs),
    "bench": decontamination.apply,
}


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows_in_stages(spark, name):
    docs = spark.createDataFrame(odd_rows(), KIND)
    bench = spark.createDataFrame([(1, "g0 g1 g2 g3 g4 g5 g6 g7 g8 g9. g10 g11."), (2, None), (None, "x y"), (3, "")], "item_id bigint, text string")
    out = STAGES[name](docs, bench)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    have = Counter((i or 0, t or "") for i, t, *_ in odd_rows())
    if name == "policy":  # only texts of fifty words or more without much repetition stay, each as often as it stood
        assert Counter(got) == Counter({k: n for k, n in have.items() if len(WORD.findall(k[1])) >= 50 and k[0] in (0, 6, 8) and "g0" in k[1]})
    if name == "lines":  # the first of equal lines stays; a document of later ones goes
        assert [i for i, t in got if t == LONG] == [5] and sum("g0 g1" in t for _, t in got) == 2
    if name == "bench":
        assert all("g0 g1" not in t for _, t in got) and len(got) == sum(n for (_, t), n in have.items() if "g0 g1" not in t)
    assert STAGES[name](docs.limit(0), bench.limit(0)).collect() == []


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    bench = spark.read.parquet(f"{SF1}/benchmark.parquet")
    for n, rows in (("odd", odd_rows()), ("none", [])):
        spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
    got = {(r["doc_id"], r["piece"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    assert {i for i, _ in got} <= {None, 6, 8} and got
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
