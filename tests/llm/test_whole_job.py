"""Cases in which an operator once did less than its whole job."""

import random

from quire.llm import decontamination, line_dedup, substring_dedup


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


def test_substring_dedup_finds_spans(spark):
    """A passage spliced into a longer line, one over parts of two lines and one of short lines."""
    passage = prose(0, 60)
    first = [*prose(1, 80), *passage, *prose(2, 70)]
    mid = [*prose(3, 90), *passage, *prose(4, 100)]
    two = [*prose(5, 40), *passage[:25]], [*passage[25:], *prose(6, 45)]
    short = [passage[i : i + 6] for i in range(0, 60, 6)]
    less = [*prose(7, 30), *passage[:49], *prose(8, 30)]
    texts = [(1, [first]), (2, [mid]), (3, [*two]), (4, [prose(9, 20), *short]), (5, [less]), (6, [["a"] * 120])]
    docs = spark.createDataFrame([(i, "\n".join(map(" ".join, t))) for i, t in texts], "doc_id bigint, text string").repartition(3)
    found = substring_dedup.query(docs).filter("cut").collect()
    got = {(r["doc_id"], r["line"], r["from_word"], r["to_word"], r["first_doc_id"], r["first_line"]) for r in found}
    assert got == {(2, 0, 90, 150, 1, 0), (3, 0, 40, 100, 1, 0), (4, 1, 20, 80, 1, 0), (6, 0, 1, 120, 6, 0)}
    out = {r["doc_id"]: r["text"] for r in substring_dedup.apply(docs).collect()}
    kept = {1: [first], 2: [[*mid[:90], *mid[150:]]], 3: [two[0][:40], two[1][35:]], 4: [prose(9, 20)], 5: [less], 6: [["a"]]}
    assert {i: [x.split() for x in t.split("\n")] for i, t in out.items()} == kept


def test_substring_dedup_leaves_no_run_twice(spark):
    """Every window of SPAN words with a word left, plainly: all but the first are cut."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = substring_dedup.query(docs).collect()
    gone = {(r["doc_id"], r["line"]) for r in rows if r["removed"]}
    got = {(r["doc_id"], w) for r in rows if r["cut"] for w in range(r["from_word"], r["to_word"])}
    seen, want = set(), set()
    for r in docs.orderBy("doc_id").collect():
        lines = [(x, n) for n, t in enumerate((r["text"] or "").encode().lower().split(b"\n")) for x in t.split()]
        for at in range(len(lines) - substring_dedup.SPAN + 1):
            own = lines[at : at + substring_dedup.SPAN]
            if all((r["doc_id"], n) in gone for _, n in own):
                continue
            key = tuple(x for x, _ in own)
            if key in seen:
                want |= {(r["doc_id"], at + i) for i in range(substring_dedup.SPAN)}
            seen.add(key)
    print("words in spans", len(want))
    assert got == want


def test_decontamination_of_many_items(spark):
    """Far more items than the latent rank: every verbatim copy is found, and nothing else."""
    items = [(i, " ".join(prose(10_000 + i, 5))) for i in range(2000)]
    docs = [(d, " ".join(x for i in range(d, 2000, 500) for x in (*(f"f{w[1:]}" for w in prose(50_000 + i, 100)), items[i][1]))) for d in range(500)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.query(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {(i % 500, i) for i in range(2000)}


def test_line_dedup_of_short_lines(spark):
    """Frequent short lines among others, and passages with a word per line, also with blank lines between."""
    other = [" ".join(prose(i, 12)) for i in range(20)]
    column = [f"item{i}" for i in range(12)]
    parted = [x for w in prose(90, 6) for x in (w, *[""] * 12)]
    texts = [
        [other[0], "Of, edti oner.", other[1]], [other[2], "Of, edti oner.", other[3]],
        [other[4], *column, other[5]], [other[6], *column, other[7]], [other[8], "item3", other[9]],
        [other[10], *parted, other[11]], [other[12], *parted, other[13]],
        [other[14], "", other[15], "yes", other[16]], [other[14], "", other[15], "yes", other[17]],
    ]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["deleted_lines"] for r in line_dedup.query(docs).collect()}
    ends = len(parted) - 11  # the last word's line; the blank lines behind it stand at the passage's end
    assert got == {0: [], 1: [1], 2: [], 3: [*range(1, 13)], 4: [], 5: [], 6: [*range(1, ends)], 7: [], 8: [0, 1, 2, 3]}


def test_decontamination_of_a_long_item(spark):
    """A word over PASSAGE is no part of its own: a document that holds just that word stays."""
    item = prose(70, decontamination.PASSAGE + 1)
    texts = [(1, " ".join([*prose(71, 20), *item, *prose(72, 20)])), (2, item[-1]), (3, f"x y {item[-1]} z")]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontamination.query(docs, bench).collect()] == [1]
    assert [r["doc_id"] for r in decontamination.apply(docs, bench).orderBy("doc_id").collect()] == [2, 3]
