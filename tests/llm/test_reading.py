"""The reading of op4_substring_dedup: for all paragraphs of a slice at once, and as the plain one."""

import random
import re
import sys

import numpy as np
import pyarrow as pa

from quire.llm import stars, substring_dedup


class Docs:
    """Stands for a table: gives the function that would read it."""

    def select(self, *columns):
        return self

    def mapInArrow(self, rows, schema):
        return rows


def test_a_slice_is_read_without_calls_for_each_paragraph(spark):
    """Most of op4's time once went into calls for each paragraph and each word."""
    r = random.Random(0)
    lines = [" ".join(f"w{r.randrange(100_000)}" for _ in range(r.randrange(10, 40))) for _ in range(4000)]
    rows = stars.dealt(Docs(), substring_dedup.read_paragraphs, substring_dedup.min_hash_bands, 8)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(["\n".join(lines[i::20]).encode() for i in range(20)])], ["doc_id", "text"])
    before = sys.getprofile()
    sys.setprofile(count)
    try:
        out = list(rows([batch]))
    finally:
        sys.setprofile(before)
    print("calls", calls)
    assert sum(b.num_rows for b in out) == 8
    assert calls < len(lines)


def test_words_and_lines_are_the_plain_ones():
    """Odd spaces, capitals, bytes that are no text, NULs, and words of any length."""
    ends = [b"q" * n + end for n in (1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 500) for end in (b"", b"x", b"\0", b"\0\0")]
    texts = [None, b"", b"\n", b"  \n\n x", b"A b\x0bc\x0cd\r\ne\xff\0 f\xc3\x89 \xc2\xa0g\n\n", b" ".join(ends), b"a", b"\n".join(reversed(ends)).upper(), None]
    h, places, of, nth = substring_dedup._lines(texts)
    own = [(i, n, re.findall(rb"[^\x20\x09-\x0D]+", line)) for i, t in enumerate(texts) if t for n, line in enumerate(t.lower().split(b"\n"))]
    plain = [w for _, _, ws in own for w in ws]
    assert list(zip(of.tolist(), nth.tolist(), np.diff(places).tolist(), strict=True)) == [(i, n, len(ws)) for i, n, ws in own]
    assert len(h) == len(plain) == places[-1]
    assert len(set(h.tolist())) == len(set(plain)) == len(set(zip(plain, h.tolist(), strict=True)))
    assert [len(x) for x in substring_dedup._lines([None, b""])] == [0, 1, 0, 0]


def test_sets_and_sketches_are_the_plain_ones():
    r = random.Random(1)
    lines = [" ".join(r.choice("abc") if i % 3 else f"w{r.randrange(1000)}" for _ in range(10 + i)) for i in range(300)]
    *_, sets, _ = substring_dedup.read_paragraphs(["\n".join(lines).encode(), (b"la " * 200 + b"\n") * 3])
    which = np.array([*range(0, 303, 2), 301])
    own = sets.picked(which)
    assert [sorted(x.tolist()) for x in own] == [sets[i].tolist() for i in which.tolist()]
    assert len(sets.picked(which[:0])) == 0
    raw, width = stars.sketches(stars.Flat.of(big := [*own, np.arange(1, 50_000, dtype=np.uint64) ** np.uint64(5)]))
    plain = []
    for x in big:
        cells = max(256, min(1 << 15, 1 << (2 * len(x) - 1).bit_length()))
        plain.append(np.packbits(np.array([n & 1 for n in np.bincount((x % np.uint64(cells)).astype(int), minlength=cells)], np.uint8)).tobytes())
    assert width.tolist() == [len(x) for x in plain]
    assert raw.tobytes() == b"".join(plain)
