"""The sums of op8_decontamination: as the plain ones to the last bit, without a copy of all rows."""

import tracemalloc

import numpy as np

from quire.llm import decontamination as d


def plain(cell, term, w, omega, out):
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    z = np.add.reduceat(omega[term] * w[:, None], starts)
    row = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1])))
    order = np.argsort(term, kind="stable")
    t = term[order]
    begins = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    out[t[begins]] += np.add.reduceat(z[row[order]] * w[order][:, None], begins)


def rows(r, n, terms):
    ids = r.integers(0, terms, n)
    cells, _ = d._cells(r.integers(0, 300, n // 100), d.PASSAGE)
    weights = np.where(r.random(terms) < 0.2, 0, r.random(terms))
    return d._tfidf(ids[: len(cells)], cells[:n], weights)


def test_sums_are_the_plain_ones_bit_by_bit():
    r = np.random.default_rng(1)
    for terms in (3, 500, 70_000):
        omega = r.standard_normal((terms, 8), np.float32)
        cell, term, w = rows(r, 20_000, terms)
        have, want = np.zeros_like(omega), np.zeros_like(omega)
        d._gram(cell, term, w, omega, have)
        plain(cell, term, w, omega, want)
        assert have.tobytes() == want.tobytes()
    for n, k in ((1, 1), (256, 256), (5000, 7), (5000, 4000)):
        starts = np.concatenate(([0], np.sort(r.choice(np.arange(1, n), k - 1, replace=False)))) if k > 1 else np.array([0])
        at = r.integers(0, len(omega), n)
        assert d._row_sums(omega, at, None, starts).tobytes() == np.add.reduceat(omega[at], starts).tobytes()


def test_distinct_keys():
    keys = np.random.default_rng(2).integers(0, 50, 500)
    for own in (keys, keys[:1], keys[:0]):
        for have, want in zip(d._distinct(own), np.unique(own, return_counts=True), strict=True):
            assert have.tolist() == want.tolist()


def test_rows_are_not_all_gathered_at_once():
    r = np.random.default_rng(3)
    omega = r.standard_normal((500, 280), np.float32)
    cell, term, w = rows(r, 16_000, 500)
    out = np.zeros_like(omega)
    tracemalloc.start()
    d._gram(cell, term, w, omega, out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000  # 30 million bytes and more when all rows are
