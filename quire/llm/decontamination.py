"""Benchmark decontamination by latent semantic retrieval.

1. Passages (PASSAGE words, disjoint) of all documents give the document frequency of every
   benchmark term, and so its idf.
2. Randomised SVD: each task sketches the Gram matrix of its TF-IDF passages with one Gaussian
   matrix, made from a seed on the spot; the sketches are summed in the cluster, the benchmark's own
   passages are added with a weight, and a Nystrom step gives the right singular vectors.
3. Every document's overlapping windows are projected to the latent space and compared with the
   benchmark's passages by cosine; windows above COSINE are candidates.
4. A candidate leaks if the longest common subsequence of words covers SURE of the item, or MAYBE of
   it and as much of its answer, which is the item's last sentence.

The texts are split once; the passes read their words' term numbers.  More than RANK benchmark
passages are split into groups of at most RANK, each with a latent space of its own, made by steps
2 and 3 on its own, so what reaches the driver or every executor at a time is bounded by RANK,
PASSAGE and AT_ONCE; the items themselves and their terms are the benchmark's size.  Terms that more than COMMON of all passages hold weigh nothing, but for each item's four
rarest.  Words are compared with ASCII capitals folded and ASCII punctuation removed.  With no
more passages than RANK a group's latent space holds each one's vector.

Defined cases: null or blank texts and items match nothing; an item of over PASSAGE words is cut
into parts, each of which counts, the last reaching back so that it has PASSAGE words too; items and documents that occur twice give the same pairs once for
each document row; an empty benchmark matches nothing; a null doc_id is kept as null.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, handed_back, staged, worker_cache

PASSAGE = 64
STEP = 32
RANK = 256
EXTRA = 24
COMMON = 0.02
COSINE = 0.12
SURE, MAYBE = 0.8, 0.55
#: Weight of a benchmark passage against a corpus passage in the SVD.
OWN = 25.0
#: idf, as a share of the highest, at which words outside the benchmark count in a window's norm.
OUTSIDE = 0.6
CHUNK = 64
#: Groups of items searched at a time.
AT_ONCE = 4
#: Bytes of text, and words or windows with their latent vectors, handled at a time.
SLICE, BLOCK = 2 << 20, 16_384
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split() if text else []


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    #: Where the last sentence starts, in words.
    answer: int


def items_of(rows) -> list[Item]:
    out = []
    for item_id, text in rows:
        data = (text or "").encode()
        own = words(data)
        cut = max(data.rstrip(b" .!?\n").rfind(x) for x in (b". ", b".\n", b"? ", b"! ", b"\n"))
        answer = len(words(data[: cut + 1])) if cut >= 0 else 0
        for at in range(0, len(own), PASSAGE):
            at = max(0, min(at, len(own) - PASSAGE))
            part = own[at : at + PASSAGE]
            out.append(Item(item_id, part, min(max(answer - at, 0), len(part) - 1)))
    return out


def _kind(vocabulary) -> type:
    return np.uint16 if len(vocabulary) < 1 << 16 else np.uint32


class Terms:
    """Term numbers of words: 0 for those that the benchmark doesn't hold."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.words = pa.array(sorted(vocabulary, key=vocabulary.get), pa.binary())
        self.kind = _kind(vocabulary)

    def of(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Of a column of texts: the numbers of their words in turn, and each text's number of words."""
        texts = [(t.as_py() or b"").lower().translate(None, PUNCTUATION) for t in column]
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()) if _valid(texts) else pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
        coded, places = lists.values.dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        own = coded.dictionary.cast(pa.binary())
        known = (pc.fill_null(pc.index_in(own, self.words), -1).to_numpy() + 1).astype(self.kind)
        numbers = coded.indices.to_numpy()
        filled = pc.binary_length(own).to_numpy() > 0
        if not filled.all():  # before a leading and behind a trailing space
            keep = filled[numbers]
            places, numbers = np.concatenate(([0], np.cumsum(keep)))[places], numbers[keep]
        return known[numbers], np.diff(places)


def _valid(texts: list[bytes]) -> bool:
    try:
        b"\n".join(texts).decode()
    except UnicodeDecodeError:
        return False
    return True


def numbered(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, terms): every text's words as term numbers.  The texts are split here, once; the passes
    that follow read the numbers."""

    def rows(batches):
        terms = Terms(vocabulary)
        for batch in _slices(batches, 1):
            ids, lens = terms.of(batch.column(1))
            ends = np.cumsum(lens).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[a:b].tobytes() for a, b in itertools.pairwise([0, *ends])], pa.binary())], ["doc_id", "terms"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id bigint, terms binary")


def _read(batch, column: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and words of each text, from a batch of `numbered`; as numbers of a group by `group`."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(column)]
    return (np.concatenate(parts) if parts else np.empty(0, kind)), np.fromiter(map(len, parts), np.int64, len(parts))


def _cells(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The disjoint cell, of `size` words, of every word of a batch, and each text's first cell."""
    per = -(-lens // size)
    first = np.cumsum(per) - per
    start = np.repeat(np.cumsum(lens) - lens, lens)
    return np.repeat(first, lens) + (np.arange(len(start)) - start) // size, first


def _slices(batches, column: int = 0):
    """The batches in slices of about SLICE bytes of text; a longer text is a slice of its own."""
    worker_cache("decontamination", dict)  # drops what other stages left
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // SLICE
        starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
        for lo, hi in itertools.pairwise(starts):
            yield batch.slice(lo, hi - lo)
    handed_back()


def frequencies(texts: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Passages with each term, and passages; over all `numbered` texts."""
    kind = _kind(range(terms))

    def counted(batches):
        n = terms + 1
        counts, total = np.zeros(n, np.int64), 0
        for batch in _slices(batches, 1):
            ids, lens = _read(batch, 1, kind)
            cells, _ = _cells(lens, PASSAGE)
            total += int((-(-lens // PASSAGE)).sum())
            hit = np.flatnonzero(ids)
            held = _distinct(cells[hit] * n + ids[hit])[0]
            counts += np.bincount(held % n, minlength=n)
        counts[0] = total
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], ["term", "n"])

    rows = texts.mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(terms + 1, np.int64)
    for r in rows:  # a row per benchmark term
        out[r["term"]] = r["n"]
    return out, int(out[0])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each is there; np.unique may hash, which is slower here."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[begins], np.diff(begins, append=len(keys))


def _gauss(terms: int, rank: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((terms, rank), np.float32)


def _tfidf(ids: np.ndarray, cells: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (cell, term, weight), each cell of norm 1, in order of cells."""
    use = weights[ids] > 0
    key, tf = _distinct(cells[use] * len(weights) + ids[use])
    cell, term = np.divmod(key, len(weights))
    w = (tf * weights[term]).astype(np.float32)
    norms = np.sqrt(np.bincount(cell, w * w)) if len(cell) else np.empty(0)
    return cell, term, w / norms[cell] if len(cell) else w


def _gram(cell: np.ndarray, term: np.ndarray, w: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A omega) of the sparse rows to out."""
    if not len(cell):
        return
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    z = _row_sums(omega, term, w, starts)
    row = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1])))
    # numbers of 16 bits are sorted by their digits
    order = np.argsort(term.astype(np.uint16) if len(omega) <= 1 << 16 else term, kind="stable")
    t = term[order]
    begins = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    out[t[begins]] += _row_sums(z, row[order], w[order], begins)


#: Rows that are gathered and summed at a time: with their columns they fit a core's cache.
GATHERED = 256


def _row_sums(table: np.ndarray, rows: np.ndarray, w: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
    """np.add.reduceat(table[rows] * w[:, None], starts), by whole sums that hold GATHERED rows or a little more."""
    out = np.empty((len(starts), table.shape[1]), table.dtype if w is None else np.result_type(table, w))
    cuts = np.append(np.flatnonzero(np.diff(starts // GATHERED, prepend=-1)), len(starts))
    for i, j in itertools.pairwise(cuts.tolist()):
        lo, hi = starts[i], starts[j] if j < len(starts) else len(rows)
        part = table[rows[lo:hi]]
        if w is not None:
            part = part * w[lo:hi, None]
        np.add.reduceat(part, starts[i:j] - lo, out=out[i:j])
    return out


def latent(texts: DataFrame, group: np.ndarray, items: list[Item], vocabulary: dict[bytes, int], weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages: terms x rank.  group: the group's number of every term."""
    kind = _kind(range(len(group) - 1))
    live = np.flatnonzero(weights > 0)
    place = np.zeros(len(weights), np.int64)
    place[live] = np.arange(len(live))
    width = min(rank + EXTRA, max(1, len(live)))

    def sketched(batches):
        omega = np.zeros((len(weights), width), np.float32)
        omega[live] = _gauss(len(live), width)
        out = np.zeros_like(omega)
        for batch in _slices(batches, 1):
            ids, lens = _read(batch, 1, kind)
            ids, (cells, _) = group[ids], _cells(lens, PASSAGE)
            cell, term, w = _tfidf(ids, cells, weights)
            begins = np.flatnonzero(np.diff(cell, prepend=-1))
            for own in np.split(np.arange(len(cell)), begins[:: max(1, BLOCK // PASSAGE)]):
                _gram(cell[own], term[own], w[own], omega, out)
        out = out[live]
        chunks = [i for i in range(0, len(live), CHUNK) if out[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([out[i : i + CHUNK].tobytes() for i in chunks], pa.binary())], ["chunk", "y"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(y, np.float32).reshape(-1, width).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([y.tobytes() for y in total.values()], pa.binary())], ["chunk", "y"])

    sums = "chunk bigint, y binary"
    parts = texts.mapInArrow(sketched, sums).repartition("chunk").mapInArrow(summed, sums).collect()  # terms x rank
    y = np.zeros((len(live), width))
    for r in parts:
        y[r["chunk"] : r["chunk"] + CHUNK] = np.frombuffer(r["y"], np.float64).reshape(-1, width)
    omega = _gauss(len(live), width).astype(np.float64)
    a = _item_rows(items, vocabulary, weights)[:, live]
    y = y + OWN * max(1.0, np.abs(y).max()) * (a.T @ (a @ omega))
    # Nystrom: G ~ Y (Omega' Y)^-1 Y'
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > value.max() * 1e-10
    u, _, _ = np.linalg.svd(y @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    out = np.zeros((len(weights), min(rank, u.shape[1])), np.float32)
    out[live] = u[:, : out.shape[1]]
    return out


def _item_rows(items: list[Item], vocabulary: dict[bytes, int], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items), len(weights)))
    for i, item in enumerate(items):
        np.add.at(out[i], [vocabulary[w] for w in item.words], 1)
    out *= weights
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


class Lcs:
    """Longest common subsequence of an item and a window, by the bits of a number."""

    def __init__(self, ids: list[int]) -> None:
        self.n, self.masks = len(ids), {}
        for i, w in enumerate(ids):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def matched(self, window: list[int]) -> int:
        full = (1 << self.n) - 1
        row, get = full, self.masks.get
        for w in window:
            if m := get(w):
                u = row & m
                row = ((row + u) | (row - u)) & full
        return self.n - row.bit_count()


@dataclass
class Index:
    """What the search sends to every executor; bounded by the benchmark."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    terms: np.ndarray
    items: list[Item]
    vectors: np.ndarray
    outside: float
    #: The group's number of every term of the benchmark.
    group: np.ndarray

    def __post_init__(self) -> None:
        self.whole = [Lcs([self.vocabulary[w] for w in x.words]) for x in self.items]
        self.answers = [Lcs([self.vocabulary[w] for w in x.words[x.answer :]]) for x in self.items]

    def search(self, ids: np.ndarray, lens: np.ndarray) -> tuple[list[int], list[int], list[float]]:
        """(row, item id, share of the item) of the leaks in texts, given as all terms' numbers."""
        ids = self.group[ids]
        cells, first = _cells(lens, STEP)
        n_cells = int((-(-lens // STEP)).sum())
        w = self.weights[ids]
        hit = np.flatnonzero(w > 0)
        if not len(hit):
            return [], [], []
        own = np.bincount(cells[hit], (w[hit] ** 2), n_cells) + np.bincount(cells[ids == 0], minlength=n_cells) * self.outside**2
        inside = np.bincount(cells[hit], (w[hit] ** 2), n_cells)
        row = np.repeat(np.arange(len(lens)), -(-lens // STEP))
        span = PASSAGE // STEP + 1
        norm, mass = np.zeros(n_cells), np.zeros(n_cells)
        for o in range(span):
            same = np.zeros(n_cells, bool)
            same[: n_cells - o] = row[: n_cells - o] == row[o:]
            at = np.flatnonzero(same)
            norm[at] += own[at + o]
            mass[at] += inside[at + o]
        # cosine can't reach the threshold where the window's benchmark terms hold too little of its norm
        live = np.flatnonzero(mass * span > COSINE**2 * norm)
        out: dict[tuple[int, int], float] = {}
        ends = np.cumsum(lens)
        need = np.unique((live[:, None] + np.arange(span)).ravel())
        need = need[need < n_cells]
        number = np.full(n_cells + span, -1, np.int64)
        number[need] = np.arange(len(need))
        word_at = hit[number[cells[hit]] >= 0]
        latent_ = np.zeros((len(need) + 1, self.terms.shape[1]), np.float32)
        for lo in range(0, len(word_at), BLOCK):
            part = word_at[lo : lo + BLOCK]
            where = number[cells[part]]
            starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            latent_[where[starts]] += _row_sums(self.terms, ids[part], None, starts)
        for lo in range(0, len(live), BLOCK):
            at = live[lo : lo + BLOCK]
            sums = np.zeros((len(at), latent_.shape[1]), np.float32)
            for o in range(span):
                ok = (at + o < n_cells) & (row[np.minimum(at + o, n_cells - 1)] == row[at])
                sums += latent_[np.where(ok, number[np.minimum(at + o, n_cells - 1)], -1)]
            cosine = sums @ self.vectors.T / np.sqrt(np.maximum(norm[at], 1e-12))[:, None]
            for i, j in zip(*np.nonzero(cosine >= COSINE), strict=True):
                r = int(row[at[i]])
                item = self.items[j]
                if out.get((r, item.item_id), 0) >= 1:
                    continue
                begin = int(ends[r] - lens[r] + (at[i] - first[r]) * STEP)
                window = ids[begin : min(begin + span * STEP, int(ends[r]))].tolist()
                share = self.whole[j].matched(window) / len(item.words)
                if share >= SURE or share >= MAYBE and self.answers[j].matched(window) >= MAYBE * self.answers[j].n:
                    out[r, item.item_id] = max(share, out.get((r, item.item_id), 0))
        found = sorted(out.items())
        return [k[0] for k, _ in found], [k[1] for k, _ in found], [v for _, v in found]


def _numbers(items: list[Item]) -> dict[bytes, int]:
    return {w: i + 1 for i, w in enumerate(sorted({w for x in items for w in x.words}))}


class Search:
    """The benchmark's items and terms, the numbered texts, and an index of each group of at most RANK
    items; a job for the frequencies and one for each group."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame) -> None:
        self.items = items_of(benchmark.select("item_id", "text").filter("item_id IS NOT NULL").orderBy("item_id").collect())
        self.vocabulary = _numbers(self.items)
        self.texts = staged(numbered(docs, self.vocabulary), "terms") if self.items else None

    def indexes(self):
        """The indexes, at most AT_ONCE in a list: what is sent at a time is at most AT_ONCE times
        RANK x PASSAGE terms x RANK numbers, whatever the benchmark's size."""
        df, total = frequencies(self.texts, len(self.vocabulary))
        n = -(-len(self.items) // RANK)
        cuts = [len(self.items) * g // n for g in range(n + 1)]
        groups = list(itertools.pairwise(cuts))
        for at in range(0, n, AT_ONCE):
            yield [_index(self.texts, self.items[lo:hi], self.vocabulary, df, total) for lo, hi in groups[at : at + AT_ONCE]]


def _index(texts: DataFrame, items: list[Item], numbers: dict[bytes, int], df: np.ndarray, total: int) -> Index:
    """The index of one group; numbers: places of all words in df."""
    vocabulary = _numbers(items)
    group = np.zeros(len(numbers) + 1, np.int32)
    for w, i in vocabulary.items():
        group[numbers[w]] = i
    df = df[[0, *(numbers[w] for w in vocabulary)]]
    idf = np.log((1 + total) / (1 + df))
    idf[0] = 0
    weights = np.where(df <= max(2, COMMON * total), idf, 0)
    for x in items:
        rare = sorted({vocabulary[w] for w in x.words}, key=lambda t: (df[t], t))[:4]
        weights[rare] = np.maximum(idf[rare], 1e-3)
    weights[0] = 0
    vectors = latent(texts, group, items, vocabulary, weights)
    projected = (_item_rows(items, vocabulary, weights) @ vectors).astype(np.float32)
    projected /= np.maximum(np.linalg.norm(projected, axis=1), 1e-12)[:, None]
    terms = (vectors * weights[:, None]).astype(np.float32)
    return Index(vocabulary, weights, terms, items, projected, OUTSIDE * float(weights.max()), group)


def _send(docs: DataFrame, indexes: list[Index]):
    """A broadcast of the indexes as plain values: workers need no copy of this package to read it."""
    plain = [(x.vocabulary, x.weights, x.terms, [(i.item_id, i.words, i.answer) for i in x.items], x.vectors, x.outside, x.group) for x in indexes]
    return docs.sparkSession.sparkContext.broadcast(plain)


def _received(sent) -> list[Index]:
    return [Index(vocabulary, weights, terms, [Item(*x) for x in items], vectors, outside, group) for vocabulary, weights, terms, items, vectors, outside, group in sent.value]


def _searched(indexes: list[Index], ids: np.ndarray, lens: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """(row, item id, share of the item) of the leaks by all groups; an item's parts may be in two."""
    out: dict[tuple[int, int], float] = {}
    for index in indexes:
        for row, item, share in zip(*index.search(ids, lens), strict=True):
            out[row, item] = max(share, out.get((row, item), 0))
    found = sorted(out.items())
    return [k[0] for k, _ in found], [k[1] for k, _ in found], [v for _, v in found]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): documents that hold a benchmark item, or most of one."""
    names = "doc_id bigint, item_id bigint, share double"
    search = Search(docs, benchmark)
    if not search.items:
        return docs.sparkSession.createDataFrame([], names)
    kind, parts = _kind(search.vocabulary), []
    for indexes in search.indexes():
        sent = _send(docs, indexes)

        def rows(batches, sent=sent):
            own = _received(sent)
            for batch in _slices(batches, 1):
                row, item, share = _searched(own, *_read(batch, 1, kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "share"])

        parts.append(search.texts.mapInArrow(rows, names))
    if len(parts) == 1:
        return parts[0]
    # a long item's parts may be in two groups; the rows of one document are told apart no more
    parts = [staged(p, "leaks") for p in parts]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def apply(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak; narrow, as the rows pass through the search."""
    search = Search(docs, benchmark)
    if not search.items:
        return docs
    vocabulary, at, out, last = search.vocabulary, docs.columns.index("text"), docs, None
    for indexes in search.indexes():
        sent = _send(docs, indexes)

        def rows(batches, sent=sent):
            own, terms = _received(sent), Terms(vocabulary)
            for batch in _slices(batches, at):
                keep = np.ones(batch.num_rows, bool)
                keep[_searched(own, *terms.of(batch.column(at).cast(pa.binary())))[0]] = False
                yield batch.filter(pa.array(keep))

        if last is not None:
            out = staged(out, "decontaminated")
        out = last = out.mapInArrow(rows, docs.schema)
    dropped(search.texts)
    return out


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
