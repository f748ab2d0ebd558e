r"""Substring dedup: paragraphs by MinHash banding, and word runs that don't keep to lines.

A paragraph is a line of MIN_WORDS words or more (words without ASCII capitals).  Equal word
sequences are one paragraph from the start.  MinHash values of the 5-word shingles are banded; the
rows of a band are the most with which two paragraphs of Jaccard 0.8 still collide with probability
RECALL.  Colliding paragraphs are compared, verified by exact Jaccard of their whole sets and
joined into components; of each component the first occurrence, by doc_id and line, stays and the
others go.  Sweeps, verification and components are those of the n-gram join.

Then every run of SPAN words or more, across line ends, that stands verbatim at an earlier place, by
doc_id and word, is cut as a span.  A window is SPAN words of which some are left by the paragraphs;
the least hash of its GRAM-word grams is its fingerprint, so equal windows have equal ones; they are
read along with the paragraphs.  Only the windows of fingerprints that stand at several places are dealt out, by the hash of their words; each
but the first of its hash is cut, so no run is missed whatever surrounds it.

Defined cases: null, empty and short lines are never paragraphs; a document with a null doc_id keeps
its lines, and they count for nobody; a row that occurs twice has each of its paragraphs twice, and
only one of the equal occurrences is the first; a paragraph that repeats within one document counts
like any other.  Rows of one doc_id and text are one document for spans, cut in each of them.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm.common import handed_back, staged
from quire.llm.ngram_join import NO_PRINTS, WORDS, shingles
from quire.llm.stars import Flat, linked, mix, text_slices

MIN_WORDS = 10
SIMILAR = 0.8
VALUES = 64
RECALL = 0.999
SPAN, GRAM = 50, 25
U = np.uint64
C = U(0x9E3779B97F4A7C15)
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
SPACES = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
#: Bytes of a word that are hashed eight at a time, for all words at once; a longer word is hashed on its own.
LONG_WORD = 64


def tuned(values: int = VALUES, similar: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the most rows a band with the recall."""
    rows = max(r for r in range(1, values + 1) if r == 1 or 1 - (1 - similar**r) ** (values // r) >= recall)
    return values // rows, rows


def min_hash_bands(sets: list[np.ndarray] | Flat) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, set number of each).  Elements are hashes, so that products with odd numbers order them anew."""
    bands, rows = tuned()
    sets = Flat.of(sets)
    flat, begins = sets.items, sets.places[:-1]
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U) * C).reshape(-1, 2)
    keys, anew = np.empty((len(sets), bands), U), np.empty_like(flat)
    for band in range(bands):
        acc = np.full(len(sets), U(band + 1))
        for flip, factor in seeds[band * rows : (band + 1) * rows]:
            np.bitwise_xor(flat, flip, out=anew)
            np.multiply(anew, factor | U(1), out=anew)
            acc = mix(acc * C + np.minimum.reduceat(anew, begins))
        keys[:, band] = acc
    return keys.ravel(), np.repeat(np.arange(len(sets)), bands)


class _Sets:
    """The shingle sets of paragraphs, made when asked for."""

    def __init__(self, whole: np.ndarray, places: np.ndarray) -> None:
        self.whole, self.places = whole, places

    def __getitem__(self, i: int) -> np.ndarray:
        return np.unique(self.whole[self.places[i] : self.places[i + 1] - WORDS + 1])

    def picked(self, which: np.ndarray) -> Flat:
        """The sets of the paragraphs `which`, distinct elements as they come."""
        n = self.places[which + 1] - self.places[which] - WORDS + 1
        begins = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(which)), n)
        items = self.whole[np.arange(len(owner)) + np.repeat(self.places[which] - begins, n)]
        # the few elements that a set may hold twice are found by a hash with the set's number
        tagged = _hashed(items, owner.astype(U))
        ordered = np.sort(tagged)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            own = np.flatnonzero(np.isin(tagged, twice))
            own = own[np.lexsort((items[own], owner[own]))]
            same = (items[own[1:]] == items[own[:-1]]) & (owner[own[1:]] == owner[own[:-1]])
            left = np.delete(np.arange(len(items)), own[1:][same])
            items, n = items[left], np.bincount(owner[left], minlength=len(which))
        return Flat(items, np.concatenate(([0], np.cumsum(n))))


def _summed(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.concatenate(([U(0)], np.cumsum(x, dtype=U)))
    return total[places[1:]] - total[places[:-1]]


def _hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of raw in turn, and where they begin."""
    import xxhash

    text = np.frombuffer(raw + bytes(8), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = SPACES[text[: len(raw)]]
    edges = np.flatnonzero(space[1:] != space[:-1])
    begin, n = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) + 1, U, text, strides=(1,))
    h, at = mix(n.astype(U) * C), np.flatnonzero(n <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        at = at[n[at] > done]
        if not len(at):
            break
        rest = np.minimum(n[at] - done, 8).astype(U)
        h[at] = _hashed(h[at], eight[begin[at] + done] & (~U(0) >> (U(64) - U(8) * rest)))
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : begin[i] + n[i]])
    return h, begin


def _lines(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words in turn; where the words of each line begin (one more place), its text and its number there."""
    held = [i for i, t in enumerate(texts) if t]
    if not held:
        return np.empty(0, U), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    raw = b"\n".join([texts[i] for i in held]).lower()
    n = np.array([texts[i].count(b"\n") + 1 for i in held])
    h, begin = _hashed_words(raw)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == ord("\n"))
    places = np.concatenate(([0], np.searchsorted(begin, ends), [len(h)]))
    return h, places, np.repeat(np.array(held), n), (np.arange(len(places) - 1) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)


def read_paragraphs(texts: list[bytes | None]) -> tuple:
    """A place for each line of MIN_WORDS words or more, named by a hash of its words in turn, and the
    texts' fingerprints."""
    h, places, of, nth = _lines(texts)
    n = np.diff(places)
    at = np.arange(len(h)) - np.repeat(places[:-1], n)
    node = (mix(_summed(mix(h + mix(at.astype(U) + U(1))), places) + n.astype(U)) >> U(1)).astype(np.int64)
    use = np.flatnonzero(n >= MIN_WORDS)
    sets = _Sets(shingles(h[np.repeat(n >= MIN_WORDS, n)]), np.concatenate(([0], np.cumsum(n[use]))))
    return of[use], nth[use], n[use], node[use], sets, _prints(h, np.repeat(of, n))


def _widened(x: np.ndarray, width: int, joined) -> np.ndarray:
    """joined over every `width` places in a row, by doubling."""
    n = 1
    while n < width:
        step = min(n, width - n)
        x = joined(x[: max(0, len(x) - step)], x[step:])
        n += step
    return x


def _hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * C + b)


def _windows(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words in turn: the grams at each, and of the SPAN words from each on their hash, their
    fingerprint (the least gram), and whether they are all of one text."""
    grams = _widened(h, GRAM, _hashed)
    whole = _hashed(grams[: max(0, len(grams) - (SPAN - GRAM))], grams[SPAN - GRAM :])
    return grams, whole, _widened(grams, SPAN - GRAM + 1, np.minimum), text[: max(0, len(text) - SPAN + 1)] == text[SPAN - 1 :]


def _prints(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, text) of every place at which some window has its fingerprint."""
    if len(h) < SPAN:
        return NO_PRINTS
    grams, _, least, inside = _windows(h, text)
    ends = np.zeros(SPAN - GRAM, U)
    most = _widened(np.concatenate((ends, np.where(inside, least, U(0)), ends)), SPAN - GRAM + 1, np.maximum)
    at = np.flatnonzero(grams == most)
    return grams[at], text[at]


def _places(batches):
    """(window, _id, _th, at, line) of the windows with a repeated fingerprint and words that are left."""
    for batch in batches:
        prints, gone = batch.column(3), batch.column(4)
        for first, texts in text_slices(batch):
            h, places, of, nth = _lines(texts)
            if len(h) < SPAN:
                continue
            n = np.diff(places)
            text, line = np.repeat(of, n), np.repeat(nth, n)
            _, whole, least, inside = _windows(h, text)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            left, hit = np.ones(len(h), bool), np.zeros(len(whole), bool)
            for i, (lo, hi) in enumerate(itertools.pairwise(cuts)):
                if hi - lo >= SPAN:
                    if (lines := gone[first + i].as_py()) is not None:
                        left[lo:hi] = ~np.isin(line[lo:hi], lines)
                    known = np.frombuffer(prints[first + i].as_buffer(), U)
                    hit[lo : hi - SPAN + 1] = np.isin(least[lo : hi - SPAN + 1] >> U(24), known)
            total = np.concatenate(([0], np.cumsum(left)))
            at = np.flatnonzero(hit & inside & (total[SPAN:] > total[:-SPAN]))
            own = text[at]
            ids, th = (batch.column(c).slice(first, len(texts)).to_numpy()[own] for c in (0, 2))
            columns = (whole[at].view(np.int64), ids, th, at - np.array(cuts)[own], line[at].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["window", "_id", "_th", "at", "line"])
    handed_back()


def _key(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th")]


def _gone(lines: DataFrame) -> DataFrame:
    return lines.filter("removed").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("line").alias("_gone"))


def spans(docs: DataFrame, lines: DataFrame, prints: DataFrame) -> DataFrame:
    """(_id, _th, line, from_word, to_word, first, component_id) of the runs to cut: words from_word up to
    to_word of the document; `lines` are its removed paragraphs, `prints` its repeated fingerprints."""
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(*_key(docs), F.col("text").cast("binary").alias("text"))
    found = texts.join(prints.withColumnRenamed("doc_id", "_id"), "_id").join(_gone(lines), ["_id", "_th"], "left")
    places = staged(found.select("_id", "text", "_th", "prints", "_gone").mapInArrow(_places, "window bigint, _id bigint, _th bigint, at bigint, line bigint"), "windows")
    first = places.groupBy("window").agg(F.min(F.struct("_id", "_th", "at", "line")).alias("o"), F.count("*").alias("n")).filter("n > 1").select("window", "o")
    later = (
        places.join(staged(first, "first"), "window")
        .filter("_id <> o._id OR _th <> o._th OR at <> o.at")
        .groupBy("_id", "_th", "at")
        .agg(F.first(F.struct("line", "o", F.shiftrightunsigned("window", 1).alias("component_id"))).alias("v"))
    )
    order = W.partitionBy("_id", "_th").orderBy("at")
    begins = F.coalesce(F.col("at") > F.lag("at").over(order) + SPAN, F.lit(True))
    return (
        later.withColumn("_new", begins.cast("int"))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy("_id", "_th", "_run")
        .agg(F.min("at").alias("from_word"), (F.max("at") + SPAN).alias("to_word"), F.min_by("v", "at").alias("v"))
        .select("_id", "_th", F.col("v.line").cast("int").alias("line"), "from_word", "to_word", F.col("v.o").alias("first"), "v.component_id")
    )


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, line, n_words, component_id, first_doc_id, first_line, removed) of every paragraph
    that occurs more than once, exactly or nearly; and the documents' repeated fingerprints."""
    places, labels, prints = linked(docs, read_paragraphs, min_hash_bands)
    places = places.filter("doc_id IS NOT NULL").select("doc_id", "th", "line", F.col("size").cast("int").alias("n_words"), F.col("node").alias("paragraph"))
    named = places.join(labels.withColumnRenamed("node", "paragraph"), "paragraph", "left").withColumn("component_id", F.coalesce("component", "paragraph"))
    first = (
        named.groupBy("component_id")
        .agg(F.min(F.struct("doc_id", "th", "line")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    out = named.join(first, "component_id").withColumn("_at_first", (F.col("doc_id") == F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("line") == F.col("first.line")))
    # repeated rows of one document stand at the same place: one of them is the first
    nth = F.row_number().over(W.partitionBy("component_id", "doc_id", "th", "line").orderBy("paragraph"))
    out = out.select(
        "doc_id",
        "th",
        "line",
        "n_words",
        "component_id",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line").alias("first_line"),
        (~F.col("_at_first") | (nth > 1)).alias("removed"),
    )
    return staged(out, "lines"), prints


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n_words, component_id, first_doc_id, first_line, removed, from_word, to_word, cut):
    the repeated paragraphs, of which the `removed` go as whole lines, and the spans, which are `cut`:
    the words from_word up to to_word go, the first of them on `line`."""
    lines, prints = repeated_lines(docs)
    runs = spans(docs, lines, prints).select(
        F.col("_id").alias("doc_id"), "line", (F.col("to_word") - F.col("from_word")).cast("int").alias("n_words"), "component_id",
        F.col("first._id").alias("first_doc_id"), F.col("first.line").cast("int").alias("first_line"), F.lit(False).alias("removed"), "from_word", "to_word", F.lit(True).alias("cut"),
    )
    none = F.lit(None).cast("long")
    return lines.drop("th").select("*", none.alias("from_word"), none.alias("to_word"), F.lit(False).alias("cut")).unionByName(runs)


def _without(text: str | None, gone: list[int] | None, runs) -> str | None:
    """text without the lines `gone` and the words of the runs; a line whose words all go goes too."""
    if text is None:
        return None
    gone, flags = set(gone or ()), bytearray(max(r["to_word"] for r in runs))
    for r in runs:
        flags[r["from_word"] : r["to_word"]] = b"\1" * (r["to_word"] - r["from_word"])
    out, word = [], 0
    for n, line in enumerate(text.encode().split(b"\n")):
        starts = [m.start() for m in TOKEN.finditer(line)]
        own = flags[word : word + len(starts)].ljust(len(starts), b"\0")
        word += len(starts)
        if n in gone or starts and all(own):
            continue
        if any(own):
            ends = [*starts[1:], len(line)]
            line = line[: starts[0]] + b"".join(line[a:b] for a, b, cut in zip(starts, ends, own, strict=True) if not cut)
        out.append(line)
    return b"\n".join(out).decode()


def apply(docs: DataFrame) -> DataFrame:
    """docs with the removed paragraphs and the spans cut from `text`; rows that share a doc_id and text lose the same lines."""
    lines, prints = repeated_lines(docs)
    runs = spans(docs, lines, prints).groupBy("_id", "_th").agg(F.collect_list(F.struct("from_word", "to_word")).alias("_runs"))
    names = docs.columns
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *_key(docs)).join(_gone(lines), ["_id", "_th"], "left").join(runs, ["_id", "_th"], "left")
    split = F.split(F.col("_row.text"), "\n", -1)
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    cut = F.udf(_without, "string")(F.when(F.col("_runs").isNotNull(), F.col("_row.text")), "_gone", "_runs")
    text = F.when(F.col("_runs").isNotNull(), cut).when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(kept)
    return joined.select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in names])


def query(docs: DataFrame) -> DataFrame:
    return duplicates(docs)
