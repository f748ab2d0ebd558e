"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds its distinct 5-word shingles.  Sizes fall into bands; two sets with Jaccard
0.8 or more meet in the larger one's band, as the smaller joins the next band too where it is
large enough.  Two such sets of a band differ in at most k = 2 * largest / 9 elements.

The feature domain is cut into n1 parts of CELLS cells each.  A set's signatures are, for each part,
the hashes of its elements in every subset of CELLS - 1 of the part's cells.  At most k / 2 parts hold
two differences or more, so at least spare + 1 of n1 = k / 2 + 1 + spare parts hold one or none,
and there the subset without the differing cell is the same for both.  Empty subsets would be
everybody's signature and are left out: a part is weak for a set if its elements there lie in one cell
or none.  A set with no more than `spare` weak parts has a filled common signature with every
similar set.  A set with more takes part in a further round, in which the domain is cut anew, and so
on until it has few enough; similar sets meet in the last round of the one that ends first.
So no similar pair is left without a common signature, and no signature is empty.

Sets that share a signature are joined as in `stars`: exact components, not all pairs of a group.
Exact copies are one set from the start.

Defined cases: null, empty or blank text has an empty set and is linked with nothing, its component
is its own doc_id; a text of 1 to 4 words has its word sequence as its one shingle; rows with the
same doc_id each get a row, with the component of their sets' joint links; a null doc_id keeps a
null component and links nothing.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import coded_words, staged, worker_cache
from quire.llm.components import components
from quire.llm.stars import DEN, NUM, linked, mix

WORDS = 5
CELLS = 3
CACHED_WORDS = 150_000
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
NO_PRINTS = np.empty(0, U), np.empty(0, np.int64)


class Hashes(dict):
    """Word to 64-bit hash, kept for the frequent words that come first."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words in turn, ASCII capitals folded, and where each text's begin (one more place)."""
    known = worker_cache("hashes", Hashes)
    words, numbers, places = coded_words(texts)
    return np.fromiter(map(known.__getitem__, words), U, len(words))[numbers], places


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the WORDS words from each place on; those at the end of a text run into the next."""
    whole = np.full(max(0, len(h) - WORDS + 1), U(WORDS))
    for j in range(WORDS):
        whole = mix(whole * STEP + h[j : len(h) - WORDS + 1 + j]) if len(whole) else whole
    return whole


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    h, places = hashed_words([t.lower() if t else b"" for t in texts])
    whole, out = shingles(h), []
    for a, b in itertools.pairwise(places.tolist()):
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        else:
            acc = np.full(min(1, b - a), U(b - a))
            for j in range(a, b):
                acc = mix(acc * STEP + h[j : j + 1])
            out.append(acc)
    return out


def read_sets(texts: list[bytes | None]) -> tuple:
    """One place per text: its set, named by the set's hash."""
    import xxhash

    sets = shingle_sets(texts)
    n = len(sets)
    node = np.fromiter((xxhash.xxh3_64_intdigest(x) >> 1 if len(x) else -1 for x in sets), np.int64, n)
    return np.arange(n), np.zeros(n, np.int32), np.fromiter(map(len, sets), np.int64, n), node, sets, NO_PRINTS


def starts(most: int = 1 << 40) -> np.ndarray:
    """The least size of every band."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] + out[-1] // 2))
    return np.array(out, np.int64)


def enough(size: float, parts: int, spare: int) -> float:
    """Share of the sets of a size with no more than `spare` weak parts, about."""
    filled = 1 - math.exp(-size / (parts * CELLS))
    weak = (1 - filled) ** CELLS + CELLS * filled * (1 - filled) ** (CELLS - 1)
    # a binomial's tail by the normal one
    return max(1e-9, 0.5 * math.erfc((parts * weak - spare - 0.5) / math.sqrt(2 * parts * weak * (1 - weak))))


def scheme(band: int) -> tuple[int, int]:
    """(parts, spare) of a band, those of the fewest signatures over all rounds; no parts where only equal sets are similar."""
    low, largest = int(starts()[band]), int(starts()[band + 1]) - 1
    k = 2 * largest // 9
    if k == 0:
        return 0, 0
    least = -(-NUM * low // DEN)
    sizes = [least + (largest - least) * i / 8 for i in range(9)]
    best = (math.inf, 0, 0)
    for spare in range(0, k + 2, max(1, k // 64)):
        parts = k // 2 + 1 + spare
        best = min(best, (sum(parts / enough(n, parts, spare) for n in sizes), parts, spare))
        if parts > 3 * best[1]:
            break
    return best[1:]


def _schemes(band: np.ndarray) -> np.ndarray:
    names, at = np.unique(band, return_inverse=True)
    return np.array([scheme(b) for b in names.tolist()], np.int64).reshape(-1, 2).T[:, at]


def _signed(sets: list[np.ndarray], band: np.ndarray, of: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, entry of each, whether an entry needs a further round): entry i is the set of[i] in band[i]."""
    parts, spare = _schemes(band)
    lens = np.fromiter((len(sets[i]) for i in of.tolist()), np.int64, len(of))
    items = np.concatenate([sets[i] for i in of.tolist()])
    if turn:
        items = mix(items + U(turn * int(STEP) % 2**64))
    first = np.cumsum(parts * CELLS) - parts * CELLS
    cells = int((parts * CELLS).sum())
    cell = ((items >> U(32)) * np.repeat((parts * CELLS).astype(U), lens)) >> U(32)
    cell = cell.astype(np.int64) + np.repeat(first, lens)
    items = mix(items)
    if turn:
        order = np.argsort(cell, kind="stable")
        cell, items = cell[order], items[order]
    cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sums, filled = np.zeros(cells, U), np.zeros(cells, bool)
    sums[cell[cuts]] = np.add.reduceat(items, cuts)
    filled[cell[cuts]] = True
    sums, filled = sums.reshape(-1, CELLS), filled.reshape(-1, CELLS)
    entry = np.repeat(np.arange(len(of)), parts)
    weak = np.bincount(entry[filled.sum(axis=1) < 2], minlength=len(of))
    part = np.arange(len(entry)) - np.repeat(first // CELLS, parts)
    name = mix(((band[entry].astype(U) * U(64) + U(turn)) << U(40)) + part.astype(U))
    keys, owners = [], []
    whole, count = sums.sum(axis=1, dtype=U), filled.sum(axis=1)
    for left_out in range(CELLS):  # every subset of CELLS - 1 cells
        use = np.flatnonzero(count > filled[:, left_out])
        keys.append(mix((whole[use] - sums[use, left_out]) ^ (name[use] + U(left_out))))
        owners.append(entry[use])
    return np.concatenate(keys), np.concatenate(owners), weak > spare


def part_enum(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, set number of each)."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    low = starts()
    band, of = np.searchsorted(low, sizes, "right") - 1, np.arange(len(sets))
    joins = DEN * sizes >= NUM * low[band + 1]
    band, of = np.concatenate([band, band[joins] + 1]), np.concatenate([of, of[joins]])
    use = _schemes(band)[0] > 0
    band, of = band[use], of[use]
    keys, owners, turn = [np.empty(0, U)], [np.empty(0, np.int64)], 0
    while len(of):
        k, entry, more = _signed(sets, band, of, turn)
        keys.append(k)
        owners.append(of[entry])
        band, of, turn = band[more], of[more], turn + 1
    return np.concatenate(keys), np.concatenate(owners)


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) for every row; n_copies: rows with an equal set, itself included."""
    places, labels, _ = linked(docs, read_sets, part_enum)
    own = places.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    # a doc_id whose rows differ joins their sets
    same = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    both = staged(same.select("a", "b").unionByName(own.join(same, "doc_id").select(F.col("node").alias("a"), "b")), "joint")
    if not both.isEmpty():
        labels = staged(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(both)), "labels")
    named = own.join(labels, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("node", "component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    # a row per different set; a component's least document is taken over these
    head = least.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    of = staged(least.join(head, "component").select("node", "component_id", "n_copies").filter("n_copies > 1 OR component_id <> least"), "classes")
    rows = places.join(of, "node", "left")
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("node").isNotNull(), F.coalesce("n_copies", F.lit(1))).alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one whose doc_id names it."""
    kept = joined(docs).filter("doc_id = component_id OR doc_id IS NULL").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def query(docs: DataFrame) -> DataFrame:
    return joined(docs).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
 SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
 FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS h FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.r < b.r
 GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a, least(a, min(b)) AS m FROM c GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(m, s.doc_id) AS component_id FROM s LEFT JOIN m ON s.doc_id = m.a
"""
