"""Components of similar sets that share a signature, without listing all pairs of a group.

1. A task reads texts in slices and deals every signature of a slice's different sets (a *node* is
   a set's hash) in packed blocks to buckets, whose number follows the size of the text; beside them
   go the places of the sets and a parity sketch of each set, which never overstates how many
   elements two sets differ in.
2. In a bucket, the sets of a signature form a star: its least node is the centre, and the others
   are paired with it, so a group of n gives n - 1 pairs.  Pairs are packed, dealt by member and
   counted.  A signature that HOT sets or more of one slice share forms a star in the slice already,
   and its centre alone goes to the bucket; the members are then paired with their centre's centres
   too, so that all sets of a signature still share one.
3. Pairs that pass the sketch are verified by their whole sets: of each member first the one with
   the centre that shares most of its signatures; components are formed, and then the pairs that
   still join two components follow.
4. What is left are members of one star in different components.  Every pair of a group shares its
   centre, so each centre's members are compared, tile by tile, by their sketches; what passes is
   verified.  So the components are those of all similar pairs that share a signature.

A star is split over tiles of TILE members; joins that fetch sets have one row per set on one side,
so that adaptive execution can split the other.  Everything between steps is written to the shared
folder, and dropped when it was read for the last time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, handed_back, staged
from quire.llm.components import components

#: Jaccard of 4/5: |A| >= 4/5 |B|, and |A ^ B| <= (|A| + |B|) / 9.
NUM, DEN = 4, 5
BUCKET_CHARS = 10_000_000
#: Bytes of text that are read at a time.
SLICE = 1 << 20
TILE, TILES_A_GROUP = 2048, 8
#: Sets of a slice with one signature, from which on their centre stands for them in the bucket.
HOT = 64
#: Added to the count of a pair for each signature that a slice's centre stands for.
LOCAL = 1 << 40
SKETCH_LEAST, SKETCH_MOST = 256, 1 << 15
U = np.uint64
#: texts -> (text number, line, size, node or -1, set) of every place, and (print, text number) of every print.
#: The sets are a list, or give one by its number and some as a `Flat` by `picked`.
Reader = Callable[[list], tuple]
#: sets (Flat) -> (signatures, set number of each).
Signer = Callable[["Flat"], tuple]
#: Rows of a place (kind 0), a node with its sketch (1), a block of pairs (2) and one of prints (3).
FOUND = "kind int, doc_id bigint, th bigint, line int, size bigint, node bigint, bucket int, block binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Flat:
    """Sets in one array: the elements of set i are items[places[i] : places[i + 1]]."""

    def __init__(self, items: np.ndarray, places: np.ndarray) -> None:
        self.items, self.places = items, places

    @classmethod
    def of(cls, sets: list[np.ndarray] | Flat) -> Flat:
        return sets if isinstance(sets, Flat) else cls(np.concatenate([np.empty(0, U), *sets]), np.cumsum([0, *map(len, sets)]))

    def __len__(self) -> int:
        return len(self.places) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= len(self):
            raise IndexError(i)
        return self.items[self.places[i] : self.places[i + 1]]


def text_slices(batch: pa.RecordBatch, column: int = 1, size: int = SLICE):
    """(first row, texts) of a batch, about `size` bytes at a time; a longer text is a slice of its own."""
    texts = batch.column(column)
    at, n = 0, len(texts)
    while at < n:
        part, first, held = [], at, 0
        while at < n and held < size:
            part.append(texts[at].as_py())
            held += len(part[-1] or b"")
            at += 1
        yield first, part


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def _by_bucket(where: np.ndarray, columns: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    order = np.argsort(where, kind="stable")
    where, columns = where[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True]))) if len(where) else np.zeros(1, np.int64)
    return {int(where[lo]): [c[lo:hi] for c in columns] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}


SIGNED = (np.uint32, np.uint8, np.int64)
#: Node, elements, bytes of the sketch.
MARKED = (np.int64, np.int64, np.int64)
PLACED = (np.int64, np.uint8, np.int64, np.int32, np.int64, np.int64)


#: Member, centre, signatures that they share.
PAIRS = (np.int64, np.int64, np.int64)


def _pack(*tables: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(t[0]) for t in tables], np.int64).tobytes(), *(c.tobytes() for t in tables for c in t)])


def _unpack(data, *kinds: tuple) -> list[list[np.ndarray]]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, own in zip(sizes.tolist(), kinds, strict=True):
        out.append([])
        for kind in own:
            out[-1].append(np.frombuffer(data, kind, n, at))
            at += out[-1][-1].nbytes
    return out


def _together(column, *kinds: tuple) -> list[list[np.ndarray]]:
    """The tables of all blocks of a column, each joined into one."""
    parts = [_unpack(x.as_buffer(), *kinds) for chunk in column.chunks for x in chunk]
    return [[np.concatenate([p[t][c] for p in parts]) for c in range(len(own))] for t, own in enumerate(kinds)]


def _empty(kinds: tuple) -> list[np.ndarray]:
    return [np.empty(0, k) for k in kinds]


def _short(keys: np.ndarray) -> list[np.ndarray]:
    """The upper 40 bits of keys."""
    return [(keys >> U(32)).astype(np.uint32), ((keys >> U(24)) & U(255)).astype(np.uint8)]


def _long(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(U) << U(8)) | low


def text_hash(text: bytes | None) -> int:
    """Spark's xxhash64 of a text."""
    import xxhash

    h = 42 if text is None else xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def dealt(docs: DataFrame, read: Reader, sign: Signer, buckets: int) -> DataFrame:
    """(bucket, block): the signatures of a slice's different sets, 13 bytes each, its sketches, places and prints."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_slices(batch):
                of, line, size, node, sets, (prints, printed) = read(texts)
                doc = ids.slice(first, len(texts))
                valid, doc = doc.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(doc, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                prints, printed = prints[valid[printed]], doc[printed[valid[printed]]]
                printed = _by_bucket((prints % U(buckets)).astype(np.int64), [*_short(prints), printed])
                th = np.fromiter(map(text_hash, texts), np.int64, len(texts))
                known, doc, th = valid[of], doc[of], th[of]
                use = np.flatnonzero((node >= 0) & known)
                names, at = np.unique(node[use], return_index=True)
                order = np.argsort(names % buckets, kind="stable")
                names, at = names[order], use[at[order]]
                own = sets.picked(at) if hasattr(sets, "picked") else Flat.of([sets[i] for i in at.tolist()])
                keys, owner = sign(own) if len(own) else (np.empty(0, U), np.empty(0, np.int64))
                keys, nodes, near = condensed(keys, names[owner])
                signed = _by_bucket((keys % U(buckets)).astype(np.int64), [*_short(keys), nodes])
                near = _by_bucket(*_dealt_again(near, buckets))
                marks, width = sketches(own)
                end = np.concatenate(([0], np.cumsum(width)))
                marked = _by_bucket(names % buckets, [np.arange(len(names))])
                columns = [doc, known.astype(np.uint8), th, line.astype(np.int32), size.astype(np.int64), node.astype(np.int64)]
                placed = _by_bucket((mix(doc.view(U) + U(1)) % U(buckets)).astype(np.int64), columns)
                where, blocks = sorted({*signed, *marked, *placed, *printed, *near}), []
                for b in where:
                    lo, hi = (marked[b][0][0], marked[b][0][-1] + 1) if b in marked else (0, 0)
                    table = [names[lo:hi], np.diff(own.places[lo : hi + 1]), width[lo:hi]]
                    blocks.append(_pack(signed.get(b) or _empty(SIGNED), table, [marks[end[lo] : end[hi]]], placed.get(b) or _empty(PLACED), printed.get(b) or _empty(SIGNED), near.get(b) or _empty(PAIRS)))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])
        handed_back()

    return texts_of(docs).mapInArrow(rows, "bucket int, block binary")


def condensed(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Signatures to send, their nodes, and (member, centre, n) of the stars of those that HOT nodes or more share."""
    ordered = np.sort(keys)
    hot = np.unique(ordered[HOT - 1 :][ordered[HOT - 1 :] == ordered[: len(ordered) - HOT + 1]]) if len(ordered) >= HOT else ordered[:0]
    if not len(hot):
        return keys, nodes, tuple(_empty(PAIRS))
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    own = np.flatnonzero(hot[at] == keys)
    centre = np.full(len(hot), np.iinfo(np.int64).max)
    np.minimum.at(centre, at[own], nodes[own])
    apart = nodes[own] != centre[at[own]]
    keep = np.ones(len(keys), bool)
    keep[own[apart]] = False
    own = own[apart]
    return keys[keep], nodes[keep], counted(nodes[own], centre[at[own]], np.full(len(own), LOCAL + 1))


def stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, centre, signatures they share) of every signature's star."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    hit = again[at] == keys
    keys, nodes = keys[hit], nodes[hit]
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    start = np.concatenate(([True], keys[1:] != keys[:-1]))
    fresh = start | np.concatenate(([True], nodes[1:] != nodes[:-1]))
    centre = nodes[np.flatnonzero(start)][np.cumsum(start) - 1]
    keep = fresh & (nodes != centre)
    return counted(nodes[keep], centre[keep], np.ones(int(keep.sum()), np.int64))


def counted(member: np.ndarray, centre: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(member):
        return member, centre, n
    order = np.lexsort((centre, member))
    member, centre, n = member[order], centre[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], (member[1:] != member[:-1]) | (centre[1:] != centre[:-1]))))
    return member[starts], centre[starts], np.add.reduceat(n, starts)


def again(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the keys that stand twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = twice[at] == keys if len(twice) else np.zeros(len(keys), bool)
    return docs[hit], keys[hit]


def _dealt_again(columns: tuple, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    return (mix(columns[0].view(U)) % U(buckets)).astype(np.int64), list(columns)


def swept(blocks: DataFrame, buckets: int) -> DataFrame:
    """The places, each different node's size and sketch, and the stars' pairs in blocks by member."""

    def sweep(key, table):
        parts = _together(table.column("block"), SIGNED, MARKED, (np.uint8,), PLACED, SIGNED, PAIRS)
        (high, low, nodes), (name, n, width), (raw,), (doc, known, th, line, size, node), (*prints, printed), near = parts
        both = counted(*(np.concatenate(c) for c in zip(stars(_long(high, low), nodes), near, strict=True)))
        packed = _by_bucket(*_dealt_again(both, buckets))
        twice = _by_bucket(*_dealt_again(again(_long(*prints), printed), buckets))
        end = np.cumsum(width)
        _, one = np.unique(name, return_index=True)
        ends = np.cumsum(width[one])
        marks = raw[np.arange(ends[-1] if len(one) else 0) + np.repeat(end[one] - ends, width[one])]
        marks = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(marks)])
        m, k = len(doc), len(one)
        where, blocks_ = [*packed, *twice], [_pack(c) for c in (*packed.values(), *twice.values())]
        rest = k + len(where)
        own = [
            pa.array(np.repeat(np.arange(4, dtype=np.int32), (m, k, len(packed), len(twice)))),
            pa.array(np.concatenate((doc, np.zeros(rest, np.int64))), mask=np.concatenate((known == 0, np.ones(rest, bool)))),
            pa.array(np.concatenate((th, np.zeros(rest, np.int64)))),
            pa.array(np.concatenate((line, np.zeros(rest, np.int32)))),
            pa.array(np.concatenate((size, n[one], np.zeros(len(where), np.int64)))),
            pa.array(np.concatenate((node, name[one], np.zeros(len(where), np.int64)))),
            pa.concat_arrays([pa.nulls(m + k, pa.int32()), pa.array(where, pa.int32())]),
            pa.concat_arrays([pa.nulls(m, pa.binary()), marks, pa.array(blocks_, pa.binary())]),
        ]
        handed_back()
        return pa.Table.from_arrays(own, ["kind", "doc_id", "th", "line", "size", "node", "bucket", "block"])

    return blocks.groupBy("bucket").applyInArrow(sweep, FOUND)


def candidates(found: DataFrame) -> DataFrame:
    """(a, b, shared, local): each member with each of its centres; local: one that stands for it in a bucket."""

    def merge(key, table):
        member, centre, n = counted(*_together(table.column("block"), PAIRS)[0])
        return pa.table({"a": member, "b": centre, "shared": n % LOCAL, "local": n >= LOCAL})

    return found.filter("kind = 2").select("bucket", "block").groupBy("bucket").applyInArrow(merge, "a bigint, b bigint, shared bigint, local boolean")


def with_further_centres(pairs: DataFrame) -> DataFrame:
    """Adds each member's pairs with the centres of the centre that stood for it."""
    near = pairs.filter("local").select("a", F.col("b").alias("c"))
    if near.isEmpty():
        return pairs
    more = near.join(pairs.select(F.col("a").alias("c"), "b"), "c").select("a", "b").filter("a <> b").distinct()
    more = more.join(pairs, ["a", "b"], "left_anti").select("a", "b", F.lit(0).cast("long").alias("shared"), F.lit(False).alias("local"))
    out = staged(pairs.unionByName(more), "pairs")
    dropped(pairs)
    return out


def repeated_prints(found: DataFrame) -> DataFrame:
    """(doc_id, prints): the prints of a document that stand twice or more in all documents, 40 bits each."""

    def merge(key, table):
        ((doc, print_),) = _together(table.column("block"), (np.int64, U))
        order = np.argsort(doc, kind="stable")
        doc, print_ = doc[order], print_[order]
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))).tolist()
        lists = [np.unique(print_[lo:hi]).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"doc_id": doc[cuts[:-1]], "prints": pa.array(lists, pa.binary())})

    return found.filter("kind = 3").select("bucket", "block").groupBy("bucket").applyInArrow(merge, "doc_id bigint, prints binary")


def passing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs that may be similar by their sketches."""

    def close(batches):
        for batch in batches:
            n, m, x, y = (batch.column(c) for c in ("n", "m", "x", "y"))
            n, m, keep = n.to_numpy(), m.to_numpy(), np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)).tolist():
                p, q = np.frombuffer(x[i].as_buffer(), U), np.frombuffer(y[i].as_buffer(), U)
                width = min(len(p), len(q))
                p, q = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (p, q))
                keep[i] = 9 * int(np.bitwise_count(p ^ q).sum()) <= n[i] + m[i]
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["a", "b", "shared"]).filter(pa.array(keep))
        handed_back()

    own, of = marks.toDF("a", "n", "x"), marks.toDF("b", "m", "y")
    joined = pairs.select("a", "b", "shared").join(own, "a").join(of, "b").select("a", "b", "shared", "n", "m", "x", "y")
    return joined.mapInArrow(close, "a bigint, b bigint, shared bigint")


def sets_of(docs: DataFrame, places: DataFrame, nodes: DataFrame, read: Reader) -> DataFrame:
    """(node, items): the sets of the nodes, each read from one document that holds it."""
    lead = places.filter("doc_id IS NOT NULL").select("doc_id", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = lead.groupBy("doc_id").agg(F.collect_list("node").alias("wanted"))

    def rows(batches):
        for batch in batches:
            own = batch.column(2)
            for first, texts in text_slices(batch):
                of, _, _, node, sets, _ = read(texts)
                names, items, seen = [], [], set()
                asked = [set(own[first + i].as_py()) for i in range(len(texts))]
                for i, (t, x) in enumerate(zip(of.tolist(), node.tolist(), strict=True)):
                    if x in asked[t] and x not in seen:
                        seen.add(x)
                        names.append(x)
                        items.append(sets[i].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])
        handed_back()

    return texts_of(docs).join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(rows, "node bigint, items binary")


def verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, read: Reader) -> DataFrame:
    """(a, b): the pairs whose sets have Jaccard 0.8 or more, by their whole sets."""

    pairs = pairs.select("a", "b")

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True)) if DEN * min(len(p), len(q)) >= NUM * max(len(p), len(q)) else 0
                keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        handed_back()

    if pairs.isEmpty():
        return pairs
    nodes = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    sets = staged(sets_of(docs, places, nodes, read), "sets")
    joined = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    )
    good = staged(joined.select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint"), "links")
    dropped(sets)
    return good


def sketches(sets: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(sketches of the sets in turn, bytes of each).  A sketch holds the parities of the elements in each cell:
    two sets differ in as many elements as cells, or more."""
    n = np.diff(sets.places)
    cells = np.full(len(n), SKETCH_LEAST)
    while (more := cells < np.minimum(2 * n, SKETCH_MOST)).any():
        cells[more] *= 2
    width = cells // 8
    cell = (sets.items & np.repeat((cells - 1).astype(U), n)).astype(np.int64)
    out = np.zeros(int(width.sum()), np.uint8)
    np.bitwise_xor.at(out, np.repeat(np.cumsum(width) - width, n) + (cell >> 3), (128 >> (cell & 7)).astype(np.uint8))
    return out, width


def sketch(items: np.ndarray) -> bytes:
    """The sketch of one set."""
    return sketches(Flat.of([items]))[0].tobytes()


def _folded(marks: list[bytes]) -> np.ndarray:
    """Sketches as words, all of the least width: a wide one is folded, as cells are low bits."""
    width, out = min(map(len, marks)), np.empty((len(marks), min(map(len, marks)) // 8), U)
    for i, m in enumerate(marks):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(m, U).reshape(-1, width // 8), axis=0)
    return out


def _close(left: list[int], right: list[int], label: np.ndarray, node: np.ndarray, n: np.ndarray, marks: list[bytes]):
    """Pairs (left, right) of different components that may be similar."""
    x, y = np.array(left), np.array(right)
    words = _folded([marks[i] for i in (*left, *right)])
    a, b = words[: len(x)], words[len(x) :]
    for lo in range(0, len(x), strip := max(1, (1 << 16) // max(1, len(y)))):
        own = x[lo : lo + strip]
        i, j = np.nonzero((label[own][:, None] != label[y]) & (DEN * np.minimum(n[own][:, None], n[y]) >= NUM * np.maximum(n[own][:, None], n[y])))
        apart = np.bitwise_count(a[lo + i] ^ b[j]).sum(axis=1, dtype=np.int64)
        ok = 9 * apart <= n[own[i]] + n[y[j]]
        yield node[own[i[ok]]], node[y[j[ok]]]


def residual(pairs: DataFrame, labels: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b): pairs of one star in different components that pass the sketch; the centre's own pairs
    have been verified.  Members out of the centre's component are tiled against all members."""
    own = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
    of = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
    named = pairs.select("a", "b").join(own, "a", "left").join(of, "b", "left")
    label = F.coalesce("la", "a")
    members = staged(named.select("b", "a", label.alias("label"), (label != F.coalesce("lb", "b")).alias("odd")), "members")
    counts = members.groupBy("b").agg(F.count_if("odd").alias("odds"), F.count("*").alias("all")).filter("odds > 0 AND all > 1")
    tiled = members.join(counts, "b").join(marks.withColumnRenamed("node", "a"), "a")
    h = F.xxhash64("a", "b")
    tile = F.floor((F.col("odds") - 1) / TILE), F.floor((F.col("all") - 1) / TILE)
    right = F.transform(F.sequence(F.lit(0), tile[0]), lambda i: F.struct(i.alias("i"), F.pmod(h, tile[1] + 1).alias("j"), F.lit(False).alias("left")))
    left = F.transform(F.sequence(F.lit(0), tile[1]), lambda j: F.struct(F.pmod(h, tile[0] + 1).alias("i"), j.alias("j"), F.lit(True).alias("left")))
    both = F.when(F.col("odd"), F.concat(left, right)).otherwise(right)
    spread = tiled.select("b", "a", "label", "n", "marks", F.explode(both).alias("t")).select("b", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.left").alias("left"), "a", "label", "n", "marks")
    total = members.count()
    spread = spread.withColumn("group", F.pmod(F.xxhash64("b", "i", "j"), F.lit(max(16, total // (TILES_A_GROUP * TILE)))))

    def compared(key, table):
        table = table.sort_by([("b", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        label, node, n = (table.column(c).to_numpy() for c in ("label", "a", "n"))
        side, marks_ = table.column("left").to_numpy(), table.column("marks").to_pylist()
        at = np.stack([table.column(c).to_numpy() for c in ("b", "i", "j")])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            where = np.arange(lo, hi)
            for x, y in _close(where[side[lo:hi]].tolist(), where[~side[lo:hi]].tolist(), label, node, n, marks_) if side[lo:hi].any() and not side[lo:hi].all() else ():
                xs.append(np.minimum(x, y))
                ys.append(np.maximum(x, y))
        x, y, _ = counted(np.concatenate(xs), np.concatenate(ys), np.ones(sum(map(len, xs)), np.int64))
        del table, marks_
        handed_back()
        return pa.table({"a": x, "b": y})

    out = staged(spread.groupBy("group").applyInArrow(compared, "a bigint, b bigint").distinct(), "close")
    dropped(members)
    return out


def linked(docs: DataFrame, read: Reader, sign: Signer, chars: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places (doc_id, th, line, size, node) of every text, node null for an empty set and th the text's
    hash; the (node, component) of nodes that are linked with others; and the documents' repeated
    prints.  Places of null doc_ids link nothing."""
    docs = docs.select("doc_id", "text")
    if chars is None:
        chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, chars // BUCKET_CHARS)
    found = staged(swept(dealt(docs, read, sign, buckets), buckets), "sweep")
    places = found.filter("kind = 0").select("doc_id", "th", "line", "size", F.when(F.col("node") >= 0, F.col("node")).alias("node"))
    marks = found.filter("kind = 1").select("node", F.col("size").alias("n"), F.col("block").alias("marks"))
    held = places.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    pairs = with_further_centres(staged(candidates(found), "pairs"))
    close = staged(passing(pairs, marks), "close")
    best = close.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    labels, none = None, docs.sparkSession.createDataFrame([], "node bigint, component bigint")

    def joined(good: DataFrame) -> DataFrame:
        if good.isEmpty():
            return labels or none
        edges = good if labels is None else good.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return staged(components(edges), "labels")

    labels = joined(verified(best, docs, held, read))
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    apart = close.join(best.withColumn("tried", F.lit(True)), ["a", "b"], "left").join(a, "a", "left").join(b, "b", "left")
    apart = apart.filter("tried IS NULL").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    labels = joined(verified(staged(apart, "apart"), docs, held, read))
    left = residual(pairs, labels, marks)
    labels = joined(verified(left, docs, held, read))
    dropped(pairs, close, left)
    return places, labels, repeated_prints(found)
