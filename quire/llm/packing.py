"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous steps.

Pieces and gaps are held in range-sorted runs: a run is a length with its pieces' ranks, or a gap
size with a range of sequences.  A superstep takes the next shorter length and sweeps the gaps
upwards from its successor; each gap run takes floor(gap / length) pieces per sequence, conflicts
between equal pieces are resolved by rank, the gaps are updated, and the next superstep follows.
That is exactly best-fit decreasing.  Lengths and gaps lie in 1..limit, so the runs are bounded by
the limit and not by the data: the sweep runs on the driver over the histogram of lengths, while
tokens, ranks and placements of pieces stay distributed.

Ranks are counted in salted buckets, so a length that a third of all pieces share is no hot key.

Defined cases: null text is empty and gives one piece that holds only the end token; a repeated
row is packed once for each time it occurs; only documents longer than the limit are cut.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm.common import handed_back, staged, worker_cache

LIMIT = 4096
END = 1
#: Words whose ids a Python worker keeps.
CACHED_WORDS = 600_000
#: Words of letters encoded at a time.
TOGETHER = 200
#: Bytes of text handled at a time.
SLICE = 4 << 20
BUCKET_ROWS = 50_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words, which are kept: their bytes in one column, their ids in another.  ASCII capitals are folded
    first, except beside combining marks, and a mark behind an ASCII letter at a word's end becomes a word
    of its own, as it is for the tokenizer.  Words of letters are encoded many at a time; each
    gives one id that ends a word, and where the count differs (a letter whose lower case is no
    letter), they are encoded one by one.  Texts with special tokens' brackets are encoded whole."""

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words, self.ids, self.places = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._encode(words)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lens.sum())), lens

    def _learned(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words in turn, and how many each has."""
        letters = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        words, n = new.take(pa.array(order)).to_pylist(), int(letters.sum())
        groups = [words[k : k + TOGETHER] for k in range(0, n, TOGETHER) if k < n]
        if groups:
            groups[-1] = groups[-1][: n - TOGETHER * (len(groups) - 1)]
        parts = []
        for own, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            parts.append((ids, np.diff(ends, prepend=-1)) if len(ends) == len(own) else self._one_by_one(own))
        parts.append(self._one_by_one(words[n:]))
        ids, lens = (np.concatenate([p[i] for p in parts]) for i in range(2))
        back = np.argsort(order)
        starts = np.cumsum(lens) - lens
        return _gathered(ids, starts[back], lens[back]), lens[back]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if b"<|" in t}
        plain = [b"" if i in whole else t if b"\xcc" in t or b"\xcd" in t else t.lower() for i, t in enumerate(texts)]
        try:
            column = pa.array(plain, pa.string())
        except (pa.ArrowInvalid, UnicodeDecodeError):
            column = pa.array([t.decode("utf-8", "replace") for t in plain], pa.string())
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(column, r"([a-z])([.,;:!?])(\s|$)", r"\1 \2\3"))
        coded, places = lists.values.dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        at = pc.fill_null(pc.index_in(coded.dictionary, self.words), -1).to_numpy().astype(np.int64)
        ids, starts = self.ids, self.places
        if len(missing := np.flatnonzero(at < 0)):
            new = coded.dictionary.take(pa.array(missing))
            more, lens = self._learned(new)
            at[missing] = len(self.words) + np.arange(len(missing))
            ids = np.concatenate([ids, more])
            starts = np.concatenate([starts, starts[-1] + np.cumsum(lens)])
            if len(self.words) + len(new) <= self.most:
                self.words, self.ids, self.places = pa.concat_arrays([self.words, new]), ids, starts
        own = at[coded.indices.to_numpy()]
        lens = np.diff(starts)[own]
        cuts = 4 * np.concatenate(([0], np.cumsum(lens)))[places]
        data = _gathered(ids, starts[own], lens).astype("<u4").tobytes()
        out = [data[a:b] for a, b in itertools.pairwise(cuts.tolist())]
        for i in whole:
            out[i] = np.array(self._encode([texts[i].decode("utf-8", "replace")])[0], "<u4").tobytes()
        return out


def _gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces of flat from starts on, one behind the other."""
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


def _encoder(path: str) -> WordEncoder:
    """The Python worker's encoder, kept between tasks."""
    return worker_cache(("encoder", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per piece; narrow."""
    path = tokenizer or tokenizer_path()

    def cut(batches):
        encoder = _encoder(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            at, n = 0, len(texts)
            while at < n:
                part, size, first = [], 0, at
                while at < n and size < SLICE:
                    part.append(texts[at].as_py() or b"")
                    size += len(part[-1])
                    at += 1
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc_id, ids in zip(doc_ids.slice(first, at - first).to_pylist(), encoder.batch(part), strict=True):
                    ids += END.to_bytes(4, "little")
                    for k, start in enumerate(range(0, len(ids), 4 * limit)):
                        own = ids[start : start + 4 * limit]
                        for name, value in zip(out, (doc_id, k, start // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                            out[name].append(value)
                types_ = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types_, strict=True)], list(out))
        handed_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Supersteps over the histogram {length: pieces}.  Returns runs (length, first rank, rank
    behind the last, pieces per sequence, first sequence, offset there) and the number of sequences."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
    runs, opened = [], 0
    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0

        def place(gap: int, first: int, sequences: int, length=length) -> tuple[int, int]:
            """Puts the next pieces into sequences that have the gap; how many sequences it used, and pieces."""
            each = gap // length
            whole = min(sequences, left // each)
            rest = left - whole * each if whole < sequences and left - whole * each < each else 0
            for used, first_of, per in ((whole, first, each), (1 if rest else 0, first + whole, rest)):
                if used and gap - per * length:
                    gaps[gap - per * length].append((first_of, used))
            taken = whole * each + rest
            if taken:
                runs.append((length, rank, rank + taken, each, first, limit - gap))
            return whole + (1 if rest else 0), taken

        for gap in range(length, limit):
            if not left:
                break
            ranges, gaps[gap] = gaps[gap], []
            for first, sequences in ranges:
                used, taken = place(gap, first, sequences) if left else (0, 0)
                rank, left = rank + taken, left - taken
                if used < sequences:
                    gaps[gap].append((first + used, sequences - used))
        if left:
            used, taken = place(limit, opened, left)
            opened, rank, left = opened + used, rank + taken, left - taken
    return runs, opened


def packed(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be stored (each rank is counted once)."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `limit` rows
    runs, _ = best_fit(counts, limit)
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    plan = spark.createDataFrame(
        list(by_length.items()),
        "length bigint, runs array<struct<first:bigint,behind:bigint,each:bigint,sequence:bigint,at:bigint>>",
    )
    buckets = max(64, sum(counts.values()) // BUCKET_ROWS)
    salted = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = (
        salted.groupBy("length", "_bucket")
        .count()
        .select(
            "length",
            "_bucket",
            (F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"),
        )
    )
    own = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_own", own).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    # the plan has a row per length, `limit` at most
    run = F.get(F.filter("runs", lambda x: (x["first"] <= F.col("_rank")) & (F.col("_rank") < x["behind"])), F.lit(0))
    placed = ranked.join(F.broadcast(plan), "length").withColumn("_run", run)
    nth = F.col("_rank") - F.col("_run.first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_run.sequence") + F.floor(nth / F.col("_run.each"))).alias("sequence_id"),
        (F.col("_run.at") + nth % F.col("_run.each") * F.col("length")).alias("offset"),
    )


def query(docs: DataFrame) -> DataFrame:
    return packed(staged(pieces(docs), "pieces"))
