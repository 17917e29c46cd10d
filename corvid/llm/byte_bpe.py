"""Byte-level BPE encoding and decoding.

Texts are split by the pre-tokeniser pattern and each distinct word is encoded once by ranked
merges; documents are assembled from the ids of their words by array gathers, and decoding
concatenates the byte strings of the ids. Distinct words are those of a block of documents and of
the task's memo, so nothing is shuffled: distinct words of the whole corpus would have to be joined
back to every occurrence.

Two ways to merge give the same ids. ``method="merge"`` merges in the Python stage that splits the
texts. ``method="fold"`` hands the distinct words to Spark higher-order functions, which fold ranked
merges over arrays of byte strings with ranks from one literal map (sharded by CRC-32, because Spark
searches a map from front to back); it takes several times the CPU, as the README records, so it is
not the default. Words of more than ``FOLD_BYTES`` bytes, for which arrays take quadratic time, are
merged with a heap either way.

In the fold, bytes are held as strings of the characters U+0000 to U+00FF, one for each byte.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are each
encoded; kept columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import Shipped, returns_memory

SHARDS = 1 << 16
FOLD_BYTES = 64
BLOCK_BYTES = 4 << 20
#: Words of one generation that a task remembers; words in use move on to the next one.
MEMO_WORDS = 100_000
NONE = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a foldable ``array<map<string,int>>``: shard ``crc32(piece) mod SHARDS``."""
    shards: list[dict[str, int] | None] = [None] * SHARDS
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        k = zlib.crc32(key.encode()) % SHARDS
        shards[k] = (shards[k] or {}) | {key: rank}
    return F.from_json(F.lit(json.dumps(shards, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(word: Column, ranks: Column) -> Column:
    """Ids of one word: the leftmost adjacent pair of lowest rank is merged until none has a rank."""
    none = F.lit(NONE)

    def rank(piece: Column) -> Column:
        shard = F.get(ranks, F.pmod(F.crc32(piece), F.lit(SHARDS)).cast("int"))
        return F.coalesce(F.try_element_at(shard, piece), none)

    def merged(state: Column, least: Column) -> Column:
        pieces, pairs = state["pieces"], state["pairs"]

        def at(i: Column) -> Column:
            def joined(new: Column) -> Column:
                left = F.when(i > 1, F.array(rank(F.concat(F.get(pieces, i - 2), new)))).otherwise(F.array().cast("array<int>"))
                right = F.when(i < F.size(pairs), F.array(rank(F.concat(new, F.get(pieces, i + 1))))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(pieces, F.lit(1), i - 1), F.array(new), F.slice(pieces, i + 2, F.size(pieces))).alias("pieces"),
                    F.concat(F.slice(pairs, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(pairs, i + 2, F.size(pairs))).alias("pairs"),
                )

            return _let(F.concat(F.get(pieces, i - 1), F.get(pieces, i)), joined)

        return _let(F.array_position(pairs, least).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return _let(F.coalesce(F.array_min(state["pairs"]), none), lambda least: F.when(least == none, state).otherwise(merged(state, least)))

    n = F.length(word)
    start = F.struct(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1))).alias("pieces"),
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2)))).alias("pairs"),
    )
    folded = F.aggregate(F.sequence(F.lit(2), n), start, step, lambda state: F.transform(state["pieces"], rank))
    return _let(rank(word), lambda whole: F.when(whole != none, F.array(whole)).otherwise(folded))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > FOLD_BYTES:
        return heap_merge(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == NONE:
            break
        i = pairs.index(least)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(pieces[i] + pieces[i + 1], NONE)
        if i:
            pairs[i - 1] = ranks.get(pieces[i - 1] + pieces[i], NONE)
    return [ranks[p] for p in pieces]


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word in O(n log n): the same merges, taken from a heap of (rank, place)."""
    n = len(word)
    if word in ranks:
        return [ranks[word]]
    end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


def _split_blocks(pattern: str, text: str, keep: list[str]):
    """Documents to blocks: kept columns, words of each document as numbers, distinct words."""

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        for batch in batches:
            texts = batch.column(text)
            kept = pa.StructArray.from_arrays([batch.column(c) for c in keep], names=[f"k{k}" for k in range(len(keep))])
            first = 0
            while first < len(texts):
                words: dict[str, int] = {}
                counts, numbers, size, last = [], [], 0, first
                while last < len(texts) and (last == first or size < BLOCK_BYTES):
                    value = texts[last].as_py() or ""
                    found = find(value)
                    numbers.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                    counts.append(len(found))
                    size += len(value)
                    last += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), kept.slice(first, last - first)),
                        pa.array([np.array(counts, np.int32).tobytes()], pa.binary()),
                        pa.array([np.concatenate(numbers).tobytes()], pa.binary()),
                        pa.array([[w.encode().decode("latin-1") for w in words]], pa.list_(pa.string())),
                    ],
                    names=["kept", "counts", "numbers", "words"],
                )
                first = last

    return run


def _gather(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``values[offsets[p]:offsets[p + 1]]`` of all picks, end to end, and their lengths."""
    sizes = offsets[pick + 1] - offsets[pick]
    stops = np.cumsum(sizes)
    at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(offsets[pick] - (stops - sizes), sizes)
    return values[at], sizes


class Vocabulary:
    """Byte strings of all ids, end to end."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64)))
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenation of the pieces, by runs of ids that fit in memory."""
        return b"".join(_gather(self.bytes, self.offsets, ids[k : k + (1 << 18)])[0].tobytes() for k in range(0, len(ids), 1 << 18))


def _assemble(holder, keep: list[str], output):
    """Blocks back to documents: ``output(ids, vocabulary)`` gives the columns of each."""

    def run(batches):
        vocabulary = holder.value
        for batch in batches:
            for row in range(batch.num_rows):
                counts = np.frombuffer(batch.column("counts")[row].as_py(), np.int32)
                numbers = np.frombuffer(batch.column("numbers")[row].as_py(), np.int32)
                ids = batch.column("ids")[row].values
                long = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)) if ids is not None else []
                if len(long):
                    words, ids = batch.column("words")[row].as_py(), ids.to_pylist()
                    for k in long.tolist():
                        ids[k] = heap_merge(words[k].encode("latin-1"), vocabulary.ranks)
                    ids = pa.array(ids, pa.list_(pa.int32()))
                if ids is None or not len(ids):
                    values, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
                else:
                    offsets = ids.offsets.to_numpy().astype(np.int64)
                    values, offsets = ids.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
                stops = np.cumsum(counts)
                columns = [output(_gather(values, offsets, numbers[e - n : e])[0], vocabulary) for n, e in zip(counts.tolist(), stops.tolist(), strict=True)]
                kept = batch.column("kept")[row].values
                arrays = [kept.field(c) for c in range(len(keep))] + [pa.array(c) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    return run


class Memo:
    """Ids of words met so far, as bytes, in two generations: what the younger one asks for again outlives the older."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.young, self.old = ranks, {}, {}

    def __call__(self, word: str) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word) or array("i", merge(word.encode(), self.ranks)).tobytes()
            if len(self.young) >= MEMO_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found


def _merge_blocks(holder, pattern: str, text: str, keep: list[str], output):
    """Documents to ``output(ids, vocabulary)`` in one stage."""

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        vocabulary = holder.value
        memo = Memo(vocabulary.ranks)
        for batch in batches:
            texts, columns, first = batch.column(text), [], 0
            while first < len(texts):
                words: dict[str, int] = {}
                numbers, size, last = [], 0, first
                while last < len(texts) and (last == first or size < BLOCK_BYTES):
                    value = texts[last].as_py() or ""
                    found = find(value)
                    numbers.append(np.fromiter([words.setdefault(w, len(words)) for w in found], np.int64, len(found)))
                    size += len(value)
                    last += 1
                ids = [memo(w) for w in words]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
                values = np.frombuffer(b"".join(ids), np.int32)
                columns += [output(_gather(values, offsets, n)[0], vocabulary) for n in numbers]
                first = last
            if columns:
                arrays = [batch.column(c) for c in keep] + [pa.array(c) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    return run


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, keep: list[str], output, added: list[T.StructField], method: str) -> DataFrame:
    fields = [docs.schema[c] for c in keep]
    out = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate([*fields, *added])])
    names = [f.name for f in [*fields, *added]]
    holder = Shipped(docs.sparkSession, Vocabulary(ranks))
    picked = docs.select(*[docs[c] for c in dict.fromkeys([text, *keep])])
    if method == "merge":
        return picked.mapInArrow(returns_memory(_merge_blocks(holder, pattern, text, keep, output)), out).toDF(*names)
    named = T.StructType([T.StructField(f"k{k}", f.dataType) for k, f in enumerate(fields)])
    blocks = T.StructType([
        T.StructField("kept", T.ArrayType(named)),
        T.StructField("counts", T.BinaryType()),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StringType())),
    ])
    split = picked.mapInArrow(returns_memory(_split_blocks(pattern, text, keep)), blocks)
    literal = rank_literal(ranks)
    ids = F.transform("words", lambda w: F.when(F.length(w) <= FOLD_BYTES, fold_word(w, literal)))
    return split.withColumn("ids", ids).mapInArrow(returns_memory(_assemble(holder, keep, output)), out).toDF(*names)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", keep: list[str] | None = None, out: str = "ids", method: str = "merge") -> DataFrame:
    """The kept columns (all but ``text`` unless named) and the ids of each text as ``array<int>``."""
    keep = [c for c in docs.columns if c not in (text, out)] if keep is None else keep
    return _encoded(docs, ranks, pattern, text, keep, lambda ids, _: (ids,), [T.StructField(out, T.ArrayType(T.IntegerType()))], method)


def decode(encoded: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the binary column ``out``; null ids decode to null."""
    holder = Shipped(encoded.sparkSession, Vocabulary(ranks))

    def run(batches):
        for batch in batches:
            column = [None if v is None else holder.value.decode(np.array(v, np.int64)) for v in batch.column(ids).to_pylist()]
            yield from pa.Table.from_batches([batch]).append_column(out, pa.array(column, pa.binary())).to_batches()

    return encoded.mapInArrow(returns_memory(run), T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def _digests(ids: np.ndarray, vocabulary: Vocabulary):
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(vocabulary.decode(ids)).hexdigest())


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", key: str = "doc_id", method: str = "merge") -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded bytes of each text."""
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _encoded(docs, ranks, pattern, text, [key], _digests, added, method)


def _with_ids(ids: np.ndarray, vocabulary: Vocabulary):
    return (ids, len(ids), hashlib.sha256(vocabulary.decode(ids)).hexdigest())


def tokenised(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", key: str = "doc_id", method: str = "merge") -> DataFrame:
    """``key``, the ids of each text, their number and the digest of the bytes that they decode to."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())]
    return _encoded(docs, ranks, pattern, text, [key], _with_ids, added, method)
