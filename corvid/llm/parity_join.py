"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles of ``width`` words, and its identity in the join is a hash of
that set, so copies are one document from the first step on. Each size level has ``parts`` words of a
parity sketch: the 64-bit hash of a shingle picks a part and a bit, and the bit is flipped (XOR). One
shingle flips one bit, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference. A word of few flips has few values, so for keys a shingle flips the bits of its
whole hash: words of parts that no difference touches are still equal, and others are not. Sets that reach the threshold differ by at most ``distance(level)`` shingles, so
of ``parts`` sketch words at least ``parts - distance`` are equal; joining on (level, part, word)
therefore finds every such pair. Levels are geometric bands of set sizes; a pair lies in one band or
in neighbouring ones, so a document is sketched at its own level and at the next.

Sketch words made of few shingles are frequent and say little, so they are keyed only where a
document could match by nothing else: equal words hold equal shingles, so either some equal word is
heavy, or all ``parts - distance`` equal words are light in both documents, and then both key their
light words. The same argument counts: a linked pair shares at least ``need = heavy - distance`` words
of a level, where the distance may be taken for the document's own size.

The steps, all linear in the number of keys but for the last comparison inside buckets:

1. one scan gives each text its set's hash, size and a short parity sketch (folded by XOR); a second
   one packs the keys into tables by a hash of the key. Keys held by one document only go;
2. of the keys that are shared, a document with fewer than ``need`` at a level has no partner there;
   of ``count`` keys it keeps the ``count - need + 1`` rarest, one of which it shares with any partner;
3. inside a bucket, rows whose short sketches are further apart (Hamming) than linked sets can be are
   no candidates; rows without candidates go. Candidate pairs of a bucket make a graph, of which the
   edges of a minimum spanning forest are kept, at most one a row;
4. these pairs are verified on whole sets, and components are formed. Buckets that still hold several
   components then give every candidate pair between these, and all are verified. Large buckets are cut
   into blocks; rows outside a bucket's largest component are compared with all of its blocks.

So no link between components is lost. Links inside components are counted only on demand: blocks of a
component's sets are compared by matrix products, and only counts leave a block.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer
words than ``width`` make one shingle; documents with null ids are left out; rows that repeat a doc_id
are one document, and if their sets differ, the smallest (by size, then by hash) stands for it; an
empty table gives an empty result; ties go to the smallest id; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import Scratch, free_column, materialise, returns_memory, small_batches
from .components import connected_components
from .text_arrays import WordHasher, ascii_lower_table, mix, space_separated, text_blocks, word_spans

#: Shingles of a sketch word below which it counts as light.
LIGHT = 2
#: Keys of one packed table, about, and keys that a scan gathers before it hands tables on.
TABLE_KEYS = 1 << 19
FLUSH_KEYS = 1 << 20
#: Rows of a bucket that are compared with each other at once.
BLOCK = 512
#: Shingles and documents of a block of sets.
BLOCK_SHINGLES = 1 << 17
BLOCK_SETS = 1024
#: Fewest and most words of a short sketch.
SHORT = (4, 16)
#: Ids that are broadcast at most (16 MB).
BROADCAST_IDS = 2_000_000
_KEY_BITS = 40


@dataclass(frozen=True)
class Rule:
    """Shingle width, and the threshold as a fraction: ``over * intersection >= share * union``."""

    width: int = 4
    share: int = 85
    over: int = 100

    def level(self, n: int) -> int:
        """Band of a set size: sizes from ``edge(level)`` up to, not including, ``edge(level + 1)``."""
        k = 0
        while self.edge(k + 1) <= n:
            k += 1
        return k

    def edge(self, k: int) -> int:
        """Smallest size of band ``k``: the least size that no set of band ``k - 1``'s smallest can link with."""
        n = 1
        for _ in range(k):
            n = n * self.over // self.share + 1
        return n

    def distance(self, k: int) -> int:
        """Largest symmetric difference of linked sets that meet at level ``k``."""
        largest = self.edge(k + 1) - 1
        return floor((self.over - self.share) * 2 * largest / (self.over + self.share))

    def parts(self, k: int) -> int:
        """Sketch words of level ``k``.

        More than the distance by about a third, at which random sets of the level's smallest size
        rarely have ``parts - distance`` light words.
        """
        d = self.distance(k)
        return d + 1 + -(-9 * d // 25)

    def words(self, k: int) -> int:
        """Words of a short sketch at level ``k``, a power of two; enough bits that few flips meet where that is cheap."""
        n = SHORT[0]
        while n < SHORT[1] and 8 * n < self.distance(k):
            n *= 2
        return n


class Shingler:
    """Distinct shingle hashes of whole texts, sorted."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.hasher = rule, WordHasher()
        self.lower, self.is_word = ascii_lower_table(), space_separated()

    def __call__(self, texts: pa.Array):
        width = self.rule.width
        for _, _, raw, offsets in text_blocks(texts):
            data = self.lower[raw]
            starts, ends, bounds = word_spans(data, offsets, self.is_word)
            words = self.hasher(data, starts, ends)
            rolled = self._combine([words[k : max(len(words) - width + 1 + k, 0)] for k in range(width)])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n = b - a
                if n >= width:
                    yield np.unique(rolled[a : b - width + 1])
                elif n:
                    yield self._combine([words[a + k : a + k + 1] for k in range(n)])
                else:
                    yield np.zeros(0, np.uint64)

    @staticmethod
    def _combine(words: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(words[0]), len(words), dtype=np.uint64)
        for w in words:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
        return out


class Sketcher:
    """Bucket keys of a shingle set: its own level and the next."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.edges = rule, [rule.edge(0), rule.edge(1)]

    def edge(self, k: int) -> int:
        while len(self.edges) <= k:
            self.edges.append(self.rule.edge(len(self.edges)))
        return self.edges[k]

    def level(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edge(len(self.edges))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys, and for each twice the number of keys of its level that a linked document shares at
        least, plus one at the second level."""
        keys, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        if len(shingles):
            k = self.level(len(shingles))
            for second, level in enumerate((k, k + 1)):
                if self.rule.distance(level):  # else only equal sets link there, and these are one document
                    key, need = self._at(shingles, level)
                    keys.append(key)
                    needs.append(np.full(len(key), 2 * need + second, np.int32))
        return np.concatenate(keys), np.concatenate(needs)

    def short(self, shingles: np.ndarray) -> bytes:
        """Parity sketch over all shingles, as wide as the second level has it; halves XORed give the first level's."""
        bits = 64 * self.rule.words(self.level(len(shingles)) + 1)
        return np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()

    def sketch(self, shingles: np.ndarray, level: int, flips: np.ndarray | None = None):
        """Sketch words that have shingles: part numbers, XORed flips (one bit a shingle unless given), shingles in each."""
        parts = self.rule.parts(level)
        part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        flips = np.uint64(1) << (shingles & np.uint64(63)) if flips is None else flips
        return part[begin], np.bitwise_xor.reduceat(flips, begin), np.diff(np.concatenate((begin, [len(part)]))), parts

    def _at(self, shingles: np.ndarray, level: int) -> tuple[np.ndarray, int]:
        part, word, sizes, parts = self.sketch(shingles, level, mix(shingles))
        heavy = sizes >= LIGHT
        # no partner at this level is larger than the level or than the threshold allows
        n, rule = len(shingles), self.rule
        partner = min(n * rule.over // rule.share, self.edge(level + 1) - 1)
        need = int(heavy.sum()) - (rule.over - rule.share) * (n + partner) // (rule.over + rule.share)
        if need > 0:
            part, word = part[heavy], word[heavy]
        else:
            need = 1
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part, assume_unique=True)
            part, word = np.concatenate((part, empty)), np.concatenate((word, np.zeros(len(empty), np.uint64)))
        return mix(mix(word + np.uint64(level * 1_000_003)) + part * np.uint64(0x9E3779B97F4A7C15)), need


def signature(shingles: np.ndarray) -> int:
    """64-bit hash of a set."""
    xor, total = np.bitwise_xor.reduce(shingles), mix(shingles).sum(dtype=np.uint64)
    return int(mix(np.array([xor + np.uint64(len(shingles))], np.uint64) ^ mix(np.array([total], np.uint64)))[0].view(np.int64))


def _scanned(rule: Rule):
    """``id, n, doc, sketch`` of each text."""

    def run(batches):
        shingler, sketcher = Shingler(rule), Sketcher(rule)
        for batch in batches:
            sizes, signs, sketches = [], [], []
            for shingles in shingler(batch.column("text")):
                sizes.append(len(shingles))
                signs.append(signature(shingles) if len(shingles) else 0)
                sketches.append(sketcher.short(shingles) if len(shingles) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(signs, pa.int64()), pa.array(sketches, pa.binary())], names=["id", "n", "doc", "sketch"])

    return run


_PACKED = "part int, keys binary, owners binary, docs binary, needs binary"


def _packed(rule: Rule, tables: int):
    """Keys of the distinct sets of a task, packed by table: 40 bits of a key, and the number of its owner (a set at a level)."""

    def flush(keys, needs, docs):
        lengths = [len(k) for k in keys]
        key, need, doc = np.concatenate(keys), np.concatenate(needs), np.repeat(np.array(docs, np.int64), lengths)
        part = ((key >> np.uint64(_KEY_BITS)) * np.uint64(tables)) >> np.uint64(64 - _KEY_BITS)
        owner = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (need[1:] != need[:-1])))) - 1
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for rows in np.split(order, cuts):
            _, first, number = np.unique(owner[rows], return_index=True, return_inverse=True)
            low = key[rows].view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8]
            values = [int(part[rows[0]]), low.tobytes(), number.astype(np.uint32).tobytes(), doc[rows[first]].tobytes(), need[rows[first]].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == 0 else pa.binary()) for k, v in enumerate(values)], names=["part", "keys", "owners", "docs", "needs"])

    def run(batches):
        shingler, sketcher = Shingler(rule), Sketcher(rule)
        keys, needs, docs, seen, size = [], [], [], set(), 0
        for batch in batches:
            for shingles in shingler(batch.column("text")):
                if not len(shingles) or (sign := signature(shingles)) in seen:
                    continue
                seen.add(sign)
                key, need = sketcher.keys(shingles)
                if not len(key):
                    continue
                keys.append(key)
                needs.append(need)
                docs.append(sign)
                size += len(key)
                if size >= FLUSH_KEYS:
                    yield from flush(keys, needs, docs)
                    keys, needs, docs, seen, size = [], [], [], set(), 0
        if keys:
            yield from flush(keys, needs, docs)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Rows ``key, doc, need, size`` of the keys that several documents of a packed table hold."""
    keys, docs, needs = [], [], []
    for k, o, d, n in zip(*(table.column(c).to_pylist() for c in ("keys", "owners", "docs", "needs")), strict=True):
        low = np.zeros((len(k) * 8 // _KEY_BITS, 8), np.uint8)
        low[:, : _KEY_BITS // 8] = np.frombuffer(k, np.uint8).reshape(len(low), -1)
        owner = np.frombuffer(o, np.uint32)
        keys.append(low.view(np.uint64).ravel())
        docs.append(np.frombuffer(d, np.int64)[owner])
        needs.append(np.frombuffer(n, np.int32)[owner])
    key, doc, need = np.concatenate(keys), np.concatenate(docs), np.concatenate(needs)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    among = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order, key = order[among], key[among]
    doc, need = doc[order], need[order]
    # copies of a set come from several tasks; a set has a key once
    order = np.lexsort((doc, key))
    key, doc, need = key[order], doc[order], need[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
    key, doc, need = key[fresh], doc[fresh], need[fresh]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((begin, [len(key)])))
    size = np.repeat(size, size)
    many = size > 1
    named = (key[many] | np.uint64(table.column("part")[0].as_py() << _KEY_BITS)).view(np.int64)
    return pa.table({"key": named, "doc": doc[many], "need": need[many], "size": size[many].astype(np.int32)})


def _runs(batches, *names: str):
    """Tables that hold whole runs of equal ``names``, and the bounds of the runs; rows come sorted by them."""

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in names:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        at = bounds(table)
        rest = table.slice(at[-2])
        if len(at) > 2:
            yield table.slice(0, at[-2]).combine_chunks(), at[:-1]
    if rest is not None:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


class Bucket:
    """Compares the rows of buckets by their short sketches."""

    def __init__(self, rule: Rule, table: pa.Table, bounds: np.ndarray) -> None:
        self.rule, self.bounds = rule, bounds
        self.n = table.column("n").to_numpy().astype(np.int64)
        column = table.column("sketch").combine_chunks() if table.num_rows else pa.array([], pa.binary())
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(column.buffers()[2], np.uint8)

    def sketches(self, rows: np.ndarray) -> np.ndarray:
        """Sketches of rows of one bucket width, as rows of words."""
        width = int(self.offsets[rows[0] + 1] - self.offsets[rows[0]])
        return self.data[self.offsets[rows][:, None] + np.arange(width)].view(np.uint64)

    def near(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which sketches can be those of linked sets, and the distances; ``a`` and ``b`` broadcast over all axes but the last."""
        far, rule = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32), self.rule
        total = n + m
        fits = rule.over * np.minimum(n, m) >= rule.share * np.maximum(n, m)
        return fits & (far * (rule.over + rule.share) <= (rule.over - rule.share) * total), far

    def groups(self):
        """Runs of equal size and sketch width, stacked: row numbers of shape (runs, size)."""
        begin, size = self.bounds[:-1], np.diff(self.bounds)
        width = self.offsets[begin + 1] - self.offsets[begin]
        for s, w in {(int(s), int(w)) for s, w in zip(size, width, strict=True) if s > 1}:
            picked = begin[(size == s) & (width == w)]
            at_once = max(1, (1 << 21) // (s * s * w // 8))
            for k in range(0, len(picked), at_once):
                yield picked[k : k + at_once, None] + np.arange(s)

    def candidates(self, rows: np.ndarray):
        """Row numbers of all candidate pairs in stacked runs, by slices of the first member; each pair both ways."""
        for k, ok, _ in self._slices(rows):
            run, i, j = np.nonzero(ok)
            yield rows[run, i + k], rows[run, j]

    def _slices(self, rows: np.ndarray):
        s = self.sketches(rows.ravel()).reshape(*rows.shape, -1)
        n = self.n[rows]
        step = max(1, (1 << 21) // max(1, s.size))
        for k in range(0, rows.shape[1], step):
            ok, far = self.near(s[:, k : k + step, None], s[:, None], n[:, k : k + step, None], n[:, None])
            own = np.arange(ok.shape[1])
            ok[:, own, own + k] = False
            yield k, ok, far

    def forest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers ``child, parent`` of a minimum spanning forest of each stacked run's candidate graph, by distance
        and then by place (Prim's algorithm, a step for all runs at once); a root is its own parent, a row without
        candidates is left out."""
        runs, size = rows.shape
        none = np.int32(1 << 30)
        cost = np.concatenate([np.where(ok, far, none) for _, ok, far in self._slices(rows)], axis=1).astype(np.int32)
        lonely = (cost == none).all(axis=2)
        at, parent = np.arange(runs), np.tile(np.arange(size), (runs, 1))
        least, done = np.full((runs, size), none), np.zeros((runs, size), bool)
        for _ in range(size):
            here = np.where(done, none + 1, least).argmin(axis=1)
            done[at, here] = True
            row = cost[at, here]
            better = (row < least) & ~done
            least = np.where(better, row, least)
            parent = np.where(better, here[:, None], parent)
        run, child = np.nonzero(~lonely)
        return rows[run, child], rows[run, parent[run, child]]


def _joined(rule: Rule):
    """Rows of blocks with ``near``, the id of their parent in the block's forest (their own if none); rows without
    candidates go where the block is the whole bucket."""

    def run(batches):
        for table, bounds in _runs(batches, "key", "part"):
            bucket, ids = Bucket(rule, table, bounds), table.column("id").to_numpy()
            near, keep = ids.copy(), table.column("parts").to_numpy() > 1
            for rows in bucket.groups():
                child, parent = bucket.forest(rows)
                near[child] = ids[parent]
                keep[child] = True
            out = table.append_column("near", pa.array(near)).filter(pa.array(keep))
            yield from out.combine_chunks().to_batches()

    return run


def _across(rule: Rule):
    """Candidate pairs ``a < b`` between components, each once for a batch of buckets."""

    def run(batches):
        for table, bounds in _runs(batches, "key", "part"):
            bucket = Bucket(rule, table, bounds)
            ids, components, probe = (table.column(c).to_numpy() for c in ("id", "component", "probe"))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for rows in bucket.groups():
                for a, b in bucket.candidates(rows):
                    # of a block of a large bucket, only probes meet members
                    ok = (components[a] != components[b]) & ((probe[a] == 0) & (probe[b] == 0) & (ids[a] < ids[b]) | (probe[a] == 1) & (probe[b] == 2))
                    found.append((np.minimum(ids[a[ok]], ids[b[ok]]), np.maximum(ids[a[ok]], ids[b[ok]])))
            pairs = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in range(2)]), axis=1)
            yield from pa.table({"a": pairs[0], "b": pairs[1]}).to_batches()

    return run


def _sets(rule: Rule):
    """``doc, grams``: the sorted shingles of each text as bytes."""

    def run(batches):
        shingler = Shingler(rule)
        for batch in batches:
            docs, sets = [], []
            for shingles in shingler(batch.column("text")):
                docs.append(signature(shingles) if len(shingles) else 0)
                sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], names=["doc", "grams"])

    return run


def _verified(rule: Rule):
    """Pairs with both sets to the pairs that link."""

    def run(batches):
        for batch in batches:
            left, right, keep = batch.column("grams_a"), batch.column("grams_b"), []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.over * common >= rule.share * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(rule: Rule, pairs: bool):
    """Links between the sets of two blocks of a component: their pairs, or each set's number of them."""

    def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        grams = np.concatenate([*x, *y])
        owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
        order = np.argsort(grams, kind="stable")
        column = np.cumsum(np.concatenate(([True], grams[order][1:] != grams[order][:-1]))) - 1
        held = np.bincount(column)
        shared = held[column] > 1
        column, owner = (np.cumsum(held > 1) - 1)[column[shared]], owner[order[shared]]
        out = np.zeros((len(x), len(y)), np.float32)
        step = 4096
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, b = np.searchsorted(column, (k, k + step))
            m = np.zeros((len(x) + len(y), step), np.float32)
            m[owner[a:b], column[a:b] - k] = 1
            out += m[: len(x)] @ m[len(x) :].T
        return out

    def run(batches):
        for table, bounds in _runs(batches, "component", "one", "other"):
            ids, own = (table.column(c).to_numpy() for c in ("id", "own"))
            grams = table.column("grams")
            sets = [np.frombuffer(grams[i].as_buffer(), np.uint64) for i in range(len(ids))]
            got = []
            for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                one, other = table.column("one")[p].as_py(), table.column("other")[p].as_py()
                x = p + np.flatnonzero(own[p:q] == one)
                y = p + np.flatnonzero(own[p:q] == other)
                if not len(x) or not len(y):
                    continue
                both = common([sets[i] for i in x], [sets[i] for i in y])
                n, m = (np.array([len(sets[i]) for i in v], np.float64) for v in (x, y))
                linked = rule.over * both >= rule.share * (n[:, None] + m[None, :] - both)
                if one == other:
                    linked = np.triu(linked, 1)
                i, j = np.nonzero(linked)
                i, j = ids[x[i]], ids[y[j]]
                got.append((np.minimum(i, j), np.maximum(i, j)) if pairs else np.unique(np.concatenate((i, j)), return_counts=True))
            a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(2))
            yield from pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)}).to_batches()

    return run


class ParityJoin:
    """One run of the join over a table of documents."""

    def __init__(self, docs: DataFrame, rule: Rule = Rule(), *, key: str = "doc_id", text: str = "text") -> None:
        self.spark, self.rule, self.scratch = docs.sparkSession, rule, Scratch(docs.sparkSession, "parity")
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
        self.sets: DataFrame | None = None

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            return self.scratch.keep(df, name)

    def _classes(self) -> tuple[DataFrame, DataFrame]:
        """``id, n, doc`` of every document, and ``doc, id, n, sketch`` of every set, ``id`` being the smallest that has it."""
        scan = self.docs.mapInArrow(returns_memory(_scanned(self.rule)), "id long, n int, doc long, sketch binary")
        scan = self._keep(scan.groupBy("id").agg(F.min(F.struct("n", "doc", "sketch")).alias("s")).select("id", "s.*"), "scan")
        reps = scan.where("n > 0").groupBy("doc").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        return scan.select("id", "n", "doc"), self._keep(reps, "reps")

    def _buckets(self, reps: DataFrame) -> DataFrame:
        """``key, size, id, n, sketch``: the rarest keys by which each document would meet any partner."""
        total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        tables = max(1, ceil(total / 2 / TABLE_KEYS))
        packed = self.docs.mapInArrow(returns_memory(_packed(self.rule, tables)), _PACKED)
        shared = packed.groupBy("part").applyInArrow(_shared, "key long, doc long, need int, size int")
        level = Window.partitionBy("doc", "need")
        rows = shared.repartition("doc").withColumn("count", F.count("*").over(level)).withColumn("rank", F.row_number().over(level.orderBy("size", "key")))
        rows = rows.where(F.col("rank") <= F.col("count") - F.shiftright("need", 1) + 1).select("key", "doc", "need", "size")
        # a row of the first level needs the first level's sketch: the halves of the wider one, XORed
        return rows.join(reps, "doc").select("key", "size", "id", "n", "sketch", F.col("need").bitwiseAND(1).alias("second"))

    def _folded(self, rows: DataFrame) -> DataFrame:
        """Rows with the sketch of their level."""
        rule, names = self.rule, [c for c in rows.columns if c != "second"]

        def run(batches):
            sketcher, words = Sketcher(rule), {}
            for batch in batches:
                out = []
                for n, second, sketch in zip(*(batch.column(c).to_pylist() for c in ("n", "second", "sketch")), strict=True):
                    k = sketcher.level(n)
                    width = words.setdefault(k, 8 * rule.words(k))
                    if not second and len(sketch) > width:
                        half = np.frombuffer(sketch, np.uint8)
                        sketch = (half[:width] ^ half[width:]).tobytes()
                    out.append(sketch)
                columns = [pa.array(out, pa.binary()) if c == "sketch" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows.mapInArrow(returns_memory(run), rows.select(*names).schema)

    def _alive(self, reps: DataFrame) -> DataFrame:
        """``key, parts, id, n, sketch, near``: rows with candidates, and the parent of each in its block's forest."""
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = self._folded(self._buckets(reps)).withColumn("parts", parts)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "key"), "parts").cast("int")).drop("size")
        dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "id")
        schema = "key long, id long, n int, sketch binary, parts int, part int, near long"
        return self._keep(dealt.select("key", "id", "n", "sketch", "parts", "part").mapInArrow(returns_memory(_joined(self.rule)), schema), "alive")

    def _fetch(self, alive: DataFrame, reps: DataFrame) -> DataFrame:
        """``id, grams``: the sets of the documents that have candidates."""
        ids = self._keep(alive.select("id").distinct().join(reps.select("id", "doc"), "id"), "wanted")
        few = ids.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(ids.select("id")) if few else ids.select("id"), "id", "left_semi").select("text")
        sets = texts.mapInArrow(returns_memory(_sets(self.rule)), "doc long, grams binary").join(F.broadcast(ids) if few else ids, "doc")
        return self._keep(sets.groupBy("id").agg(F.min("grams").alias("grams")), "sets")

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, judged on whole sets."""
        left, right = (self.sets.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
        return self._keep(pairs.join(right, "b").join(left, "a").select("a", "b", "grams_a", "grams_b").mapInArrow(returns_memory(_verified(self.rule)), "a long, b long"), name)

    def _between(self, alive: DataFrame, labels: DataFrame) -> DataFrame:
        """``a, b``: candidate pairs between components that share a bucket."""
        in_bucket = Window.partitionBy("key")
        rows = alive.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        rows = rows.withColumn("low", F.min("component").over(in_bucket)).withColumn("high", F.max("component").over(in_bucket)).where("low <> high")
        rows = rows.select("key", "id", "n", "sketch", "parts", "component")
        whole = rows.where("parts = 1").select("*", F.lit(0).alias("part"), F.lit(0).alias("probe"))
        large = rows.where("parts > 1")
        counts = large.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("most"))
        members = large.select("*", F.pmod(F.xxhash64("id", "key"), "parts").cast("int").alias("part"), F.lit(2).alias("probe"))
        probes = large.join(counts, "key").where("component <> most").drop("most")
        probes = probes.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("probe"))
        dealt = whole.unionByName(members).unionByName(probes).repartition("key", "part").sortWithinPartitions("key", "part", "id")
        read = dealt.select("key", "id", "n", "sketch", "part", "component", "probe")
        return read.mapInArrow(returns_memory(_across(self.rule)), "a long, b long").distinct()

    def _components(self, reps: DataFrame) -> DataFrame:
        """``id, component`` of every set that links."""
        alive = self._alive(reps)
        self.sets = self._fetch(alive, reps)
        edges = alive.where("near <> id").select(F.least("near", "id").alias("a"), F.greatest("near", "id").alias("b")).distinct()
        tried = self._keep(edges, "pairs-0")
        links = self._verify(tried, "links-0")
        labels = connected_components(links, self.scratch)
        more = self._verify(self._keep(self._between(alive, labels).join(tried, ["a", "b"], "left_anti"), "pairs-1"), "links-1")
        return connected_components(links.unionByName(more), self.scratch) if more.take(1) else labels

    def _block_rows(self, labels: DataFrame, pairs: bool) -> DataFrame:
        """What ``_block_links`` finds in all components, each cut into blocks of sets."""
        members = labels.join(self.sets, "id").withColumn("n", F.length("grams") / 8)
        blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
        members = members.join(members.groupBy("component").agg(blocks.alias("blocks")), "component")
        members = members.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.select("component", F.least("own", "to").alias("one"), F.greatest("own", "to").alias("other"), "own", "id", "grams")
        dealt = members.repartition("component", "one", "other").sortWithinPartitions("component", "one", "other", "id")
        return dealt.mapInArrow(returns_memory(_block_links(self.rule, pairs)), "a long, b long")

    def links(self) -> DataFrame:
        """``a, b``: every pair of sets that links, by their smallest ids, ``a < b``."""
        labels = self._components(self._classes()[1])
        out = materialise(self._block_rows(labels, True), "parity-links")
        self.scratch.clear()
        return out

    def run(self, count_links: bool) -> DataFrame:
        """``id, n_shingles, component_id`` for every document, and on demand ``n_links``: the other sets that its own links with."""
        classes, reps = self._classes()
        labels = self._components(reps)
        sets = reps.select("doc", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        if count_links:
            degree = self._block_rows(labels, False).groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n_links"))
            sets = sets.join(degree, "rep", "left")
        out = classes.join(sets, "doc", "left").select(
            "id",
            F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("component", "rep", "id").alias("component_id"),
            *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []),
        )
        out = materialise(out, "parity-result")
        self.scratch.clear()
        return out


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every document."""
    return ParityJoin(docs, rule, key=key, text=text).run(True).withColumnRenamed("id", key)


def near_components(docs: DataFrame, rule: Rule = Rule(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document, without counting links."""
    return ParityJoin(docs, rule, key=key, text=text).run(False).withColumnRenamed("id", key)


def linked_pairs(docs: DataFrame, rule: Rule = Rule(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b``: all verified pairs of representatives (the smallest ids of their sets), ``a < b``."""
    return ParityJoin(docs, rule, key=key, text=text).links()


def keep_representatives(docs: DataFrame, rule: Rule = Rule(5, 80), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of smallest id; repeats of its row go as well.

    Documents with a null id or an empty set stay. Of rows that repeat an id, the least text stays.
    """
    found = near_components(docs, rule, key=key, text=text)
    drop = found.where((F.col(key) != F.col("component_id")) & (F.col("n_shingles") > 0)).select(key)
    # ids of 8 bytes, counted before they are broadcast; beyond the bound both sides are shuffled
    kept = docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop, key, "left_anti")
    repeated = materialise(docs.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).select(key), "parity-repeated")
    if not repeated.take(1):
        return kept
    order = free_column(docs, "order")
    again = kept.join(repeated, key, "left_semi").withColumn(order, F.row_number().over(Window.partitionBy(key).orderBy(text))).where(F.col(order) == 1)
    return kept.join(repeated, key, "left_anti").unionByName(again.select(*docs.columns)).select(*docs.columns)
