"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Two orders: ``P(w | h) = d * c(h, w) / c(h)`` for seen pairs, else ``a(h) * P(w)``; ``P(w)`` is
Good-Turing discounted itself and leaves its remainder to one class of unseen words. ``a(h)`` is the
mass that the pairs after ``h`` leave over, divided by what their words leave over under ``P``, so each
history sums to one. A history none of whose pairs is discounted (all counts above ``CUTOFF``) has its
relative frequencies scaled by ``c / (c + 1)`` instead; likewise the words as a whole.

Counting and evaluation share one pass over the tokens. Blocks of documents are reduced to distinct
(history, word) pairs with the documents that hold them, packed, and shuffled once to the table
partition of the history's hash. There the pair counts, history counts (which are the word counts, as
each word is followed by another token) and all terms of seen pairs are at hand. Only for unseen pairs
of held-out texts does a second step ask the partitions of the words for ``P(w)``, and a third returns
the sums that ``a(h)`` needs to the partitions of the histories. Sums per document are added up by
block. What is shuffled is proportional to the input; the driver gets sums of counts of counts only.

The recursion has two steps, pair and word. A third order would have to shuffle a key for each token of the
text once more (no block repeats its word triples), which the README weighs against the disk that there is.

Words are known by 56 bits of hash. Defined results: null texts are empty and score their end token;
null ids count as training rows; repeated rows are separate texts; with no training row every token
is unseen with probability one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import materialise, returns_memory, small_batches, trimmed
from .quality import fold
from .text_arrays import WordHasher, ascii_lower_table, space_separated, text_blocks, word_spans

CUTOFF = 5
#: Text per block of the map side, and per partition of the count tables.
BLOCK_BYTES, PARTITION_BYTES = 6 << 20, 8 << 20
_BITS = np.uint64((1 << 56) - 1)
_START, _END = np.uint64((1 << 56) + 1), np.uint64((1 << 56) + 2)
#: Per-document sums that the steps add up.
SUMS = ("seen", *(f"r{r}" for r in range(1, CUTOFF + 1)), "base", "known", "tokens", "unseen")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; bytes of like significance stand together."""
    head = [np.array([len(arrays)], np.int64).tobytes()]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode().ljust(8)
        head.append(np.array([len(a)], np.int64).tobytes() + code)
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    raw = b"".join(head + body)
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n, at = int(np.frombuffer(raw[:8], np.int64)[0]), 8
    shapes = []
    for _ in range(n):
        shapes.append((int(np.frombuffer(raw[at : at + 8], np.int64)[0]), np.dtype(raw[at + 8 : at + 16].strip().decode())))
        at += 16
    out = []
    for size, kind in shapes:
        width = size * kind.itemsize
        planes = np.frombuffer(raw[at : at + width], np.uint8).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += width
    return out


def _home(words: np.ndarray, partitions: int) -> np.ndarray:
    """Partition of a word; its lowest bits, which sorting leaves alone."""
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(partitions)


def _blocks(partitions: int):
    """Documents to packed blocks: a row per partition, and a row that keeps the ids."""

    def run(batches):
        from pyspark import TaskContext

        hasher, lower, is_word = WordHasher(), ascii_lower_table(), space_separated()
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            ids, held = batch.column("id"), batch.column("held_out").to_numpy(zero_copy_only=False)
            for first, last, raw, offsets in text_blocks(batch.column("text"), BLOCK_BYTES):
                number += 1
                n = last - first
                data = lower[raw]
                starts, ends, bounds = word_spans(data, offsets, is_word)
                words = hasher(data, starts, ends) & _BITS
                sizes = np.diff(bounds)
                doc = np.repeat(np.arange(n), sizes + 1)
                begin = bounds[:-1] + np.arange(n)
                history, word = np.empty(len(doc), np.uint64), np.empty(len(doc), np.uint64)
                inner = np.ones(len(doc), dtype=bool)
                inner[begin] = False
                history[begin], history[inner] = _START, words
                final = np.ones(len(doc), dtype=bool)
                final[begin + sizes] = False
                word[begin + sizes], word[final] = _END, words
                home = _home(history, partitions)
                order = np.lexsort((doc, word, history, home))
                history, word, doc, home = history[order], word[order], doc[order], home[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (history[1:] != history[:-1]) | (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.concatenate((at, [len(doc)]))).astype(np.uint32)
                history, word, doc, home = history[at], word[at], doc[at].astype(np.uint32), home[at]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (history[1:] != history[:-1]) | (word[1:] != word[:-1])
                pair = np.flatnonzero(new)
                holders = np.diff(np.concatenate((pair, [len(doc)]))).astype(np.uint32)
                edges = np.searchsorted(home, np.arange(partitions + 1))
                keys, blobs = [], []
                marks = np.packbits(held[first:last])
                for p in range(partitions):
                    a, b = int(edges[p]), int(edges[p + 1])
                    if a == b:
                        continue
                    i, j = np.searchsorted(pair, (a, b))
                    h = history[pair[i:j]]
                    fresh = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                    runs = np.diff(np.concatenate((fresh, [len(h)]))).astype(np.uint32)
                    keys.append(p)
                    blobs.append(pack(h[fresh], runs, word[pair[i:j]], holders[i:j], doc[a:b], count[a:b], marks, np.array([n], np.uint32)))
                keys.append(number % partitions)
                blobs.append(pack(marks, np.array([n], np.uint32)))
                none = pa.array([None], ids.type)
                empty = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), none.slice(0, 0))
                own = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.slice(first, n))
                lists = pa.concat_arrays([empty] * (len(keys) - 1) + [own])
                kind = pa.array(["pairs"] * (len(keys) - 1) + ["docs"])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), kind, pa.array([number] * len(keys), pa.int64()), pa.array(blobs, pa.binary()), lists], names=["part", "kind", "block", "data", "ids"])

    return run


_OUT = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("source", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64()))])
_OUT_DDL = "kind string, part long, source long, block long, data binary, ids array<long>, stats array<long>"


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{n: r.get(n) for n in _OUT.names} for r in rows], _OUT)


def _grouped_sum(number: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(number, weights=weight, minlength=size)


def _histories(partitions: int):
    """One partition of the pair table: counts, terms of seen pairs, questions for unseen ones."""

    def run(key, table):
        part, out = int(key[0].as_py()), []
        hs, ws, entries = [], [], []
        blocks: list[tuple[int, np.ndarray, int]] = []
        base = 0
        for row in table.to_pylist():
            if row["kind"] == "docs":
                out.append({"kind": "docs", "part": part, "block": row["block"], "data": row["data"], "ids": row["ids"]})
                continue
            h, runs, w, holders, doc, count, marks, (n,) = unpack(row["data"])
            hs.append(np.repeat(h, runs))
            ws.append(w)
            held = np.unpackbits(marks, count=int(n)).astype(bool)
            entries.append((np.repeat(np.arange(len(w), dtype=np.int32) + np.int32(base), holders), np.full(len(doc), len(blocks), np.int32), doc.astype(np.int32), count.astype(np.int32), held[doc]))
            base += len(w)
            blocks.append((row["block"], held, int(n)))
        if not blocks:
            return _rows(out)
        h, w = np.concatenate(hs), np.concatenate(ws)
        pair, blk, doc, cnt, held = (np.concatenate(x) for x in zip(*entries, strict=True))
        order = np.lexsort((w, h))
        sh, sw = h[order], w[order]
        new = np.ones(len(sh), dtype=bool)
        new[1:] = (sh[1:] != sh[:-1]) | (sw[1:] != sw[:-1])
        number = np.empty(len(sh), np.int64)
        number[order] = np.cumsum(new) - 1
        uh, uw = sh[new], sw[new]
        fresh = np.ones(len(uh), dtype=bool)
        fresh[1:] = uh[1:] != uh[:-1]
        hist_of, hist = np.cumsum(fresh) - 1, uh[fresh]
        g = number.astype(np.int32)[pair]
        del hs, ws, entries, h, w, order, sh, sw, number, pair
        c2 = _grouped_sum(g, cnt * ~held, len(uh)).astype(np.int64)
        ch = _grouped_sum(hist_of, c2, len(hist)).astype(np.int64)
        small = (c2 >= 1) & (c2 <= CUTOFF)
        plain = _grouped_sum(hist_of, small, len(hist)) > 0
        real = hist != _START
        stats = [int((c2 == r).sum()) for r in range(1, CUTOFF + 2)]
        stats += [int(((ch == r) & real).sum()) for r in range(1, CUTOFF + 2)]
        stats += [int(ch[real].sum()), int(((ch > 0) & real).sum()), int(ch[~real].sum())]
        out.append({"kind": "stats", "part": part, "stats": stats})
        known = real & (ch > 0)
        out.append({"kind": "words", "part": part, "data": pack(hist[known], ch[known])})
        # terms of each (document, pair), a block at a time
        pair_term = np.where(c2 > 0, np.log10(np.maximum(c2, 1)) - np.log10(np.where(plain, ch, ch + 1).clip(1))[hist_of], 0.0)
        word_term = np.where(real, np.log10(ch + 0.1), 0.0)
        first = np.searchsorted(blk, np.arange(len(blocks) + 1))
        for k, (block, _, n) in enumerate(blocks):
            rows = slice(int(first[k]), int(first[k + 1]))
            e, d, c = g[rows], doc[rows], cnt[rows]
            e2, eh = c2[e], hist_of[e]
            sums = {"seen": pair_term[e] * c, "base": word_term[eh] * c, "known": c * known[eh], "tokens": c * real[eh], "unseen": np.zeros(len(c))}
            sums |= {f"r{r}": c * (e2 == r) for r in range(1, CUTOFF + 1)}
            out.append({"kind": "sums", "part": block, "block": block, "data": pack(*[_grouped_sum(d, sums[s], n).astype(np.float64 if s in ("seen", "base", "unseen") else np.uint32) for s in SUMS])})
        # unseen pairs of held-out texts
        ask = np.flatnonzero(c2[g] == 0)
        if len(ask):
            word, home = uw[g[ask]], _home(uw[g[ask]], partitions)
            for p in np.unique(home):
                m = ask[home == p]
                out.append({"kind": "tokens", "part": int(p), "data": pack(word[home == p], np.array([blocks[k][0] for k in blk[m]], np.int64), doc[m].astype(np.uint32), cnt[m].astype(np.uint32))})
            m = ask[ch[hist_of[g[ask]]] > 0]
            needed, local = np.unique(hist_of[g[m]], return_inverse=True)
            if len(needed):
                index = np.full(len(hist), -1)
                index[needed] = np.arange(len(needed))
                after = np.flatnonzero((index[hist_of] >= 0) & (c2 > 0))
                small_by_r = [_grouped_sum(index[hist_of[after]], c2[after] == r, len(needed)) for r in range(1, CUTOFF + 1)]
                large = _grouped_sum(index[hist_of[after]], np.where(c2[after] > CUTOFF, c2[after], 0), len(needed))
                out.append({"kind": "history", "part": part, "data": pack(ch[needed], large, np.stack(small_by_r).ravel(), local.astype(np.int64), np.array([blocks[k][0] for k in blk[m]], np.int64), doc[m].astype(np.uint32), cnt[m].astype(np.uint32))})
                home = _home(uw[after], partitions)
                for p in np.unique(home):
                    s = after[home == p]
                    out.append({"kind": "after", "part": int(p), "source": part, "data": pack(uw[s], index[hist_of[s]].astype(np.uint32), np.array([len(needed)], np.int64))})
        return _rows(out)

    return run


@dataclass
class Discounts:
    """Global numbers of the model, from sums of counts of counts."""

    pair: np.ndarray
    word: np.ndarray
    total: int
    types: int
    ends: int

    @staticmethod
    def good_turing(n: np.ndarray) -> np.ndarray:
        """``d_r`` for r = 1..CUTOFF; where counts of counts give none in (0, 1), ``(r - 0.5) / r``."""
        out = np.array([(r - 0.5) / r for r in range(1, CUTOFF + 1)])
        if n[0] > 0:
            shift = (CUTOFF + 1) * n[CUTOFF] / n[0]
            if shift < 1:
                for r in range(1, CUTOFF + 1):
                    if n[r - 1] and n[r]:
                        d = ((r + 1) * n[r] / (r * n[r - 1]) - shift) / (1 - shift)
                        if 0 < d < 1:
                            out[r - 1] = d
        return out

    @staticmethod
    def of(stats: np.ndarray) -> Discounts:
        pair, word = stats[: CUTOFF + 1], stats[CUTOFF + 1 : 2 * CUTOFF + 2].copy()
        total, types, ends = (int(x) for x in stats[2 * CUTOFF + 2 :])
        if 1 <= ends <= CUTOFF + 1:
            word[ends - 1] += 1
        model = Discounts(Discounts.good_turing(pair), Discounts.good_turing(word), total + ends, types + (ends > 0), ends)
        kept = sum(model.word[r - 1] * r * word[r - 1] for r in range(1, CUTOFF + 1)) - sum(r * word[r - 1] for r in range(1, CUTOFF + 1))
        model.scale = 1.0 if word[:CUTOFF].any() else model.total / (model.total + 1)
        model.rest = 1.0 if not model.total else 1.0 - model.scale * (model.total + kept) / model.total
        return model

    def probability(self, count: np.ndarray) -> np.ndarray:
        """``P(w)`` of words by their training count."""
        d = np.concatenate(([0.0], self.word))[np.minimum(count, CUTOFF)]
        d = np.where(count > CUTOFF, 1.0, d)
        return np.where(count > 0, self.scale * d * count / max(self.total, 1), self.rest)


def _words(model: Discounts):
    """One partition of the word table: probabilities for the questions of histories and documents."""

    def run(key, table):
        out, words, counts = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for row in table.filter(pc.equal(table["kind"], "words")).to_pylist():
            words, counts = unpack(row["data"])
        if model.ends:
            words, counts = np.append(words, _END), np.append(counts, model.ends)

        def probability(w: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            count = np.where(words[at] == w, counts[at], 0) if len(words) else np.zeros(len(w), np.int64)
            return model.probability(count)

        by_block: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for row in table.to_pylist():
            if row["kind"] == "after":
                w, index, (n,) = unpack(row["data"])
                out.append({"kind": "mass", "part": row["source"], "data": pack(_grouped_sum(index, probability(w), int(n)))})
            elif row["kind"] == "tokens":
                w, block, doc, cnt = unpack(row["data"])
                term = np.log10(probability(w)) * cnt
                for b in np.unique(block):
                    m = block == b
                    by_block.setdefault(int(b), []).append((doc[m], term[m]))
        out += _unseen_rows(by_block)
        return _rows(out)

    return run


def _unseen_rows(by_block: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> list[dict]:
    """Sparse sums per document: document numbers and their terms."""
    out = []
    for block, pieces in by_block.items():
        doc, term = (np.concatenate(x) for x in zip(*pieces, strict=True))
        unique, number = np.unique(doc, return_inverse=True)
        out.append({"kind": "unseen", "part": block, "block": block, "data": pack(unique, _grouped_sum(number, term, len(unique)))})
    return out


def _backoff(model: Discounts):
    """One partition of the history table: backoff weights, and their terms per document."""

    def run(key, table):
        rows = table.to_pylist()
        mass = [unpack(r["data"])[0] for r in rows if r["kind"] == "mass"]
        by_block: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for row in rows:
            if row["kind"] != "history":
                continue
            ch, large, small, local, block, doc, cnt = unpack(row["data"])
            small = small.reshape(CUTOFF, len(ch))
            kept = (large + sum(model.pair[r - 1] * r * small[r - 1] for r in range(1, CUTOFF + 1))) / ch
            left = np.where(small.sum(axis=0) > 0, 1.0 - kept, 1.0 / (ch + 1.0))
            weight = np.maximum(left, 1e-300) / np.maximum(1.0 - sum(mass), 1e-300)
            term = np.log10(weight)[local] * cnt
            for b in np.unique(block):
                m = block == b
                by_block.setdefault(int(b), []).append((doc[m], term[m]))
        return _rows(_unseen_rows(by_block))

    return run


def _finish(model: Discounts):
    """A block: sums of all steps to one row per document."""

    def run(key, table):
        rows = table.to_pylist()
        ids = next(r["ids"] for r in rows if r["kind"] == "docs")
        marks, (n,) = next(unpack(r["data"]) for r in rows if r["kind"] == "docs")
        total = {s: np.zeros(int(n)) for s in SUMS}
        for row in rows:
            if row["kind"] == "sums":
                for s, x in zip(SUMS, unpack(row["data"]), strict=True):
                    total[s] += x
            elif row["kind"] == "unseen":
                doc, term = unpack(row["data"])
                total["unseen"][doc] += term
        tokens = total["tokens"].astype(np.int64) + 1
        base = total["base"] + np.log10(model.ends + 0.1) - tokens * np.log10(model.total + 0.1 * (model.types + 1))
        score = total["seen"] + total["unseen"] + sum(np.log10(model.pair[r - 1]) * total[f"r{r}"] for r in range(1, CUTOFF + 1))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array(np.unpackbits(marks, count=int(n)).astype(bool)),
            "n_tokens": pa.array(tokens),
            "n_known": pa.array(total["known"].astype(np.int64) + (model.ends > 0)),
            "train_tokens": pa.array(np.full(int(n), model.total, np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(score),
        })

    return run


def katz_scores(docs: DataFrame, held_out, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows for which ``held_out`` is true are scored but not learned from. Scores are log10 probabilities.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PARTITION_BYTES))
    packed = rows.mapInArrow(returns_memory(_blocks(partitions)), "part long, kind string, block long, data binary, ids array<long>")
    with small_batches(spark):
        counts = materialise(packed.repartition(partitions, "part").groupBy("part").applyInArrow(trimmed(_histories(partitions)), _OUT_DDL), "katz-counts")
    summed = counts.where("kind = 'stats'").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    stats = np.zeros(2 * CUTOFF + 5, np.int64)
    for r in summed:
        stats[r.pos] = r.n
    model = Discounts.of(stats)
    questions = counts.where(F.col("kind").isin("words", "tokens", "after"))
    answers = materialise(questions.groupBy("part").applyInArrow(trimmed(_words(model)), _OUT_DDL), "katz-words")
    weights = counts.where("kind = 'history'").unionByName(answers.where("kind = 'mass'")).groupBy("part").applyInArrow(trimmed(_backoff(model)), _OUT_DDL)
    pieces = counts.where(F.col("kind").isin("docs", "sums")).unionByName(answers.where("kind = 'unseen'")).unionByName(weights)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return pieces.groupBy("block").applyInArrow(trimmed(_finish(model)), out)


def score_report(docs: DataFrame) -> DataFrame:
    """Scores of every document; rows with crc32(doc_id) mod 10 = 0 are held out."""
    return katz_scores(docs, fold("doc_id", 10) == 0)
