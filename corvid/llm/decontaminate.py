"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton holds every normalised benchmark item. Training words stream through it and the
longest matching length is tracked at each word; a match of at least ``window`` words (or a whole
shorter item) marks a hit. Words outside the benchmark vocabulary return the automaton to its
root, so only runs of vocabulary words that are long enough for a window are walked.

Defined results: null or empty texts have no words and no hits; null items and items without
words match nothing; repeated rows are each judged alone; a repeated item id counts once; other
columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import Shipped, free_column, materialise, returns_memory
from .text_arrays import WordHasher, alphanumeric, ascii_lower_table, text_blocks, word_spans

WINDOW = 13
#: Words of benchmark items held by one automaton; a larger benchmark is scanned in blocks.
BLOCK_WORDS = 500_000


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over integer words, with the items that own each window."""

    window: int
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    owners: dict[int, set[str]] = field(default_factory=dict)
    spans: list[tuple[int, int]] = field(default_factory=list)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            known = nxt[last][word]
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        new = self._state(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            known = nxt[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, word: int, known: int) -> int:
        copy = self._state(self.length[at] + 1)
        self.next[copy] = dict(self.next[known])
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def own(self, items: list[tuple[str, list[int]]]) -> None:
        """Attach item ids to the states of their windows; call once, after all ``add``."""
        matched: dict[int, set[int]] = {}
        for item, words in items:
            need = min(self.window, len(words))
            state, n = 0, 0
            for k, word in enumerate(words):
                state, n = self.next[state][word], n + 1
                if k + 1 < need:
                    continue
                while self.length[self.link[state]] >= need:
                    state = self.link[state]
                n = min(n, self.length[state])
                self.owners.setdefault((state, need), set()).add(item)  # type: ignore[arg-type]
                matched.setdefault(state, set()).add(need)
        #: For each state, the (length, owners) of the windows that end wherever the state is reached.
        self.ends: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            up = self.ends[self.link[state]] if state else ()
            mine = tuple((need, frozenset(self.owners[state, need])) for need in sorted(matched.get(state, ())))  # type: ignore[index]
            self.ends[state] = up + mine
        self.owners = {}

    def walk(self, words: list[int]):
        """Yield ``(end, length, owners)`` for each window that ends at word ``end`` (exclusive)."""
        nxt, link, length, ends = self.next, self.link, self.length, self.ends
        state, n = 0, 0
        for k, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                n = length[state]
            if word in nxt[state]:
                state, n = nxt[state][word], n + 1
            else:
                state, n = 0, 0
            for need, owners in ends[state]:
                if need <= n:
                    yield k + 1, need, owners


class Scanner:
    """One block of the benchmark, ready to be searched for in Arrow batches."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        hasher = self.hasher = WordHasher()
        self.lower, self.is_word = ascii_lower_table(), alphanumeric()
        texts = pa.array([text for _, text in items], pa.large_string())
        hashed: list[tuple[str, np.ndarray]] = []
        for first, last, data, offsets in text_blocks(texts):
            data = self.lower[data]
            starts, ends, bounds = word_spans(data, offsets, self.is_word)
            hashes = hasher(data, starts, ends)
            hashed += [(items[i][0], hashes[bounds[i - first] : bounds[i - first + 1]]) for i in range(first, last)]
        hashed = [(item, h) for item, h in hashed if len(h)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.vocabulary >> np.uint64(44)] = True
        coded = [(item, np.searchsorted(self.vocabulary, h).tolist()) for item, h in hashed]
        self.shortest = min((min(window, len(w)) for _, w in coded), default=0)
        self.automaton = SuffixAutomaton(window)
        for _, words in coded:
            self.automaton.add(words)
        self.automaton.own(coded)

    def _codes(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, -1 outside the vocabulary."""
        codes = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == hashes[maybe]
        codes[maybe[good]] = at[good]
        return codes

    def scan(self, texts: pa.Array):
        """Per text: ``(words, hit spans as word numbers, byte spans, item ids)``."""
        for _, _, raw, offsets in text_blocks(texts):
            data = self.lower[raw]
            starts, ends, bounds = word_spans(data, offsets, self.is_word)
            counts = np.diff(bounds)
            found: dict[int, tuple[list[list[int]], set[str]]] = {}
            if len(self.vocabulary) and len(starts):
                codes = self._codes(self.hasher(data, starts, ends))
                cut = np.zeros(len(codes) + 1, dtype=bool)
                cut[bounds] = True
                known = codes >= 0
                begins = np.flatnonzero(known & (np.concatenate(([True], ~known[:-1])) | cut[:-1]))
                stops = np.flatnonzero(known & (np.concatenate((~known[1:], [True])) | cut[1:])) + 1
                long = stops - begins >= self.shortest
                for b, e in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
                    for end, need, owners in self.automaton.walk(codes[b:e].tolist()):
                        doc = int(np.searchsorted(bounds, b, side="right")) - 1
                        spans, items = found.setdefault(doc, ([], set()))
                        items |= owners
                        s, t = b + end - need, b + end
                        while spans and spans[-1][1] >= s:
                            s = min(s, spans.pop()[0])
                        spans.append([s, t])
            for doc in range(len(counts)):
                spans, items = found.get(doc, ((), ()))
                base, o = int(bounds[doc]), int(offsets[doc])
                yield (
                    int(counts[doc]),
                    [(s - base, t - base) for s, t in spans],
                    [(int(starts[s]) - o, int(ends[t - 1]) - o) for s, t in spans],
                    items,
                )


_SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "last", "byte_from", "byte_to")])
#: What a scan adds to each row.
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _scan_with(holder, text: str, out: str, again: bool):
    def run(batches):
        scanner = holder.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            found = list(scanner.scan(batch.column(text)))
            old = table.column(out).to_pylist() if again else [None] * len(found)
            rows = []
            for (n, words, places, items), before in zip(found, old, strict=True):
                spans = [(*w, *p) for w, p in zip(words, places, strict=True)]
                if before:
                    spans = _united(spans + [tuple(s.values()) for s in before["spans"]])
                    items = set(items) | set(before["items"])
                rows.append({"n_words": n, "spans": [dict(zip(_SPAN.names, s, strict=True)) for s in spans], "items": sorted(items)})
            span = pa.struct([(c, pa.int64()) for c in _SPAN.names])
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])
            column = pa.array(rows, kind)
            table = table.set_column(table.schema.get_field_index(out), out, column) if again else table.append_column(out, column)
            yield from table.to_batches()

    return run


def _united(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Union of spans that overlap or touch, in order."""
    out: list[tuple[int, ...]] = []
    for s in sorted(spans):
        if out and out[-1][1] >= s[0]:
            p = out[-1]
            out[-1] = (p[0], max(p[1], s[1]), p[2], max(p[3], s[3]))
        else:
            out.append(s)
    return out


def find_benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    out: str = "hits",
    finish=None,
) -> DataFrame:
    """``docs`` with a struct column ``out``: words, merged hit spans (word and byte numbers), item ids.

    The benchmark is measured first and cut into blocks of about ``block_words`` words; each block is
    one automaton, broadcast to one pass over the documents. There is no shuffle; between blocks the rows are written.
    ``finish``, a function of Arrow batches with the column, runs in the last pass and gives the columns of ``docs`` alone.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    words = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = -(-int(words) // block_words) or 1
    plain = docs.schema
    schema = T.StructType([*plain.fields, T.StructField(out, HITS)])
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        scanner = Scanner([(r.item, r.text) for r in part.collect()], window)
        # one automaton is resident at a time: the rows are written before the next one is shipped
        docs = materialise(docs, "hits") if k else docs
        scan = _scan_with(Shipped(spark, scanner), text, out, k > 0)
        if finish and k == blocks - 1:
            return docs.mapInArrow(returns_memory(lambda batches, scan=scan: finish(scan(batches))), plain)
        docs = docs.mapInArrow(returns_memory(scan), schema)
    return docs


def _cut_spans(batches, text: str, hits: str, coverage_times: int):
    """Batches without the documents that the rule condemns, the others without their hit spans, and without ``hits``."""
    for batch in batches:
        found = batch.column(hits).to_pylist()
        n_hit = [sum(x["last"] - x["first"] for x in f["spans"]) for f in found]
        clean = [not (n > 0 and n * coverage_times >= f["n_words"]) for n, f in zip(n_hit, found, strict=True)]
        table = pa.Table.from_batches([batch]).filter(pa.array(clean, pa.bool_()))
        i, texts = table.schema.get_field_index(text), []
        for value, spans in zip(table.column(text).to_pylist(), [f["spans"] for f, ok in zip(found, clean, strict=True) if ok], strict=True):
            if value is not None and spans:
                data, kept, at = value.encode(), [], 0
                for span in spans:
                    kept.append(data[at : span["byte_from"]])
                    at = span["byte_to"]
                value = b"".join([*kept, data[at:]]).decode()
            texts.append(value)
        table = table.set_column(i, text, pa.array(texts, table.schema.field(i).type))
        yield from table.remove_column(table.schema.get_field_index(hits)).to_batches()


def contaminated(hits: str = "hits", *, coverage_times: int = 20):
    """The contract's rule: some hit, and hit words are at least 1 in ``coverage_times``."""
    n_hit = hit_words(hits)
    return (n_hit > 0) & (n_hit * coverage_times >= F.col(f"{hits}.n_words"))


def hit_words(hits: str = "hits"):
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", coverage_times: int = 20, **options) -> DataFrame:
    """Drop documents that the coverage rule condemns; cut the remaining hit spans out of the others.

    Clean documents pass unchanged and all columns of ``docs`` are returned. A null text stays null.
    """
    hits = free_column(docs, "hits")
    return find_benchmark_hits(docs, items, text=text, out=hits, finish=lambda batches: _cut_spans(batches, text, hits, coverage_times), **options)


def hit_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: words, hit words, items found, digest of their ids, verdict."""
    found = find_benchmark_hits(docs, items, **options)
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def reference_hits(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """Brute force over Python sets, for tests."""
    import re

    def words(value: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    doc = words(text)
    hit, owners = set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        targets = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in targets:
                hit |= set(range(i, i + n))
                owners.add(item)
    digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
    return len(doc), len(hit), len(owners), digest, bool(hit) and 20 * len(hit) >= len(doc)
