"""Periodic runs of words: maximal repetitions found through Lyndon roots, and texts collapsed to one period each.

A run is a stretch of consecutive words with smallest period ``q`` that neither neighbour extends, here of at least
``MIN_WORDS`` words and ``MIN_PERIODS`` periods. Every run has a root that is the longest Lyndon word at its place under one of
two opposite orders of the words. So the words are scanned from right to left with a stack that holds the next smaller
suffix of each place, once for each order; suffixes are compared, and roots extended to both sides, by longest common
extensions, which a binary search over rolling hashes finds. Each run is then verified word by word; a run that a hash
feigned has the scan repeated with another base. No suffix array is made.

Before the scan whole texts are narrowed, without losing a run, to the stretches that can hold one: all but the last
``q + 2`` words of a run begin a triple of words that comes again within ``q``, and a run that covers ``m`` such places
has ``3 * q <= m + 2``. Next places of equal triples come from one sort of a block of texts; stretches are cut at
triples that come again too late until nothing changes, and those whose windows overlap are scanned as one.

Documents are independent: one pass, no shuffle, memory of one block of texts or one long text.

Defined results: a null or blank text has no words and no runs; its collapsed text is empty; repeated rows are separate
documents; an empty table gives an empty table; other columns are carried along, and columns that are added get
underscores in front where their names are taken. Ties for the strongest run go to the smaller start, then period.
"""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import free_column, returns_memory
from .text_arrays import WordHasher, mix, space_separated, text_blocks, word_spans

MIN_WORDS = 6
MIN_PERIODS = 4
MODULUS = (1 << 61) - 1
#: Words over which a known extension is carried on by comparing them.
NEAR = 256
FAR = np.iinfo(np.int64).max


class Extensions:
    """Longest common extensions of places of one word sequence, by rolling hashes."""

    def __init__(self, words: list[int], base: int) -> None:
        self.words, n = words, len(words)
        self.sums, self.powers = [0] * (n + 1), [1] * (n + 1)
        self.known: dict[int, tuple[int, int]] = {}
        total, power = 0, 1
        for k, w in enumerate(words):
            total = (total * base + w + 1) % MODULUS
            power = power * base % MODULUS
            self.sums[k + 1], self.powers[k + 1] = total, power

    def _same(self, i: int, j: int, n: int) -> bool:
        s, p = self.sums, self.powers[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % MODULUS == 0

    def right(self, i: int, j: int) -> int:
        """Equal words from ``i`` and from ``j > i`` on."""
        w = self.words
        most, n = len(w) - j, 0
        while n < most and n < 4:
            if w[i + n] != w[j + n]:
                return n
            n += 1
        # the last answer at this distance, a few words to the right, is carried on if the words between are equal
        place, length = self.known.get(j - i, (0, 0))
        gap = place - i
        if 0 <= gap <= NEAR and w[i:place] == w[j : j + gap]:
            n = gap + length
        else:
            n = self._search(i, j, n, most)
        self.known[j - i] = (i, n)
        return n

    def _search(self, i: int, j: int, n: int, most: int) -> int:
        step = 8
        while n + step <= most and self._same(i + n, j + n, step):
            n += step
            step *= 2
        while step := step // 2:
            if n + step <= most and self._same(i + n, j + n, step):
                n += step
        return n

    def left(self, i: int, j: int) -> int:
        """Equal words before ``i`` and before ``j > i``."""
        w, n = self.words, 0
        while n < i and n < 4:
            if w[i - n - 1] != w[j - n - 1]:
                return n
            n += 1
        step = 8
        while n + step <= i and self._same(i - n - step, j - n - step, step):
            n += step
            step *= 2
        while step := step // 2:
            if n + step <= i and self._same(i - n - step, j - n - step, step):
                n += step
        return n


def _is_run(words: list[int], start: int, end: int, period: int) -> bool:
    """Word by word: the period holds, and no neighbour goes on with it."""
    return (
        words[start : end - period] == words[start + period : end]
        and (start == 0 or words[start - 1] != words[start + period - 1])
        and (end == len(words) or words[end] != words[end - period])
    )


def lyndon_runs(words: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, base: int | None = None) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence, in order."""
    n = len(words)
    if n < min_words:
        return []
    rng = random.Random(n)
    while True:
        reach = Extensions(words, base or rng.randrange(1 << 20, MODULUS))
        right, left, found = reach.right, reach.left, set()
        extents: dict[int, tuple[int, int]] = {}  # of each period the last stretch that was extended
        for smaller in (False, True):
            stack = [n]  # starts of ever smaller suffixes, the nearest on top; the end is the smallest
            for i in range(n - 1, -1, -1):
                word = words[i]
                common = 0
                while (j := stack[-1]) < n:
                    other = words[j]
                    if word == other:
                        common = right(i, j)
                        if j + common == n:  # the later suffix is a prefix of this one, and so smaller
                            break
                        a, b = words[i + common], words[j + common]
                    else:
                        common = 0
                        a, b = word, other
                    if (a > b) != smaller:
                        break
                    stack.pop()
                else:
                    common = 0
                period = j - i
                stack.append(i)
                if min_periods * period > n or not (common or (i and words[i - 1] == words[j - 1])):
                    continue
                start, end = extents.get(period, (n, 0))
                if start <= i and j <= end:
                    continue
                start, end = extents[period] = i - left(i, j), j + common
                if end - start >= max(min_words, min_periods * period):
                    found.add((start, end - start, period))
        if all(_is_run(words, s, s + m, q) for s, m, q in found):
            return sorted(found, key=lambda r: (r[0], r[2]))
        base = None


def windows(hashes: np.ndarray, first_word: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the words of a block, in order and apart, that hold all runs of its texts.

    ``hashes`` are of the words, ``first_word`` says where each text's words begin (and where the last one's end).
    """
    n = len(hashes)
    if n < MIN_WORDS:
        return []
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    triple = hashes[:-2] + np.uint64(3) * mix(hashes[1:-1]) + np.uint64(5) * mix(hashes[2:] + np.uint64(1))
    triple = mix(triple) ^ mix(text[:-2].astype(np.uint64) + np.uint64(1))
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    again = ordered[1:] == ordered[:-1]
    later = np.full(n, FAR)
    later[order[:-1][again]] = order[1:][again] - order[:-1][again]
    later[:-2][text[:-2] != text[2:]] = FAR  # a triple does not reach over the end of its text
    places = np.flatnonzero(later < FAR)
    while len(places):
        heads = np.flatnonzero(np.r_[True, (np.diff(places) > 1) | (np.diff(text[places]) > 0)])
        sizes = np.diff(np.r_[heads, len(places)])
        longest = np.repeat((sizes + 2) // MIN_PERIODS_LESS_ONE, sizes)
        stays = (later[places] <= longest) & (np.repeat(sizes, sizes) >= MIN_WORDS - 3)
        if stays.all():
            break
        places = places[stays]
    if not len(places):
        return []
    starts = places[heads]
    ends = np.minimum(starts + sizes + (sizes + 2) // MIN_PERIODS_LESS_ONE + 2, first_word[text[starts] + 1])
    out: list[tuple[int, int]] = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and s <= out[-1][1] and text[s] == text[out[-1][0]]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: A run covers at least ``(MIN_PERIODS - 1) * q - 2`` places whose triple comes again within ``q``.
MIN_PERIODS_LESS_ONE = MIN_PERIODS - 1


def block_runs(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> list[list[tuple[int, int, int]]]:
    """Runs of each text of a block."""
    starts, ends, first_word = word_spans(data, offsets, space_separated())
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if len(starts) < MIN_WORDS:
        return runs
    for a, b in windows(hasher(data, starts, ends), first_word):
        numbers: dict[bytes, int] = {}
        words = [numbers.setdefault(w, len(numbers)) for w in data[starts[a] : ends[b - 1]].tobytes().split()]
        k = int(np.searchsorted(first_word, a, side="right")) - 1
        at = a - int(first_word[k])
        runs[k] += [(at + s, m, q) for s, m, q in lyndon_runs(words)]
    return runs


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by single spaces, of each run only its first period (unless another run drops that too)."""
    words = text.split()
    if runs:
        kept = bytearray(b"\x01") * len(words)
        for start, length, period in runs:
            kept[start + period : start + length] = bytes(length - period)
        words = itertools.compress(words, kept)
    return b" ".join(words)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, compared exactly; ties by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _found(batch_texts: pa.Array, hasher: WordHasher):
    """Per row: runs and collapsed text."""
    for first, last, data, offsets in text_blocks(batch_texts):
        runs = block_runs(data, offsets, hasher)
        body = data.tobytes()
        for k in range(last - first):
            yield runs[k], collapse(body[offsets[k] : offsets[k + 1]], runs[k])


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
RUNS_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
REPORT = {
    "n_runs": T.LongType(), "start": T.LongType(), "length": T.LongType(), "period": T.LongType(), "exponent_milli": T.LongType(),
    "runs_sha256": T.StringType(), "collapsed_sha256": T.StringType(),
}


def _mapped(docs: DataFrame, keep: list[str], text: Column, output, added: list[T.StructField], kinds: list[pa.DataType]) -> DataFrame:
    fields = [*[docs.schema[c] for c in keep], *added]
    names = [f"c{k}" for k in range(len(fields))]

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            values = [output(*found) for found in _found(batch.column(0), hasher)]
            columns = list(zip(*values, strict=True)) if values else [()] * len(kinds)
            arrays = [*[batch.column(k + 1) for k in range(len(keep))], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    picked = docs.select(text.alias("t"), *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)])
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    return picked.mapInArrow(returns_memory(run), schema).toDF(*[f.name for f in fields])


def collapse_runs(docs: DataFrame, *, text: str = "text", runs: str = "runs") -> DataFrame:
    """``docs`` with ``text`` collapsed, and the array ``runs`` of (start, length, period) added."""
    rest, added = [c for c in docs.columns if c != text], free_column(docs, runs)
    output = lambda found, body: (body.decode(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
    fields = [T.StructField(text, T.StringType()), T.StructField(added, RUNS)]
    return _mapped(docs, rest, docs[text], output, fields, [pa.string(), RUNS_ARROW]).select(*docs.columns, added)


def _digests(runs: list[tuple[int, int, int]], body: bytes):
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    s, m, q = strongest(runs) or (None, None, None)
    return len(runs), s, m, q, None if q is None else 1000 * m // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(body).hexdigest()


def planted(key: Column, text: Column) -> Column:
    """The contract's texts: for a tenth of the keys, words from a place on repeat with a period; other texts are as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        body = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(body, F.lit(1), n - a)), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the words are bound to a variable, so that they are taken once
    return F.when(F.pmod(h, F.lit(10)) == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def run_report(docs: DataFrame, *, text: Column | str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    kinds = [pa.string() if isinstance(t, T.StringType) else pa.int64() for t in REPORT.values()]
    column = docs[text] if isinstance(text, str) else text
    return _mapped(docs, [key], column, _digests, [T.StructField(c, t) for c, t in REPORT.items()], kinds)


def reference_runs(words: list, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """Brute force over all periods, for tests."""
    out, n = [], len(words)
    for q in range(1, n // min_periods + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(min_words, min_periods * q) and not any(words[start : end - d] == words[start + d : end] for d in range(1, q)):
                out.append((start, end - start, q))
            start = max(end - q + 1, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))
