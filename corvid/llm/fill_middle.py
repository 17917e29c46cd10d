"""Fill-in-the-middle transformation: a byte automaton finds units and sentinels, a second pass cuts.

A text is cut into units (lines with their line feed). Two cuts between units make prefix, middle and suffix, which
are written as ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). A text that is empty,
holds a sentinel or falls outside ``rate`` stays as it is (plain). Cuts and form follow from a SHA-256 digest of seed
and key, so a rerun of a lost task cuts alike.

One table drives a deterministic automaton over bytes; its states know how far a sentinel has been read, how many UTF-8
continuation bytes are due and whether a unit is open. Each transition emits counts (code points, units, sentinels). The
texts of a block lie end to end with an end-of-text symbol after each, and are walked in many lanes at once; a lane whose
guessed first state turns out wrong is walked again. The second pass takes the cuts from the places of the emitted
units. There is no shuffle, and a text is never truncated.

Defined results: a null text is empty; an empty text is plain with no units; a null key counts as an empty string in the
digest; repeated rows with one key are cut alike; an empty table gives an empty table; other columns are carried along,
and columns that are added get underscores in front where their names are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .cluster import Shipped, free_column, returns_memory
from .text_arrays import text_blocks

#: Symbol after the last byte of a text.
END = 256
SYMBOLS = 257
#: What a transition emits.
CODE_POINT, UNIT, SENTINEL = 1, 2, 4
LANES = 4096


@dataclass
class Settings:
    """``prefix``, ``suffix`` and ``middle`` are the sentinels; ``rate`` and ``spm`` are percentages."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "7"
    rate: int = 100
    spm: int = 50
    automaton: Automaton | None = field(default=None, repr=False)

    def ready(self) -> Settings:
        self.automaton = Automaton((self.prefix, self.suffix, self.middle))
        return self


class Automaton:
    """``step[state + symbol]`` is the next state (a multiple of ``SYMBOLS``), ``emits[state + symbol]`` what is counted."""

    def __init__(self, sentinels: tuple[str, ...]) -> None:
        words = [s.encode() for s in sentinels]
        heads = {w[:k] for w in words for k in range(len(w))}

        def follow(state: tuple[bytes, int, bool], symbol: int) -> tuple[tuple[bytes, int, bool], int]:
            read, due, is_open = state
            if symbol == END:
                return (b"", 0, False), UNIT if is_open else 0
            seen = read + bytes([symbol])
            emitted = SENTINEL if any(seen.endswith(w) for w in words) else 0
            read = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in heads)
            if due and 0x80 <= symbol < 0xC0:
                return (read, due - 1, True), emitted
            due = (symbol >= 0xC0) + (symbol >= 0xE0) + (symbol >= 0xF0)
            if symbol == 0x0A:
                return (read, 0, False), emitted | CODE_POINT | UNIT
            return (read, due, True), emitted | CODE_POINT

        numbers, rows = {(b"", 0, False): 0}, []
        for state in (queue := [(b"", 0, False)]):
            row = []
            for symbol in range(SYMBOLS):
                after, emitted = follow(state, symbol)
                if after not in numbers:
                    numbers[after] = len(numbers)
                    queue.append(after)
                row.append((numbers[after] * SYMBOLS, emitted))
            rows += row
        self.step = np.array([r[0] for r in rows], np.int32)
        self.emits = np.array([r[1] for r in rows], np.uint8)
        self.states = len(numbers)
        self.memory = max(3, max(map(len, words)) - 1)

    def _walk(self, columns: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Each column of symbols from its state on; returns the last states, ``out`` gets what is emitted."""
        for t in range(len(columns)):
            at = state + columns[t]
            if out is not None:
                out[t] = self.emits[at]
            state = self.step[at]
        return state

    def scan(self, symbols: np.ndarray) -> np.ndarray:
        """What each symbol's transition emits, from the state at the beginning of a text on."""
        n = len(symbols)
        width = max(256, -(-n // LANES))
        lanes = max(1, -(-n // width))
        padded = np.full(lanes * width, END, np.int32)
        padded[:n] = symbols
        columns = np.ascontiguousarray(padded.reshape(lanes, width).T)
        first = np.zeros(lanes, np.int32)
        if lanes > 1:  # the last symbols of the lane before nearly always tell the state
            first[1:] = self._walk(columns[-self.memory :, :-1], np.zeros(lanes - 1, np.int32))
        out = np.empty(columns.shape, np.uint8)
        last = self._walk(columns, first, out)
        while len(wrong := np.flatnonzero(last[:-1] != first[1:]) + 1):
            first[wrong] = last[wrong - 1]
            again = np.empty((width, len(wrong)), np.uint8)
            last[wrong] = self._walk(columns[:, wrong], first[wrong], again)
            out[:, wrong] = again
        return np.ascontiguousarray(out.T).reshape(-1)[:n]


@dataclass
class Scanned:
    """Of the texts of a block: units, sentinels, and where the units end in the block's bytes."""

    units: np.ndarray
    sentinels: np.ndarray
    first_unit: np.ndarray
    unit_ends: np.ndarray
    code_points: np.ndarray
    offsets: np.ndarray

    def cut(self, k: int, units: int) -> int:
        """Byte after the first ``units`` units of text ``k``."""
        return int(self.unit_ends[self.first_unit[k] + units - 1]) if units else int(self.offsets[k])

    def chars(self, a: int, b: int) -> int:
        return int(self.code_points[b] - self.code_points[a])


def scan_block(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> Scanned:
    """One walk over the bytes of a block; ``offsets`` delimit its texts."""
    texts = len(offsets) - 1
    ends = offsets[1:] + np.arange(texts)  # places of the end-of-text symbols
    symbols = np.insert(data.astype(np.int32), offsets[1:], END) if texts else np.zeros(0, np.int32)
    emitted = automaton.scan(symbols)
    at = np.flatnonzero(emitted & UNIT)
    text = np.searchsorted(ends, at)
    first = np.searchsorted(text, np.arange(texts + 1))
    code_points = np.zeros(len(data) + 1, np.int64)
    is_byte = np.ones(len(symbols), bool)
    is_byte[ends] = False
    np.cumsum(emitted[is_byte] & CODE_POINT, out=code_points[1:])
    found = np.searchsorted(ends, np.flatnonzero(emitted & SENTINEL))
    return Scanned(
        units=np.diff(first),
        sentinels=np.bincount(found, minlength=texts),
        first_unit=first,
        unit_ends=np.minimum(at - text + 1, offsets[text + 1]),
        code_points=code_points,
        offsets=offsets,
    )


def draws(seed: str, key: object) -> list[int]:
    """Four unsigned 32-bit numbers of seed and key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def restore(output: str, form: str, settings: Settings | None = None) -> str:
    """The text that was transformed."""
    s = settings or Settings()
    if form == "plain":
        return output
    head, middle = output.split(s.middle)
    prefix, suffix = head.removeprefix(s.prefix).split(s.suffix) if form == "psm" else head.removeprefix(s.suffix).split(s.prefix)[::-1]
    return prefix + middle + suffix


def _rows(batch_texts: pa.Array, keys: list, s: Settings):
    """Per row: units, form, code points of prefix and middle, output."""
    marks = [x.encode() for x in (s.prefix, s.suffix, s.middle)]
    for first, last, data, offsets in text_blocks(batch_texts):
        found = scan_block(s.automaton, data, offsets)
        body = data.tobytes()
        for k in range(last - first):
            n, a, d = int(found.units[k]), int(offsets[k]), int(offsets[k + 1])
            h = draws(s.seed, keys[first + k])
            if a == d or found.sentinels[k] or h[2] % 100 >= s.rate:
                yield n, "plain", None, None, body[a:d]
                continue
            low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            b, c = found.cut(k, low), found.cut(k, high)
            prefix, middle, suffix = body[a:b], body[b:c], body[c:d]
            spm = h[3] % 100 < s.spm
            parts = (marks[1], suffix, marks[0], prefix) if spm else (marks[0], prefix, marks[1], suffix)
            yield n, "spm" if spm else "psm", found.chars(a, b), found.chars(b, c), b"".join([*parts, marks[2], middle])


def _mapped(docs: DataFrame, keep: list[str], text: str, key: str, s: Settings, output: Callable, added: list[T.StructField]) -> DataFrame:
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate([*fields, *added])])
    held = Shipped(docs.sparkSession, s)

    def run(batches):
        settings = held.value
        settings.ready()
        for batch in batches:
            kept = [batch.column(k + 2) for k in range(len(keep))]
            values = [output(row, settings) for row in _rows(batch.column(0), batch.column(1).to_pylist(), settings)]
            columns = list(zip(*values, strict=True)) if values else [()] * len(added)
            kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in added]
            arrays = [*kept, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    names = [*[f.name for f in fields], *[f.name for f in added]]
    picked = docs.select(docs[text].alias("t"), docs[key].alias("k"), *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)])
    return picked.mapInArrow(returns_memory(run), schema).toDF(*names)


def fill_in_middle(docs: DataFrame, *, text: str = "text", key: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """``docs`` with the transformed ``text``, and ``n``, ``form``, ``prefix_chars``, ``middle_chars`` added."""
    added = [T.StructField(free_column(docs, c), T.StringType() if c == "form" else T.LongType()) for c in ("n", "form", "prefix_chars", "middle_chars")]
    rest = [c for c in docs.columns if c != text]
    output = lambda row, _: (row[4].decode(), *row[:4])
    mapped = _mapped(docs, rest, text, key, settings or Settings(), output, [T.StructField(text, T.StringType()), *added])
    return mapped.select(*docs.columns, *[f.name for f in added])


def _digests(row, settings: Settings):
    n, form, prefix, middle, output = row
    restored = restore(output.decode(), form, settings).encode()
    return n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored).hexdigest()


def middle_report(docs: DataFrame, *, text: str = "text", key: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """Per document: units, form, code points of prefix and middle, digests of the output and of the text rebuilt from it."""
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output_sha256": T.StringType(), "restored_sha256": T.StringType()}
    return _mapped(docs, [key], text, key, settings or Settings(), _digests, [T.StructField(c, t) for c, t in kinds.items()])


#: DuckDB SQL for ``middle_report`` over ``documents``.
REPORT_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
cut AS (
  SELECT *, array_to_string(list_slice(units, 1, low), '') AS prefix, array_to_string(list_slice(units, low + 1, high), '') AS middle,
         array_to_string(list_slice(units, high + 1, n), '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""
