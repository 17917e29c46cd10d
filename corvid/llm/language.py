"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language over characters of lower-cased words with boundary marks. The models share,
for each order, one sorted array of 64-bit n-gram hashes; beside each hash stand, per language, the
discounted probability and the interpolation weight, so one binary search serves all languages.
The language of lowest cross-entropy per character wins; a softmax with a temperature fitted on
left-out training rows gives the confidence, and a text whose cross-entropy lies beyond that
language's calibrated quantile is flagged as rejected.

Models are fitted on a bounded sample of rows (``LanguageSettings.documents`` per language, those of
smallest hashed id); every row is predicted over its whole text.

Defined results: ``und`` with score 0 for a null text or one without letters; without any training
row all texts are ``und``; repeated rows get equal results; a tie goes to the language first in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .cluster import Shipped
from .quality import fold
from .text_arrays import WordHasher, mix

UNKNOWN = "und"
_MARK = 0x110000
SALTS = 64


@dataclass(frozen=True)
class LanguageSettings:
    """Bounds of the training sample, order of the models, calibration."""

    documents: int = 400
    order: int = 5
    calibration_share: int = 5
    reject_quantile: float = 0.999
    block_chars: int = 2 << 20


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Words:
    """Words of lower-cased texts as code-point arrays; distinct words are found by their hashes."""

    def __init__(self, letters: np.ndarray) -> None:
        self.letters, self.hasher = letters, WordHasher()
        self.every_byte = None

    def blocks(self, texts: list[str | None], block_chars: int):
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < block_chars):
                size += len(texts[last] or "")
                last += 1
            lowered = [(t or "").lower() for t in texts[first:last]]
            offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)))
            points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = self.letters[points]
            edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            starts, ends = edge[0::2], edge[1::2]
            yield first, last, points, starts, ends, np.searchsorted(starts, offsets)
            first = last

    def distinct(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """First occurrences of distinct words, the number of each word, and how often each occurs."""
        hashes = self.hasher(points.view(np.uint8), starts * 4, ends * 4)
        _, where, number, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        return where, number, count


def ngram_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int):
    """Characters of marked words end to end and, for n = 1..order, the hash of the n-gram that ends there.

    Each word is followed by one end mark; n-grams never reach before the start mark of their word,
    where they are padded with it. Returns word sizes (with the end mark) and a list of hash arrays.
    """
    sizes = ends - starts + 1
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    begin = np.repeat(stops - sizes, sizes)
    place = np.arange(total) - begin
    source = np.repeat(starts, sizes) + place
    chars = np.where(place == np.repeat(sizes - 1, sizes), _MARK, points[np.minimum(source, max(len(points) - 1, 0))] if total else 0).astype(np.uint64)
    out, current = [], mix(chars + np.uint64(1))
    out.append(current)
    for n in range(2, order + 1):
        back = place - (n - 1)
        before = np.where(back >= 0, chars[np.maximum(np.arange(total) - (n - 1), 0)], np.uint64(_MARK + 1))
        current = mix(current * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(n))
        out.append(current)
    return sizes, out


def context_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int):
    """For n = 2..order, the hash of the n - 1 characters before each character of the marked words."""
    sizes = ends - starts + 1
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    place = np.arange(total) - np.repeat(stops - sizes, sizes)
    chars = points[np.minimum(np.repeat(starts, sizes) + place, max(len(points) - 1, 0))].astype(np.uint64) if total else np.zeros(0, np.uint64)
    out, current = [], np.full(total, 7, dtype=np.uint64)
    for n in range(2, order + 1):
        back = place - (n - 1)
        before = np.where(back >= 0, chars[np.maximum(np.arange(total) - (n - 1), 0)], np.uint64(_MARK + 1))
        current = mix(current * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(n))
        out.append(current)
    return out


@dataclass
class KneserNey:
    """Sorted hash arrays per order; row ``i`` of a value array belongs to hash ``i``, one column a language.

    The last row of every value array stands for hashes that are not there.
    """

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    discounted: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    uniform: float

    @staticmethod
    def _find(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(table, hashes)
        found = at < len(table)
        found[found] = table[at[found]] == hashes[found]
        return np.where(found, at, len(table))

    def log_probabilities(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log-probability of each marked word under each language."""
        sizes, grams = ngram_hashes(points, starts, ends, self.order)
        contexts = context_hashes(points, starts, ends, self.order)
        p = self.discounted[0][self._find(self.grams[0], grams[0])] + self.weights[0][0] * self.uniform
        for n in range(1, self.order):
            weight = self.weights[n][self._find(self.contexts[n], contexts[n - 1])]
            p = self.discounted[n][self._find(self.grams[n], grams[n])] + weight * p
        if not len(sizes):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(np.log(p), np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, number = np.unique(keys, return_inverse=True)
    return unique, np.bincount(number, weights=values, minlength=len(unique))


def fit_kneser_ney(texts: dict[str, list[str]], words: Words, settings: LanguageSettings) -> KneserNey:
    """Interpolated Kneser-Ney: raw counts at the top order, continuation counts below it."""
    languages, order = sorted(texts), settings.order
    counted: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order)]
    for name in languages:
        pieces: list[list[np.ndarray]] = [[] for _ in range(order)]
        for _, _, points, starts, ends, _ in words.blocks(texts[name], settings.block_chars):
            where, _, count = words.distinct(points, starts, ends)
            sizes, grams = ngram_hashes(points, starts[where], ends[where], order)
            contexts = context_hashes(points, starts[where], ends[where], order)
            weight = np.repeat(count.astype(np.float64), sizes)
            for n in range(order):
                above = grams[n + 1] if n + 1 < order else grams[n]
                context = contexts[n - 1] if n else np.zeros(len(grams[0]), np.uint64)
                pieces[n].append((above, grams[n], context, weight))
        for n in range(order):
            above, gram, context, weight = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (list(zip(*pieces[n], strict=True)) or [()] * 4))
            if n + 1 < order:  # each distinct longer n-gram counts once
                _, first = np.unique(above, return_index=True)
                gram, context, weight = gram[first], context[first], np.ones(len(first))
            keys, count = _grouped(gram, weight)
            _, first = np.unique(gram, return_index=True)
            counted[n].append((keys, count, context[first]))
    model = KneserNey(languages, order, [], [], [], [], 0.0)
    for n in range(order):
        keys = np.unique(np.concatenate([k for k, _, _ in counted[n]])) if languages else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([c for _, _, c in counted[n]])) if languages else np.zeros(0, np.uint64)
        discounted = np.zeros((len(keys) + 1, len(languages)))
        weights = np.ones((len(contexts) + 1, len(languages)))
        for j, (k, count, context) in enumerate(counted[n]):
            ones, twos = int((count == 1).sum()), int((count == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            c, total = _grouped(context, count)
            _, kinds = _grouped(context, np.ones(len(context)))
            at = np.searchsorted(c, context)
            discounted[np.searchsorted(keys, k), j] = np.maximum(count - discount, 0) / total[at]
            weights[np.searchsorted(contexts, c), j] = discount * kinds / total
        model.grams.append(keys)
        model.discounted.append(discounted)
        model.contexts.append(contexts)
        model.weights.append(weights)
    model.uniform = 1.0 / (len(model.grams[0]) + 1)
    return model


@dataclass
class Identifier:
    """The models with what calibration has found."""

    model: KneserNey
    letters: np.ndarray
    block_chars: int
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def entropies(self, texts: list[str | None]):
        """Yield, per block of texts, cross-entropy per character by language and characters scored."""
        words = Words(self.letters)
        for first, last, points, starts, ends, bounds in words.blocks(texts, self.block_chars):
            n = last - first
            total, chars = np.zeros((n, len(self.model.languages))), np.zeros(n)
            if len(starts) and self.model.languages:
                where, number, _ = words.distinct(points, starts, ends)
                logs = self.model.log_probabilities(points, starts[where], ends[where])
                doc = np.repeat(np.arange(n), np.diff(bounds))
                for j in range(total.shape[1]):
                    total[:, j] = np.bincount(doc, weights=logs[number, j], minlength=n)
                chars = np.bincount(doc, weights=ends - starts + 1, minlength=n)
            yield -total / np.maximum(chars, 1)[:, None], chars

    def predict(self, texts: list[str | None]):
        """Language, confidence and rejection of each text."""
        names, scores, rejected = [], [], []
        for entropy, chars in self.entropies(texts):
            if not self.model.languages:
                chars = np.zeros(len(chars))
                entropy = np.zeros((len(chars), 1))
            best = entropy.argmin(axis=1)
            share = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) / self.temperature)
            score = 1.0 / share.sum(axis=1)
            known = chars > 0
            names += [self.model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, score, 0.0))
            beyond = entropy[np.arange(len(best)), best] > self.limits[best] if self.limits is not None and len(self.model.languages) else np.zeros(len(best), bool)
            rejected.append(~known | beyond)
        return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def calibrate(identifier: Identifier, texts: dict[str, list[str]], settings: LanguageSettings) -> None:
    """Temperature of least log-loss over a grid, and each language's entropy quantile, on left-out rows."""
    languages = identifier.model.languages
    rows, truth = [], []
    for name, values in texts.items():
        if name not in languages:
            continue
        for entropy, chars in identifier.entropies(values):
            rows.append(entropy[chars > 0])
            truth += [languages.index(name)] * int((chars > 0).sum())
    if not truth:
        return
    entropy, truth = np.concatenate(rows), np.array(truth)
    own = entropy[np.arange(len(truth)), truth]

    def loss(t: float) -> float:
        z = -(entropy - entropy.min(axis=1, keepdims=True)) / t
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]).mean())

    identifier.temperature = min(np.geomspace(0.02, 2.0, 25), key=loss)
    whole = np.quantile(own, settings.reject_quantile)
    identifier.limits = np.array([np.quantile(own[truth == j], settings.reject_quantile) if (truth == j).any() else whole for j in range(len(languages))])


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: LanguageSettings = LanguageSettings()) -> Identifier:
    """Fit and calibrate on at most ``settings.documents`` rows of each language; ``docs`` are training rows.

    Ids are ranked by hash within a language, then at most that many ids are broadcast to fetch texts.
    """
    first = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    ids = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, lang)
    # a language may hold most rows, so its first rows are taken per salt, then among those
    salted = ids.withColumn("_salt", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(1)), F.lit(SALTS)))
    for by in ([lang, "_salt"], [lang]):
        salted = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*first))).where(F.col("_rank") <= settings.documents)
    chosen = salted.select(key).distinct()
    picked = docs.where(F.col(lang).isNotNull()).join(F.broadcast(chosen), key, "left_semi").select(key, lang, text)
    # repeats of an id would multiply what is fetched, so an id counts once
    least = F.min(F.struct(F.col(lang).alias("l"), F.col(text).alias("t"))).alias("s")
    picked = picked.groupBy(key).agg(least).select(key, "s.l", "s.t")
    fitting: dict[str, list[str]] = {}
    left_out: dict[str, list[str]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r[1], str(r[0]), r[2] or "")):
        group = left_out if hash_share(row[0], settings.calibration_share) else fitting
        group.setdefault(row[1], []).append(row[2])
    for name in set(left_out) - set(fitting):
        fitting[name] = left_out[name]
    letters = letter_table()
    identifier = Identifier(fit_kneser_ney(fitting, Words(letters), settings), letters, settings.block_chars)
    calibrate(identifier, left_out or fitting, settings)
    return identifier


def hash_share(key: object, share: int) -> bool:
    """Whether a row is left out for calibration: one in ``share``."""
    import zlib

    return zlib.crc32(f"calibration:{key}".encode()) % share == 0


def identify(docs: DataFrame, identifier: Identifier, *, text: str = "text") -> DataFrame:
    """``docs`` with columns ``lang_pred``, ``score`` and ``rejected``, in place of ones that have these names."""
    holder = Shipped(docs.sparkSession, identifier)
    docs = docs.drop(*[c for c in ("lang_pred", "score", "rejected") if c != text])
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            names, scores, rejected = holder.value.predict(batch.column(place).to_pylist())
            table = pa.Table.from_batches([batch]).append_column("lang_pred", pa.array(names, pa.string()))
            table = table.append_column("score", pa.array(scores, pa.float64())).append_column("rejected", pa.array(rejected, pa.bool_()))
            yield from table.to_batches()

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def language_report(docs: DataFrame, *, held_out: Column | None = None, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 are held out of training."""
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)) if held_out is None else held_out
    identifier = train(docs.where(~held_out), settings=settings)
    found = identify(docs.select("doc_id", "text"), identifier)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
