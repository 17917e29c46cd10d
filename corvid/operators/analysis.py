"""Mining of differences and training data, evaluation, answers, observation."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as X
from corvid.operators.ranking import small
from corvid.tables import Scratch, materialise


# --- mining -------------------------------------------------------------------------------------
def version_terms_diff(records: DataFrame) -> DataFrame:
    """Number of terms that each lineage gains and loses between adjacent versions; renamed if one of each.

    Terms are distinct rows, so no row holds the words of a group; a pair of versions meets term by term.
    """
    terms = records.select("lineage", "version", F.explode(X.tokenize("text")).alias("term")).distinct()
    own = records.select("lineage", "version").distinct()
    pairs = own.withColumn("next_version", F.lead("version").over(Window.partitionBy("lineage").orderBy("version"))).where("next_version is not null")
    pairs = small(pairs)
    left = terms.join(pairs, ["lineage", "version"]).select("lineage", "version", "term", F.lit(1).alias("old"), F.lit(0).alias("new"))
    right = terms.withColumnRenamed("version", "next_version").join(pairs, ["lineage", "next_version"]).select("lineage", "version", "term", F.lit(0).alias("old"), F.lit(1).alias("new"))
    met = left.unionByName(right).groupBy("lineage", "version", "term").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    n = met.groupBy("lineage", "version").agg(F.sum(F.col("new") * (1 - F.col("old"))).alias("n_added"), F.sum(F.col("old") * (1 - F.col("new"))).alias("n_removed"))
    out = pairs.join(n, ["lineage", "version"], "left").fillna(0, ["n_added", "n_removed"])
    return out.select("lineage", "version", "next_version", "n_added", "n_removed", ((F.col("n_added") == 1) & (F.col("n_removed") == 1)).alias("renamed"))


def combined_text(records: DataFrame) -> DataFrame:
    """Texts of a (lineage, version) in order of kind and line, joined by newlines."""
    rows = F.array_sort(F.collect_list(F.struct("kind", "line", "text")))
    return records.groupBy("lineage", "version").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def equivalent_versions(records: DataFrame) -> DataFrame:
    """For each (lineage, version), the versions whose multiset of (kind, text) is equal."""
    sets = records.groupBy("lineage", "version").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "text"))), lambda r: F.concat_ws("\x1f", r["kind"], r["text"])), "\x1e"), 256).alias("content"))
    same = sets.groupBy("lineage", "content").agg(F.array_sort(F.collect_list("version")).alias("versions"))
    return sets.join(same, ["lineage", "content"]).select("lineage", "version", "versions")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` over ``a, b`` links: the smallest label spreads until none changes.

    Labels are written to shared storage each round, so lineage stays short; a pointer jump per round
    makes the rounds logarithmic in the length of chains.
    """
    scratch = Scratch(links.sparkSession, "families")
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("u", "v"), "edges")
    labels = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label"))
    while True:
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("seen"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("up"))
        moved = labels.join(near, "u").withColumn("new", F.least("label", "seen")).select("u", F.col("label").alias("old"), F.col("new").alias("label"))
        moved = moved.join(jump, "label", "left").select("u", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        moved = scratch.keep(moved, "labels")
        if not moved.where("old <> label").take(1):
            scratch.clear("edges")
            return moved.select(F.col("u").alias("id"), F.col("label").alias("component"))
        labels = moved.select("u", "label")


def migrate_splits(labelled: DataFrame, comp: DataFrame) -> DataFrame:
    """Split of each component: protected or exposed keys force dev (if any is dev) else test; then blind;
    then dev if dev meets test; else the majority, ties in the order dev, test, train.

    ``labelled``: key, split, protected, exposed. ``comp``: key, component.
    """
    joined = labelled.join(comp, "key")
    has = lambda s: F.max((F.col("split") == s).cast("int")) == 1
    rank = F.when(F.col("split") == "dev", 0).when(F.col("split") == "test", 1).otherwise(2)
    counted = joined.groupBy("component", "split").agg(F.count("*").alias("n"), F.first(rank).alias("r")).groupBy("component").agg(F.min_by("split", F.struct(-F.col("n"), F.col("r"))).alias("majority"))
    flags = joined.groupBy("component").agg(F.max("protected").alias("p"), F.max("exposed").alias("e"), has("dev").alias("dev"), has("test").alias("test"), has("blind").alias("blind"))
    forced = F.when(F.col("dev"), "dev").otherwise("test")
    out = F.when(F.col("p") | F.col("e"), forced).when(F.col("blind"), "blind").when(F.col("dev") & F.col("test"), "dev").otherwise(F.col("majority"))
    return flags.join(counted, "component").select("component", out.alias("split"))


def leaking(passages: DataFrame, quotes: DataFrame) -> DataFrame:
    """``chunk_id, quote_id`` where the normalised quote stands in the normalised passage.

    A quote is keyed by the rarest of its inner words, which stand whole in any passage that holds it, by measured
    document frequency; the substring test follows. Passages are cut into words once, and of these only the words of quotes
    are written; only passages that meet the key of a quote are read again, and no text is shuffled while these are few.
    Quotes of one or two words may be cut inside words, so every passage is tested for these, in one pass over a list that
    is broadcast in blocks. The result is written once to shared storage.
    """
    q = materialise(quotes.select("quote_id", X.normalize("quote").alias("quote")).where("quote <> ''").withColumn("w", F.split("quote", " ")), "quotes")
    inner = q.where(F.size("w") > 2).select("quote_id", "quote", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("lead"))
    words = passages.select("chunk_id", F.explode(F.array_distinct(X.spaced("text"))).alias("lead"))
    words = materialise(words.join(small(inner.select("lead").distinct()), "lead", "left_semi"), "quote-words")
    frequency = words.groupBy("lead").agg(F.count("*").alias("df"))
    # a word that no passage has decides the quote as well: nothing can hold it
    rarest = inner.join(frequency, "lead", "left").groupBy("quote_id", "quote").agg(F.min_by("lead", F.struct(F.coalesce("df", F.lit(0)), "lead")).alias("lead"))
    met = materialise(words.join(small(rarest), "lead").select("chunk_id", "quote_id", "quote"), "quotes-met")
    # a generator of one row keeps a passage from being normalised once for each quote
    bodies = lambda rows: rows.select("chunk_id", F.explode(F.array(X.normalize("text"))).alias("body"))
    asked = passages.join(small(met.select("chunk_id").distinct()), "chunk_id", "left_semi")
    found = bodies(asked).join(small(met), "chunk_id").where(F.contains("body", F.col("quote"))).select("chunk_id", "quote_id")
    short = q.where(F.size("w") <= 2).select("quote_id", "quote")
    if short.take(1):
        block = F.array_agg(F.struct("quote_id", "quote"))
        lists = short.groupBy(F.pmod(F.xxhash64("quote_id"), F.lit(64)).alias("b")).agg(block.alias("list"))
        hits = bodies(passages).join(small(lists)).select("chunk_id", F.explode(F.filter("list", lambda x: F.contains(F.col("body"), x["quote"]))).alias("x"))
        found = found.union(hits.select("chunk_id", "x.quote_id"))
    return materialise(found.distinct(), "quotes-held")


def round_robin(rows: DataFrame, family: str, order: list[Column], budget: int) -> DataFrame:
    """Take one row of each family in turn until the budget is spent."""
    turn = F.row_number().over(Window.partitionBy(family).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", family).limit(budget)


def quota(rows: DataFrame, kind: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each kind, as many as its quota."""
    want = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in quotas.items()], F.lit(0))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("n") <= want)


def hard_negatives(rank_a: DataFrame, rank_b: DataFrame, allowed: DataFrame, low: int = 3, high: int = 30, limit: int = 8) -> DataFrame:
    """Candidates of ranks ``low``..``high`` of two rankings, interleaved; the first place of each counts."""
    place = lambda df, k: df.where(F.col("rank").between(low, high)).select("qid", "chunk_id", (F.col("rank") * 2 + k).alias("place"))
    both = place(rank_a, 0).union(place(rank_b, 1)).join(allowed, ["qid", "chunk_id"], "left_semi")
    first = both.groupBy("qid", "chunk_id").agg(F.min("place").alias("place"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("place", "chunk_id"))).where(F.col("n") <= limit)


def near_duplicate(a: str, b: str, ratio: float = 0.92) -> bool:
    """Equal after normalising, or alike by matching blocks; a blank text is like nothing."""
    a, b = (" ".join(x.split()).casefold() for x in (a, b))
    if not a or not b:
        return False
    if a == b:
        return True
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio


# --- evaluation ---------------------------------------------------------------------------------
def question_metrics(ranks: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall, completeness, reciprocal rank and nDCG of each question.

    ``ranks``: qid, rank, unit for each covered unit (null unit: nothing covered). ``relevant``: qid, total.
    A rank gains only if it covers a unit that no earlier rank did; the ideal has ``min(total, 10)`` gains.
    """
    first = ranks.where("unit is not null").groupBy("qid", "unit").agg(F.min("rank").alias("rank"))
    gains = first.where("rank <= 10").select("qid", "rank").distinct().groupBy("qid").agg(F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    found = first.groupBy("qid").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"f{k}") for k in ks], F.min("rank").alias("best"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = relevant.join(found, "qid", "left").join(gains, "qid", "left")
    share = lambda k: F.coalesce(F.col(f"f{k}"), F.lit(0)) / F.col("total")
    cols = [F.round(share(k), 6).alias(f"recall_{k}") for k in ks] + [(share(k) == 1).cast("int").alias(f"all_{k}") for k in ks]
    return out.select("qid", *cols, F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_10"))


def cohorts(rows: DataFrame, sets: list[list[str]], columns: list[str], metrics: list[Column]) -> DataFrame:
    """Metrics of several groupings in one pass."""
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grouping"), *metrics)


#: Clusters that one task resamples, about.
BUCKET_CLUSTERS = 1 << 18


def bucket_draws(seed: int, sizes: list[int], draws: int) -> np.ndarray:
    """How many of the clusters of each draw (row) come from each bucket (column): multinomial by the buckets' sizes."""
    n = sum(sizes)
    return np.random.default_rng([seed, 1 << 31]).multinomial(n, np.array(sizes, float) / n, size=draws)


def drawn_sums(seed: int, bucket: int, taken: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each draw the sums of values and of rows over what it takes from one bucket, with replacement.

    The first bucket draws from the stream of the seed itself, so a single bucket gives the plain bootstrap of the sorted clusters.
    """
    rng, tops, rows = np.random.default_rng([seed, bucket] if bucket else seed), np.empty(len(taken)), np.empty(len(taken))
    for d, k in enumerate(taken):
        times = np.bincount(rng.integers(0, len(s), k), minlength=len(s))
        tops[d], rows[d] = times @ s, times @ n
    return tops, rows


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """``mean, low, high, clusters``: mean and 95 % interval from resampling whole clusters.

    A draw of as many clusters as there are is split: first how many fall on each bucket of clusters, then which of the
    bucket, in the bucket's own task. Buckets go by hash of the cluster, so results do not depend on partitions; only
    ``draws`` sums a bucket are shuffled. Without rows there is no result row.
    """
    scratch = Scratch(rows.sparkSession, "bootstrap")
    sums = scratch.keep(rows.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n")), "sums")
    total = sums.count()
    buckets = max(1, -(-total // BUCKET_CLUSTERS))
    bucketed = sums.withColumn("bucket", F.pmod(F.xxhash64("c"), F.lit(buckets)))
    sizes = {r.bucket: r["count"] for r in bucketed.groupBy("bucket").count().collect()}
    order = sorted(sizes)
    taken = bucket_draws(seed, [sizes[b] for b in order], draws) if total else np.zeros((draws, 0), int)
    column = {b: k for k, b in enumerate(order)}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c", na_position="first")
        tops, counts = drawn_sums(seed, int(key[0]), taken[:, column[key[0]]], frame["s"].fillna(0.0).to_numpy(float), frame["n"].to_numpy(float))
        return pd.DataFrame({"draw": np.arange(draws), "s": tops, "n": counts})

    drawn = bucketed.groupBy("bucket").applyInPandas(run, "draw long, s double, n double").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    spread = drawn.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    whole = sums.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("clusters")).where("clusters > 0")
    return whole.crossJoin(spread).select("mean", "low", "high", "clusters")


def paired_bootstrap(rows: DataFrame, cluster: str, left: str, right: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """``cluster_bootstrap`` of left minus right, the same clusters drawn for both, and whether 0 is in the interval.

    Rows without one of the two values are no pairs and are left out.
    """
    pairs = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(cluster, (F.col(left) - F.col(right)).alias("difference"))
    return cluster_bootstrap(pairs, cluster, "difference", draws, seed).withColumn("within_noise", F.lit(0.0).between(F.col("low"), F.col("high")))


def best_threshold(rows: DataFrame, score: str, label: str, steps: int = 21) -> DataFrame:
    """Threshold of best balanced accuracy on a grid over 0..1; the lowest wins ties."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.round(i / F.lit(float(steps - 1)), 6))
    t = rows.select(score, label, F.explode(grid).alias("threshold"))
    hit = (F.col(score) >= F.col("threshold")).cast("int")
    per = t.groupBy("threshold").agg(F.avg(F.when(F.col(label) == 1, hit)).alias("tpr"), F.avg(F.when(F.col(label) == 0, 1 - hit)).alias("tnr"))
    return per.select("threshold", F.round((F.col("tpr") + F.col("tnr")) / 2, 6).alias("balanced_accuracy")).orderBy(F.desc("balanced_accuracy"), "threshold").limit(1)


# --- answers ------------------------------------------------------------------------------------
def context_budget(matches: DataFrame, limit: int) -> DataFrame:
    """Texts in rank order cut to the characters that are left; nothing after the budget is spent."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return matches.withColumn("left", limit - used).where("left > 0").withColumn("text", F.expr("substring(text, 1, cast(left as int))")).where("text <> ''").drop("left")


def extractive_answers(matches: DataFrame, queries: DataFrame, stopwords: list[str], min_score: float = 0.0, sentences: int = 3) -> DataFrame:
    """Best sentences of the first usable matches, in order, without repeats."""
    terms = F.array_except(F.array_distinct(X.tokenize("query")), F.array(*[F.lit(s) for s in stopwords]))
    usable = matches.join(queries.select("qid", "query"), "qid").withColumn("terms", terms).where((F.col("score") >= min_score) & F.arrays_overlap("terms", X.tokenize("text")))
    first = usable.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("n") <= sentences)
    picked = first.withColumn("s", X.best_sentence("text", F.col("terms")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"])
    return picked.groupBy("qid").agg(F.concat(F.lit("Based on the indexed evidence: "), F.array_join(F.array_distinct(ordered), " ")).alias("answer"), F.count("*").alias("n_citations"))


# --- observation --------------------------------------------------------------------------------
#: Ranges into which the values of a group are cut to find a rank.
RANGES = 512


def values_at(rows: DataFrame, by: list[str], value: str, places: list[Column], names: list[str]) -> DataFrame:
    """``by, n`` and for each name the value at a place (from 1, in terms of ``n``) of the sorted group; nulls left out.

    Groups may be of any size: values are cut into ranges by approximate quantiles, the range that holds a place is
    found from counts, and only rows of such ranges are put in order. Equal values lie in one range, as counted values.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    cuts = own.groupBy(*by).agg(F.array_distinct(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).alias("cuts"), F.count("*").alias("n"))
    held = own.groupBy(*by, "v").agg(F.count("*").alias("c")).join(cuts, by).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    parts = held.groupBy(*by, "part").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = parts.withColumn("want", F.explode(F.array(*[F.struct(F.lit(m).alias("name"), p.cast("long").alias("place")) for m, p in zip(names, places, strict=True)])))
    at = at.where((F.col("want.place") > F.col("before")) & (F.col("want.place") <= F.col("before") + F.col("c"))).select(*by, "part", "before", "want.name", "want.place")
    inside = held.select(*by, "part", "v", "c").join(at, [*by, "part"])
    order = Window.partitionBy(*by, "part", "name").orderBy("v")
    inside = inside.withColumn("upto", F.col("before") + F.sum("c").over(order)).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place")))
    found = inside.groupBy(*by).agg(*[F.max(F.when(F.col("name") == m, F.col("v"))).alias(m) for m in names])
    return cuts.select(*by, "n").join(found, by, "left")


def percentiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``by, n`` and continuous percentiles: between the two nearest places, by distance."""
    places, names = [], []
    for name, q in qs.items():
        at = (F.col("n") - 1) * F.lit(q)
        places += [F.floor(at) + 1, F.ceil(at) + 1]
        names += [f"{name}_low", f"{name}_high"]
    v = values_at(rows, by, value, places, names)
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return v.select(*by, "n", *[F.round(F.col(f"{m}_low") + part(q) * (F.col(f"{m}_high") - F.col(f"{m}_low")), 6).alias(m) for m, q in qs.items()])


def latency_summary(traces: DataFrame, by: list[str], latency: str) -> DataFrame:
    """Count, mean and continuous percentiles of latency."""
    mean = traces.groupBy(*by).agg(F.round(F.avg(latency), 6).alias("mean"))
    return percentiles(traces, by, latency, {"p50": 0.5, "p95": 0.95}).join(mean, by).select(*by, "n", "mean", "p50", "p95")


def nearest_rank(traces: DataFrame, by: list[str], latency: str, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles as the value at place ``min(n, floor(n q) + 1)`` of the sorted group."""
    names = [f"rank_p{int(q * 100)}" for q in qs]
    v = values_at(traces, by, latency, [F.least(F.col("n"), F.floor(F.col("n") * q) + 1) for q in qs], names)
    return v.select(*by, "n", *[F.round(m, 6).alias(m) for m in names])


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Each event with the number of the key's events in the ``seconds`` up to it, and whether it is over the limit."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > limit)
