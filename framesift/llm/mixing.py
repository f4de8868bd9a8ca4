"""Mixing documents to target domain weights with soft memberships.

A classifier fitted on a table of labelled documents gives each document the
probabilities of its domains. Nonnegative rates for the documents are then
fitted by least squares, so that the tokens expected of each domain (rate x
tokens x probability, summed) meet their targets. The fit is a projected
gradient with steps that take the gradient at their own end, which lets them be
long: a step is found from the domains' totals alone, some aggregates over the
documents, and moves each document by itself. Documents of equal memberships
move alike, so the aggregates are over distinct ones.

Everything here is DataFrame and SQL expressions.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, drop_written, keyed, with_row_key, write_shared
from framesift.operators.keys import filter_by_keys

log = logging.getLogger(__name__)

#: Buckets that words are hashed to.
BUCKETS = 1 << 17

#: Documents added to those seen of a bucket in a domain and those expected from the
#: other domains, the least logarithm of their ratio that tells something, and the least
#: excess over the expected number in its standard deviations, times the root of the
#: logarithm of the number of buckets.
#: What is only a little more frequent in one domain, as the words of a language may be,
#: or was seen a few times by chance, would add up over a long text.
ADDED, LEAST_LOG, LEAST_EXCESS = 0.5, 1.6, 1.7

#: Labelled rows the classifier is fitted on, about, where there are more: the
#: first in the order of a hash of their id.
TRAIN_ROWS = 200_000

#: Largest miss of a target, as a share of it, at which the fit is done; and the
#: largest share by which the least squares may be above their minimum, where targets are missed.
TOLERANCE, GAP = 1e-4, 0.01

#: Length of the first step beside that of a plain gradient step, and of each step beside the one before.
FIRST_STEP, LONGER = 10.0, 10.0

#: Steps, and aggregates for one step, after which the fit is given up as not converging.
MOST_STEPS, MOST_TRIES = 16, 60

#: Shares of a Newton step that are tried, those in brackets together, until one comes nearer.
TRIED = ((1.0,), (0.3, 0.1, 0.03), (0.01, 1e-3, 1e-4))

#: Least share of all tokens that a target's weight in the least squares is taken from.
LEAST_SHARE = 0.01


def _words(text: Column) -> Column:
    """Lower-case words and runs of ASCII signs, with an empty word at either end perhaps, and if there are none."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([!-/:-@\[-`{-~]+)", " $1 ")
    return F.split(apart, r"\s+")


def _buckets(words: Column, buckets: int) -> Column:
    """The buckets of a text's words, each once."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def _count(words: Column) -> Column:
    """How many of `_words` are words."""
    ends = (F.element_at(words, 1) == "").cast("long") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("long")
    return F.size(words) - ends


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    buckets: int = BUCKETS,
    train_rows: int = TRAIN_ROWS,
) -> tuple[list[str], DataFrame, DataFrame]:
    """Naive Bayes on hashed words: domains, the labels it was fitted on, and (bucket, weights).

    A bucket tells of a domain whose documents have it much more often than those
    of the others. ``weights`` has the logarithm of how much, or 0, per domain; the
    table has at most ``buckets`` rows. Labels with a null id or domain are left
    out, and so are those of unknown documents; a document labelled twice counts
    for both labels.
    """
    known = labels.select(F.col(id_col).alias("_label_id"), F.col(domain_col).cast("string").alias("_domain")).dropna()
    known = known.distinct()
    share = min(1.0, train_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("_label_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col).alias("_text"))
    # about train_rows rows of an id and a short name: bounded by that parameter
    labelled = texts.join(F.broadcast(chosen), "_label_id").select("_domain", _words(F.col("_text")).alias("words"))
    # the outer form: for the inner one Spark splits the text a second time, to see if there are words
    exploded = labelled.select("_domain", F.explode_outer(_buckets(F.col("words"), buckets)).alias("bucket"))
    counts = write_shared(exploded.groupBy("_domain", "bucket").agg(F.count("*").alias("n")), "domain-words")
    sizes = texts.join(F.broadcast(chosen), "_label_id").groupBy("_domain").agg(F.count("*").alias("n"))
    sizes = {r._domain: r.n for r in sizes.collect()}  # a row per domain
    domains = sorted(sizes)
    spark = docs.sparkSession
    if not domains:
        none = spark.range(0).select(F.col("id").cast("int").alias("bucket"), F.array().cast("array<double>").alias("weights"))
        return [], chosen, none
    total = float(sum(sizes.values()))
    by_domain = [F.sum(F.when(F.col("_domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    seen = counts.groupBy("bucket").agg(F.sum("n").alias("n"), *by_domain)
    excess = LEAST_EXCESS * math.sqrt(math.log(max(2, seen.count())))
    logs = []
    for i, domain in enumerate(domains):
        expected = (F.col("n") - F.col(f"n{i}")) * (sizes[domain] / max(1.0, total - sizes[domain]))
        log = F.log((F.col(f"n{i}") + ADDED) / (expected + ADDED))
        telling = (log >= LEAST_LOG) & (F.col(f"n{i}") - expected >= excess * F.sqrt(F.greatest(expected, F.lit(ADDED))))
        logs.append(F.when(telling, log).otherwise(0.0))
    weights = seen.select("bucket", F.array(*logs).alias("weights")).filter(F.exists("weights", lambda x: x != 0))
    return domains, chosen, write_shared(weights, "domain-weights")


def memberships(
    docs: DataFrame,
    domains: list[str],
    chosen: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """(row key, _id, _tokens, _p) with the probability of each domain, in order.

    Tokens are the words the classifier sees. A text with words that tell of a
    domain has their weights there; for one without any, what counts is how
    often the labelled documents of the domain have none, beside all of them.
    """
    rows = keyed(docs, id_col, _text=text_col).select(ROW, "_id", _words(F.col("_text")).alias("words"))
    exploded = rows.select(
        ROW, "_id", _count(F.col("words")).alias("_tokens"), F.explode_outer(_buckets(F.col("words"), buckets)).alias("bucket")
    )
    told = exploded.join(F.broadcast(weights), "bucket", "left")
    sums = [F.sum(F.coalesce(F.col("weights")[i], F.lit(0.0))).alias(f"s{i}") for i in range(len(domains))]
    scored = told.groupBy(ROW, "_id").agg(F.max("_tokens").alias("_tokens"), *sums)
    scores = []
    if domains:
        scored = write_shared(scored, "scores")
        without = [F.sum((F.col(f"s{i}") == 0).cast("long")).alias(f"none{i}") for i in range(len(domains))]
        labelled = scored.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))  # bounded as in fit_domains
        known = {r._domain: r for r in labelled.groupBy("_domain").agg(F.count("*").alias("n"), *without).collect()}
        total = sum(r.n for r in known.values())
        for i, domain in enumerate(domains):
            every = sum(r[f"none{i}"] for r in known.values())
            none = math.log((known[domain][f"none{i}"] + 1) / (known[domain].n + 2)) - math.log((every + 1) / (total + 2))
            score = F.when(F.col(f"s{i}") != 0, F.col(f"s{i}")).otherwise(none) + math.log(known[domain].n / total)
            scores.append(score)
    most = F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else F.lit(0.0)
    shares = F.array(*(F.exp(s - most) for s in scores)).cast("array<double>")
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("shares", shares).select(
        ROW, "_id", "_tokens", F.transform("shares", lambda x: x / total).alias("_p")
    )


def _dot(factors: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for i, factor in enumerate(factors):
        total = total + F.col("_p")[i] * F.lit(float(factor))
    return total


def _within(rate: Column, most_rate: float | None) -> Column:
    rate = F.greatest(F.lit(0.0), rate)
    return rate if most_rate is None else F.least(F.lit(float(most_rate)), rate)


@dataclass
class _Step:
    """What a step of length ``length`` along the gradient given by ``pull`` (one number per domain) comes to."""

    dual: float  # least at the step's own end
    expected: np.ndarray
    free: np.ndarray  # gram matrix of the documents that no bound holds


def _tried(kinds: DataFrame, rate: Column, length: float, pulls: list[np.ndarray], goal: np.ndarray, scale: np.ndarray, most_rate: float | None) -> list[_Step]:
    """One aggregate over the memberships for several pulls."""
    domains = range(len(goal))
    pairs = [(i, j) for i in domains for j in range(i, len(goal))]
    rows, sums = kinds.withColumn("_rate", rate), []
    for n, pull in enumerate(pulls):
        along = _dot(pull)
        raw = F.col("_rate") - F.lit(length) * along
        new = _within(raw, most_rate)
        cost = new * along + (new - F.col("_rate")) * (new - F.col("_rate")) / (2 * length)
        free = (raw > 0) if most_rate is None else (raw > 0) & (raw < most_rate)
        sums.append(F.sum(F.col("_tokens") * cost).alias(f"c{n}"))
        sums += [F.sum(F.col("_tokens") * new * F.col("_p")[i]).alias(f"e{n}_{i}") for i in domains]
        freed = F.when(free, F.col("_tokens")).otherwise(0)
        sums += [F.sum(freed * F.col("_p")[i] * F.col("_p")[j]).alias(f"g{n}_{i}_{j}") for i, j in pairs]
    seen = rows.agg(*sums).first()
    found = []
    for n, pull in enumerate(pulls):
        gram = np.array([[seen[f"g{n}_{min(i, j)}_{max(i, j)}"] for j in domains] for i in domains], dtype=float)
        dual = float((pull**2 / (4 * scale)).sum() + pull @ goal - seen[f"c{n}"])
        found.append(_Step(dual, np.array([seen[f"e{n}_{i}"] for i in domains], dtype=float), gram))
    return found


def _gap(kinds: DataFrame, rate: Column, expected: np.ndarray, goal: np.ndarray, scale: np.ndarray, most_rate: float | None) -> float:
    """By how much the loss can be above its minimum at most: what the gradient promises within the bounds."""
    slope = _dot(2 * scale * (expected - goal))
    up = F.lit(0.0) if most_rate is None else F.col("_rate") - F.lit(float(most_rate))
    promised = F.when(slope > 0, slope * F.col("_rate")).otherwise(slope * up)
    endless = F.lit(False) if most_rate is not None else slope < 0
    seen = kinds.withColumn("_rate", rate).agg(F.sum(F.col("_tokens") * promised).alias("gap"), F.max(endless).alias("endless")).first()
    return math.inf if seen.endless else float(seen.gap)


def fit_rates(
    rows: DataFrame,
    domains: list[str],
    targets: Mapping[str, float],
    budget: float | None = None,
    relative: bool = False,
    tolerance: float = TOLERANCE,
    gap: float = GAP,
    most_steps: int = MOST_STEPS,
    most_rate: float | None = None,
) -> tuple[DataFrame, list[dict]]:
    """``rows`` (of `memberships`, written) with a ``rate``, and what became of each domain.

    Minimises the sum over domains of (expected tokens - target)^2 / target
    over rates that are not negative, nor above ``most_rate``, starting from 1. Distances between rates
    count by the documents' tokens, so that one step moves equal documents
    alike whatever their length. ``targets`` are weights of the domains, or with
    ``relative`` what their own shares of the tokens are multiplied by; with no
    ``budget`` of tokens it is the largest at which no domain needs more than
    it has.

    A step goes from the rates r to P(r - c g), P being the projection onto the
    bounds and g the gradient at the new rates. As the gradient is made of one
    number per domain, these are found by Newton's method on as many unknowns.
    The fit ends when every target is met up to ``tolerance``, or when the loss
    is proven to be within a share ``gap`` of its minimum; a report with
    ``converged`` false says that neither happened in ``most_steps`` steps.
    """
    unknown = set(targets) - set(domains)
    if unknown or (domains and not sum(targets.values()) > 0) or any(w < 0 for w in targets.values()):
        raise ValueError(f"targets must be weights of known domains, not {dict(targets)} of {domains}")
    if not domains:
        return rows.withColumn("rate", F.lit(1.0)), []
    kinds = write_shared(rows.groupBy("_p").agg(F.sum("_tokens").alias("_tokens")).filter("_tokens > 0"), "kinds")
    ones = [np.zeros(len(domains))]
    seen = _tried(kinds, F.lit(1.0), 1.0, ones, np.zeros(len(domains)), np.ones(len(domains)), None)[0] if not kinds.isEmpty() else None
    there = seen.expected if seen else np.zeros(len(domains))
    weight = [targets.get(d, 0.0) * (t if relative else 1.0) for d, t in zip(domains, there)]
    weight = [w / (sum(weight) or 1.0) for w in weight]
    if budget is None:
        budget = min((t / w for t, w in zip(there, weight) if w > 0), default=0.0)
    goal = np.array([w * budget for w in weight])
    if not there.sum() or not budget:
        return rows.withColumn("rate", F.lit(1.0)), [
            {"domain": d, "tokens": t, "target": g, "expected": t, "met": t == g, "gap": 0.0, "steps": 0, "converged": True}
            for d, t, g in zip(domains, there.tolist(), goal.tolist())
        ]
    scale = 1 / np.maximum(goal, LEAST_SHARE * goal.sum())
    near = tolerance / scale
    root = np.sqrt(scale)
    length = FIRST_STEP / float(np.linalg.eigvalsh(seen.free * np.outer(root, root)).max())

    rate, expected, pull = F.lit(1.0), there, np.zeros(len(domains))
    steps, above, converged = 0, math.inf, bool((np.abs(expected - goal) <= near).all())
    while not converged and steps < most_steps:
        best = _tried(kinds, rate, length, [pull], goal, scale, most_rate)[0]
        for _ in range(MOST_TRIES):
            miss = pull / (2 * scale) + goal - best.expected  # zero at the step's own end
            if (np.abs(miss) <= 1e-3 * near).all():
                break
            bend = (np.diag(1 / (2 * scale)) + length * best.free) * np.outer(root, root)
            newton = -root * np.linalg.solve(bend, root * miss)
            for shares in TRIED:
                pulls = [pull + share * newton for share in shares]
                tried = _tried(kinds, rate, length, pulls, goal, scale, most_rate)
                least = min(range(len(tried)), key=lambda n: tried[n].dual)
                if tried[least].dual < best.dual:
                    break
            else:
                break
            pull, best = pulls[least], tried[least]
        rate = _within(rate - F.lit(length) * _dot(pull), most_rate)
        expected, steps, length = best.expected, steps + 1, LONGER * length
        loss = float((scale * (expected - goal) ** 2).sum())
        above = _gap(kinds, rate, expected, goal, scale, most_rate)
        converged = bool((np.abs(expected - goal) <= near).all()) or above <= gap * max(loss - above, 0.0)
    drop_written(kinds)
    report = [
        {"domain": d, "tokens": t, "target": g, "expected": e, "met": abs(e - g) <= n, "gap": above, "steps": steps, "converged": converged}
        for d, t, g, e, n in zip(domains, there.tolist(), goal.tolist(), expected.tolist(), near.tolist())
    ]
    for line in report:
        if not line["met"]:
            log.warning("target of %(domain)s missed: %(expected).0f tokens for %(target).0f; fit converged: %(converged)s", line)
    return rows.withColumn("rate", rate), report


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    budget: float | None = None,
    relative: bool = False,
    buckets: int = BUCKETS,
    train_rows: int = TRAIN_ROWS,
    most_rate: float | None = None,
    report: list[dict] | None = None,
) -> DataFrame:
    """One row per document: (id, n_tokens, memberships, rate, copies).

    ``memberships`` maps domains to probabilities. ``copies`` realises the
    rate: its whole part, and one more for the share of documents, by a hash of
    the id, that its fraction says. Targets that no rates can meet are missed by
    as little as the least squares allow, up to a share `GAP`; they are logged, and
    ``report`` is given the lines of `fit_rates`. No rate is above ``most_rate``.

    Null and empty texts have no tokens and the memberships of a text without
    any telling word. Repeated ids are rows of their own, rows with a null id
    too. Without any labels every rate is 1. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = with_row_key(docs.select(*dict.fromkeys([id_col, text_col, *({ROW} & set(docs.columns))])), id_col)
    domains, chosen, weights = fit_domains(rows, labels, id_col, text_col, domain_col, buckets, train_rows)
    told = write_shared(memberships(rows, domains, chosen, weights, id_col, text_col, buckets), "memberships")
    wanted = {d: w for d, w in targets.items() if d in domains}
    fitted, lines = fit_rates(told, domains, wanted, budget, relative, most_rate=most_rate)
    if report is not None:
        report += lines
    rate = F.round("rate", 6)
    chance = F.pmod(F.xxhash64(ROW, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    named = F.map_from_arrays(F.array(*(F.lit(d) for d in domains)).cast("array<string>"), "_p")
    return fitted.select(
        *([ROW] if ROW in docs.columns else []),
        F.col("_id").alias(id_col),
        F.col("_tokens").alias("n_tokens"),
        named.alias("memberships"),
        rate.alias("rate"),
        (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).alias("copies"),
    )


def drawn(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that get a copy, once each and with all their columns. Rates are fitted to be at most 1, as one copy can carry out."""
    rows = with_row_key(docs, id_col)
    left = mix(rows, labels, targets, id_col, most_rate=1.0, **options).filter("copies = 0")
    return filter_by_keys(rows, left, ROW, keep=False).select(*docs.columns)


def quality_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from a table with quality and toxic flags: toxic, high or low."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(id_col, domain.alias("domain"))
