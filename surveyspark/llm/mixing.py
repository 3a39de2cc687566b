"""Mixing to target weights with soft membership. DataFrame functions only.

Classifier: the ``labels`` table names a domain for some documents (toxic, good or poor). A Bernoulli
naive Bayes model learns from at most about ``TRAIN_ROWS`` labelled documents, chosen by a hash of the
id: which words, and which marks of form (share of symbols, capitals, repeated words), a text has.
The at most ``TERMS`` terms that tell the domains apart best are kept, so the model is of bounded
size and is broadcast. Posteriors: per document the log-odds of its terms are summed by a map-side
aggregate, so one row per document is shuffled.

Rates: projected gradient descent on ``0.5 * |sum_i n_i p_i r_i - target|^2`` over document rates
``r_i >= 0`` from ``r = 1``. A step needs only a few numbers per domain, so a document's rate is a
fold over the list of moves so far and one pass aggregates a row of fixed size; after ``FOLD`` moves
the documents' state is written and the list starts anew. Steps go on until the targets are met or
the projected gradient vanishes (its mean over the tokens is at most ``GAP``), which only the best
reachable mixture has. The shares reached are logged, with a warning if they miss.

Nothing is grouped by source or domain alone, so no hot source meets in one task.

Defined results: null or empty text has no words and the posterior of its form; rows that repeat id
and text are counted together and get one row; conflicting labels of an id count as toxic before
poor before good; without any label or token all rates are 1 and posteriors equal; an empty table
gives an empty result.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import staged

DOMAINS = ("good", "poor", "toxic")
#: target share of all tokens
TARGETS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}
TRAIN_ROWS = 20_000
TERMS = 500
#: least chi-square of a term, and how many times its mean share some domain must have it
MIN_SPREAD, MIN_LIFT = 30.0, 3.0
MIN_DOCS = 5
SMOOTH = 0.5
TOLERANCE = 2e-3
GAP = 1e-6
FOLD = 30
#: beyond this many steps the search stops with a warning
STEPS = 5_000
log = logging.getLogger(__name__)
SEPARATORS = r"[\x00-/:-`{-\x7f]+"
ROW = "#row"


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): one domain per labelled document."""
    level = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    named = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.col("level") + 1)
    return (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(level).alias("level"))
            .filter(F.col("level").isNotNull()).select("doc_id", named.alias("domain")))


def _tenths(part: Column, whole: Column, name: str) -> Column:
    return F.concat(F.lit(name), F.floor(10 * part / F.greatest(F.lit(1), whole)).cast("string"))


def _share_of(pattern: str, name: str) -> Column:
    """In tenths, how many characters of the text match ``pattern``."""
    return _tenths(F.regexp_count("t", F.lit(pattern)), F.length("t"), name)


# explode_outer below: a plain explode infers a filter that would split every text twice
def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_tokens, terms): distinct words and marks of form of every whole text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("t"), F.split(F.lower(text), SEPARATORS).alias("w"))
    # a text that starts or ends with separators gives an empty word there
    edges = (F.element_at("w", 1) == "").cast("int") + ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    base = base.select("doc_id", "t", (F.size("w") - edges).alias("n"), F.array_distinct("w").alias("d"))
    marks = F.array(F.lit(ROW), _tenths(F.size("d"), F.col("n"), "#distinct"), _share_of(r"[!#$%&*@^~|<>{}]", "#symbols"),
                    _share_of("[A-Z]", "#capitals"), _share_of("[0-9]", "#digits"))
    return base.select("doc_id", F.xxhash64("t").alias("text_hash"), F.col("n").cast("long").alias("n_tokens"),
                       F.concat("d", marks).alias("terms"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, n_terms: int = TERMS) -> DataFrame:
    """(term, one weight per domain): at most ``n_terms`` log-odds and the row of log priors."""
    named = domains_of(labels)
    total = named.count()
    share = min(10**6, 10**6 * train_rows // max(1, total) + 1)
    sample = named.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10**6)) < share)
    seen = (featured(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"))
            .join(F.broadcast(sample), "doc_id"))
    counts = (seen.select("domain", F.explode_outer("terms").alias("term")).groupBy("term")
              .agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]))
    counts = staged(counts.filter(sum(F.col(d) for d in DOMAINS) >= MIN_DOCS), "mix-counts")
    rows = counts.filter(F.col("term") == ROW).first() or {d: 0 for d in DOMAINS}
    n = {d: rows[d] for d in DOMAINS}
    all_rows = sum(n.values())
    # smoothed share of each domain's documents that have the term
    p = {d: (F.col(d) + SMOOTH) / (n[d] + 2 * SMOOTH) for d in DOMAINS}
    mean = sum(F.col(d) for d in DOMAINS) / max(1, all_rows)
    spread = sum(max(1, n[d]) * (p[d] - mean) * (p[d] - mean) for d in DOMAINS) / (mean * (1 - mean) + 1e-6)
    chosen = staged(counts.filter(~F.col("term").isin("", ROW)).withColumn("spread", spread)
                    .filter((F.col("spread") >= MIN_SPREAD) & (F.greatest(*p.values()) >= MIN_LIFT * mean)).orderBy(F.col("spread").desc(), "term").limit(n_terms)
                    .select("term", *[F.log(p[d] / (1 - p[d])).alias(d) for d in DOMAINS],
                            *[F.log(1 - p[d]).alias(f"no_{d}") for d in DOMAINS]), "mix-terms")
    # what a text without any of the terms weighs
    none = chosen.agg(*[F.coalesce(F.sum(f"no_{d}"), F.lit(0.0)).alias(d) for d in DOMAINS])
    prior = none.select(F.lit(ROW).alias("term"), *[
        (F.col(d) + math.log((n[d] + 1) / (all_rows + len(DOMAINS)))).alias(d) for d in DOMAINS])
    return staged(chosen.select("term", *DOMAINS).unionByName(prior), "mix-model")


def posteriors(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, text_hash, copies, n_tokens, one posterior per domain); ``n_tokens`` is per copy."""
    # the model has at most TERMS + 1 rows
    hits = (featured(docs).select("doc_id", "text_hash", "n_tokens", F.explode_outer("terms").alias("term"))
            .join(F.broadcast(model), "term"))
    word = F.col("term") != ROW
    sums = hits.groupBy("doc_id", "text_hash", "n_tokens").agg(
        F.count_if(~word).alias("copies"),
        *[F.sum(F.when(word, F.col(d)).otherwise(0.0)).alias(f"s_{d}") for d in DOMAINS],
        *[F.max(F.when(~word, F.col(d))).alias(f"p_{d}") for d in DOMAINS])
    logits = {d: F.col(f"p_{d}") + F.col(f"s_{d}") / F.col("copies") for d in DOMAINS}
    top = F.greatest(*logits.values())
    parts = {d: F.exp(v - top) for d, v in logits.items()}
    return sums.select("doc_id", "text_hash", "copies", "n_tokens",
                       *[(parts[d] / sum(parts.values())).alias(d) for d in DOMAINS])


def _rate(moves: list[tuple[np.ndarray, float]]) -> Column:
    """struct<r, y, g> of a document after the steps so far: its rate, the point ahead of it and the last projected step.

    A fold over the steps, each a move per domain and the momentum that follows it.
    """
    start = F.struct(F.col("r0").alias("r"), F.col("y0").alias("y"), F.lit(1.0).alias("g"))
    if not moves:
        return start
    steps = F.array(*[F.struct(*[F.lit(float(x)).alias(d) for d, x in zip(DOMAINS, m)], F.lit(float(b)).alias("b")) for m, b in moves])

    def step(at, m):
        r = F.greatest(F.lit(0.0), at["y"] - sum(F.col(d) * m[d] for d in DOMAINS))
        return F.struct(r.alias("r"), (r + m["b"] * (r - at["r"])).alias("y"), F.abs(r - at["y"]).alias("g"))

    return F.aggregate(steps, start, step)


def rates(found: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``found`` with ``rate``; expected tokens per domain meet ``targets`` (shares of all tokens).

    Errors are measured against each domain's natural mass. In that metric the gradient of a rate is
    ``p . (error / mass)`` and its Lipschitz constant is at most 1, since posteriors sum to 1; so
    projected steps of length 1 converge, here with Nesterov's momentum, restarted when the
    objective grows.
    """
    weight = F.col("n_tokens") * F.col("copies")
    first = found.agg(F.sum(weight).alias("n"), *[F.sum(weight * F.col(d)).alias(d) for d in DOMAINS]).first()
    total = first["n"] or 0
    if not total:
        return found.withColumn("rate", F.lit(1.0))
    wanted = np.array([targets[d] for d in DOMAINS])
    mass = np.maximum(np.array([first[d] / total for d in DOMAINS]), 1e-9)
    moves: list[tuple[np.ndarray, float]] = []
    least, run = np.inf, 0
    state = found.withColumn("r0", F.lit(1.0)).withColumn("y0", F.lit(1.0))
    for taken in range(STEPS + 1):
        if len(moves) == FOLD:
            state = staged(state.withColumn("at", _rate(moves)).withColumn("r0", F.col("at.r")).withColumn("y0", F.col("at.y")).drop("at"), "mix-state")
            moves = []
        got = (state.select((weight / total).alias("w"), _rate(moves).alias("at"), *DOMAINS)
               .agg(F.sum(F.col("w") * F.col("at.g")).alias("gap"),
                    *[F.sum(F.col("w") * F.col(f"at.{x}") * F.col(d)).alias(f"{x}_{d}") for x in "ry" for d in DOMAINS]).first())
        error, ahead = (np.array([got[f"{x}_{d}"] for d in DOMAINS]) - wanted for x in "ry")
        size = float(np.abs(error / wanted).max())
        # without moves the gap is not known yet
        if size <= TOLERANCE or (moves and got["gap"] <= GAP) or taken == STEPS:
            break
        missed = float((error * error / mass).sum())
        run = 0 if missed > least else run + 1
        least = missed
        moves.append((ahead / mass, run / (run + 3)))
    log.log(logging.INFO if size <= TOLERANCE else logging.WARNING, "mixing: %s shares %s of %s after %d steps, projected step %.1e",
            "met" if size <= TOLERANCE else "best reachable" if got["gap"] <= GAP else "NOT CONVERGED",
            {d: round(got[f"r_{d}"], 5) for d in DOMAINS}, targets, taken, got["gap"])
    return state.withColumn("rate", _rate(moves)["r"]).drop("r0", "y0")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, text_hash, copies, n_tokens, posteriors, rate) of every document."""
    model = fit(docs, labels)
    found = staged(posteriors(docs.select("doc_id", "text"), model), "mix-posteriors")
    return rates(found, targets)


def resample_stage(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Pipeline stage: each document ``floor(rate)`` times, once more if a hash falls below the rest.

    The hash is of id and text, so a rerun takes the same documents; a rate over 1 repeats a row.
    """
    columns = docs.columns
    found = mix(docs, labels, targets).select(
        F.col("doc_id").alias("llm_id"), F.col("text_hash").alias("llm_text_hash"), F.col("rate").alias("llm_rate"))
    joined = docs.withColumn("llm_hash", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        found, F.col("doc_id").eqNullSafe(F.col("llm_id")) & (F.col("llm_hash") == F.col("llm_text_hash")))
    draw = F.pmod(F.xxhash64("doc_id", "llm_hash", F.lit(7)), F.lit(10**6)) / 10**6
    times = F.floor("llm_rate") + F.when(draw < F.col("llm_rate") - F.floor("llm_rate"), 1).otherwise(0)
    return (joined.withColumn("llm_n", times.cast("int")).filter(F.col("llm_n") > 0)
            .withColumn("llm_i", F.explode(F.sequence(F.lit(1), F.col("llm_n")))).select(*columns))
