"""Soft-membership mixing, in DataFrame functions only.

A naive Bayes classifier over hashed words, learned from a labelled table, gives every document a posterior for each
domain. A document of n tokens then counts n * posterior tokens towards each domain, and projected gradient descent
finds nonnegative document rates whose expected domain totals match the targets in least squares. A step needs the
domains' totals alone, so each is one aggregate over the documents; the driver holds numbers for each domain only.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisloom.llm.common import saved, smallest, text_docs


def row_key() -> list[Column]:
    """Rows alike in id and text are alike in all that follows."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def hashed_words(rows: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """One row for each word, with its bucket; a text without words has one row, of bucket -1."""
    word = F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")
    return rows.select(*keep, word).select(*keep, F.when(F.col("word") == "", F.lit(-1)).otherwise(F.pmod(F.xxhash64("word"), F.lit(buckets))).cast("int").alias("bucket"))


def classifier(docs: DataFrame, labelled: DataFrame, buckets: int = 4096, max_rows: int = 20_000, max_domains: int = 64) -> tuple[list[str], DataFrame, np.ndarray]:
    """(domains, weights, log priors): weights has a row for each bucket, w0, w1, ... its log probabilities by domain.

    labelled: (doc_id, domain). At most max_rows of its rows are learned from, those whose ids have the smallest hashes.
    Null ids and domains are left out. More than max_domains domains are an error. With no labelled row there is one
    domain, "all".
    """
    sample = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna().distinct()
    sample = saved(smallest(sample, max_rows, "doc_id"))
    counted = hashed_words(text_docs(docs).join(F.broadcast(sample), "doc_id"), buckets, "doc_id", "domain")
    found = counted.groupBy("domain", "bucket").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).collect()
    domains = sorted({r["domain"] for r in found}) or ["all"]
    if len(domains) > max_domains:
        raise ValueError(f"{len(domains)} domains; at most {max_domains} are allowed")
    n, prior = np.zeros((len(domains), buckets)), np.ones(len(domains))
    for r in found:
        if r["bucket"] >= 0:
            n[domains.index(r["domain"]), r["bucket"]] = r["n"]
    share = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior += [share.get(d, 0) for d in domains]
    logs = np.log(n + 1) - np.log((n + 1).sum(axis=1, keepdims=True))
    logs -= logs.mean(axis=0)
    names = [f"w{i}" for i in range(len(domains))]
    weights = docs.sparkSession.createDataFrame([(i, *map(float, logs[:, i])) for i in range(buckets)], "bucket int, " + ", ".join(f"{x} double" for x in names))
    return domains, weights, np.log(prior / prior.sum())


def posteriors(docs: DataFrame, domains: list[str], weights: DataFrame, priors: np.ndarray, buckets: int = 4096) -> DataFrame:
    """(doc_id, text_hash, tokens, p0, p1, ...) for every row. A text without words has the priors.

    The words' evidence is summed and divided by the root of their number, as neighbouring words are no independent
    evidence. weights has `buckets` rows, so its broadcast is bounded.
    """
    k = range(len(domains))
    rows = text_docs(docs).select(F.monotonically_increasing_id().alias("row"), *row_key(), "text")
    met = hashed_words(rows, buckets, "row", "doc_id", "text_hash").join(F.broadcast(weights), "bucket", "left")
    sums = met.groupBy("row", "doc_id", "text_hash").agg(F.count(F.when(F.col("bucket") >= 0, 1)).alias("tokens"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in k))
    logit = [F.col(f"s{i}") / F.sqrt(F.greatest("tokens", F.lit(1))) + float(priors[i]) for i in k]
    top = F.greatest(*logit) if len(logit) > 1 else logit[0]
    powers = sums.select("doc_id", "text_hash", "tokens", *(F.exp(x - top).alias(f"e{i}") for i, x in enumerate(logit)))
    whole = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return powers.select("doc_id", "text_hash", "tokens", *((F.col(f"e{i}") / whole).alias(f"p{i}") for i in k))


def rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, least: float = 0.0, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """members with a rate: r >= least that minimises the whitened squares of (expected domain tokens - targets).

    members: (tokens, p0, p1, ...), stored. targets: shares by domain, scaled to sum to 1; a domain left out has share 0.
    total: the tokens to end up with; by default as many as there are, and with least > 0 the fewest with which no
    domain has to shrink. Whitening by the Gram matrix of the memberships makes the step length 1 right for any data.
    It ends where the totals meet the targets or move no more, both within tolerance of the total; then bounds on the rates
    hold what is left, and a warning tells how much that is. A warning also tells of an end by `rounds`, and of a target
    for a domain that is none of `domains`: its share goes to the others.
    """
    absent = sorted(d for d, x in targets.items() if x > 0 and d not in domains)
    if absent:
        warnings.warn(f"no labelled document is of {', '.join(absent)}: the other domains share what was meant for these", stacklevel=2)
    k = range(len(domains))
    a = [F.col("tokens") * F.col(f"p{i}") for i in k]
    sums = members.agg(*(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(a)), *(F.coalesce(F.sum(a[i] * a[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in k for j in k if i <= j)).first()
    now = np.array([sums[f"s{i}"] for i in k])
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in k] for i in k])
    share = np.array([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    share = share / share.sum() if share.sum() > 0 else now / max(now.sum(), 1.0)
    if total is None:
        total = float(now.sum()) if least <= 0 else least * float(max([n / s for n, s in zip(now, share, strict=True) if s > 0], default=now.sum()))
    want = share * total
    inverse = np.linalg.pinv(gram) if gram.any() else gram
    start = max(1.0, least)
    held, rate, sums_now, pending = members.withColumn("rate", F.lit(start)), F.col("rate"), now * start, 0
    moved, close = np.inf, tolerance * max(total, 1.0)
    for _ in range(rounds):
        off = sums_now - want
        if np.abs(off).max(initial=0) <= close or moved <= 0.01 * close:
            break
        back = inverse @ off
        rate = F.greatest(F.lit(float(least)), rate - sum((a[i] * float(back[i]) for i in k), F.lit(0.0)))
        pending += 1
        if pending == 6:
            held, rate, pending = saved(held.withColumn("rate", rate)), F.col("rate"), 0
        r = held.agg(*(F.sum(a[i] * rate).alias(f"s{i}") for i in k)).first()
        after = np.array([r[f"s{i}"] for i in k])
        moved, sums_now = float(np.abs(after - sums_now).max(initial=0)), after
    if (left := float(np.abs(sums_now - want).max(initial=0))) > close:
        warnings.warn(f"domain totals are {left:.6g} tokens from their targets at most, of {total:.6g}" + ("" if moved <= 0.01 * close else f", after {rounds} rounds"), stacklevel=2)
    return held.withColumn("rate", rate)


def copies(seed: int = 11) -> Column:
    """A rate as a whole number of copies: its floor, and one more with the fraction's chance, drawn from the row's key."""
    draw = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")


def soft_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, least: float = 0.0) -> tuple[list[str], DataFrame]:
    """(domains, rows): (doc_id, text_hash, tokens, p0, p1, ..., rate, copies) for every row of docs.

    Null texts count as empty: no tokens, the prior as posterior, and a rate of 1 (or least), which changes no total.
    Repeated rows have equal rates; a null doc_id stays null; an empty table gives no rows; columns of docs other than
    doc_id and text are ignored.
    """
    domains, weights, priors = classifier(docs, labelled)
    members = saved(posteriors(docs, domains, weights, priors))
    return domains, rates(members, domains, targets, total, least).withColumn("copies", copies())


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, least: float = 0.0) -> DataFrame:
    """docs with each row as many times as its copies say; with least >= 1 every row stays at least once.

    All columns of docs are kept, also ones that are named as the operator's own; null texts count as empty and stay null,
    as do null ids; rows alike in id and text have equal copies; an empty table gives none. Warnings as in `rates`.
    """
    _, rows = soft_mix(docs, labelled, targets, total, least)
    times = rows.select("doc_id", "text_hash", "copies").dropDuplicates(["doc_id", "text_hash"])
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    met = whole.join(times, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    return met.select("d", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("d.*")
