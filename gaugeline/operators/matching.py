"""Token similarity between findings and small reference lists, and the rule-based judge built on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage


HOT = 4096  # sets that ask for a token; for each so many they go to one more place


def title_words(title: Column) -> Column:
    """Sorted distinct lower-case words of a title."""
    plain = F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " "), lambda word: word != "")))


def prefix_length(size: Column, theta: float) -> Column:
    """How many of its rarest tokens a set of that size keeps: two sets with Jaccard >= theta share at least one of them."""
    return size - F.ceil(size * F.lit(theta) - F.lit(1e-9)).cast("int") + 1


def rarest(sets: DataFrame, frequencies: DataFrame, theta: float) -> DataFrame:
    """Each set with its prefix for ``theta`` as ``rare``: its first tokens (n, token) in the order of rising frequency, which
    is n here. The prefix for a larger share is the start of it."""
    tokens = sets.select("scope", "words", F.explode("words").alias("token")).join(
        frequencies, ["scope", "token"], "left"
    )
    return (
        tokens.groupBy("scope", "words")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("t"))
        .select("scope", "words", F.slice("t", F.lit(1), prefix_length(F.size("t"), theta)).alias("rare"))
    )


def prefixes(sets: DataFrame, frequencies: DataFrame, theta: float) -> DataFrame:
    """The rarest tokens of each set, a row for each: two sets with Jaccard >= theta share at least one of them."""
    return (
        rarest(sets, frequencies, theta)
        .select("scope", "words", F.explode("rare").alias("f"))
        .select("scope", "words", F.col("f.token").alias("token"), F.col("f.n").alias("n"))
    )


def best_similar(left: DataFrame, right: DataFrame, theta: float) -> DataFrame:
    """The most similar right entry for every distinct left word set, where the Jaccard reaches ``theta``.

    ``left`` holds scope and words, ``right`` scope, words, target and position (ties go to the smallest). Equal word
    sets are folded first, and only sets that share a rare token meet (prefix filter), which loses no pair. The sets that
    ask for a hot token are spread over salts, the entries under it are repeated for each.
    """
    if not 0 < theta <= 1 or math.isnan(theta):
        raise ValueError("theta must be in (0, 1]")
    wanted = left.select("scope", "words").filter(F.size("words") > 0).distinct()
    offered = (
        right.filter(F.size("words") > 0)
        .groupBy("scope", "words")
        .agg(F.min(F.struct("position", "target")).alias("best"))
    )
    frequencies = (
        offered.select("scope", F.explode("words").alias("token")).groupBy("scope", "token").agg(F.count("*").alias("n"))
    )
    asked = cut_lineage(prefixes(wanted, frequencies, theta).drop("n"))
    demand = asked.groupBy("scope", "token").agg(F.ceil(F.count("*") / HOT).alias("salts"))
    asked = asked.join(demand, ["scope", "token"]).withColumn("salt", F.pmod(F.xxhash64("words"), F.col("salts")))
    filed = prefixes(offered.select("scope", "words"), frequencies, theta).drop("n").withColumnRenamed("words", "other")
    filed = filed.join(demand, ["scope", "token"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    near = asked.drop("salts").join(filed.drop("salts"), ["scope", "token", "salt"])
    shared = F.size(F.array_intersect("words", "other"))
    score = shared / (F.size("words") + F.size("other") - shared)
    scored = near.select("scope", "words", "other").distinct().withColumn("score", score).filter(
        F.col("score") >= theta - 1e-9
    )
    named = scored.join(offered.withColumnRenamed("words", "other"), ["scope", "other"])
    return (
        named.groupBy("scope", "words")
        .agg(F.min_by(F.struct("best", "score"), F.struct(-F.col("score"), F.col("best"))).alias("m"))
        .select("scope", "words", F.col("m.best.target").alias("target"), F.col("m.score").alias("score"))
    )


def rule_matcher(findings: DataFrame, gt: DataFrame, theta: float = 0.5) -> DataFrame:
    """A deterministic voter: one vote per finding.

    ``findings`` holds run_id, position, finding_index, codebase_id, title, root_cause, vuln_type; ``gt`` codebase_id, gt_id,
    gt_pos, title, contract, vuln_type. A finding matches the first item with its contract and keyword class, else the
    item with the most similar title from ``theta`` on. Unmatched findings without a known contract are too vague
    (fp), the others are novel.
    """
    contract = F.substring_index("root_cause", "::", 1)
    keyed = findings.withColumns({"contract": contract, "words": title_words(F.col("title"))})
    same_cause = (
        gt.filter("contract is not null and vuln_type <> 'other'")
        .groupBy("codebase_id", F.lower("contract").alias("contract"), "vuln_type")
        .agg(F.min_by("gt_id", "gt_pos").alias("cause_id"))
    )
    titles = gt.filter(F.col("gt_id").isNotNull()).select(
        F.col("codebase_id").alias("scope"), title_words(F.col("title")).alias("words"),
        F.col("gt_id").alias("target"), F.col("gt_pos").alias("position"),
    )
    by_cause = cut_lineage(
        keyed.join(same_cause, ["codebase_id", "contract", "vuln_type"], "left").select(
            "run_id", "position", "finding_index", "codebase_id", "contract", "words", "cause_id"
        )
    )
    undecided = by_cause.filter("cause_id is null").select(F.col("codebase_id").alias("scope"), "words")
    similar = best_similar(undecided, titles, theta).select(
        F.col("scope").alias("codebase_id"), "words", F.col("target").alias("title_id"), "score"
    )
    judged = by_cause.join(similar, ["codebase_id", "words"], "left")
    gt_id = F.coalesce("cause_id", "title_id")
    return judged.select(
        "run_id",
        "position",
        "finding_index",
        "codebase_id",
        F.when(gt_id.isNotNull(), "matched").when(F.col("contract") == "unknown", "fp").otherwise("novel").alias("category"),
        gt_id.alias("matched_gt_id"),
        F.when(F.col("cause_id").isNotNull(), "high").when(F.col("title_id").isNotNull(), "medium").otherwise("low").alias(
            "confidence"
        ),
        F.when(F.col("cause_id").isNotNull(), "same contract and keyword class")
        .when(F.col("title_id").isNotNull(), "similar title")
        .otherwise("no ground-truth item is close")
        .alias("reasoning"),
    )
