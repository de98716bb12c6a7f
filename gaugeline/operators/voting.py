"""From judge votes to one label per finding, and from labels to at most one match per ground-truth item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.joins import broadcast_if_small
from gaugeline.functions.numbers import ratio
from gaugeline.operators.metrics import CATEGORIES

NO_LEVEL = -(1 << 62)  # below every agreement count


def validate_vote_gt(votes: DataFrame, gt: DataFrame) -> DataFrame:
    """Votes that name an unknown ground-truth id turn into low-confidence FPs; a known id forces ``matched``."""
    known = (
        gt.filter(F.col("gt_id").isNotNull())
        .select("codebase_id", F.col("gt_id").alias("matched_gt_id"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    joined = votes.join(broadcast_if_small(known), ["codebase_id", "matched_gt_id"], "left")
    named = F.col("category").isNotNull() & F.col("matched_gt_id").isNotNull()
    unknown = named & F.col("_known").isNull()
    note = F.concat(F.lit('Invalid GT ID "'), F.col("matched_gt_id").cast("string"), F.lit('". '), F.col("reasoning"))
    return joined.select(
        *[c for c in votes.columns if c not in ("category", "matched_gt_id", "confidence", "reasoning")],
        F.when(unknown, "fp").when(named, "matched").otherwise(F.col("category")).alias("category"),
        F.when(~unknown, F.col("matched_gt_id")).alias("matched_gt_id"),
        F.when(unknown, "low").otherwise(F.col("confidence")).alias("confidence"),
        F.when(unknown, note).otherwise(F.col("reasoning")).alias("reasoning"),
    )


def vote_key():
    """``matched:<gt id>`` for matched votes, ``<category>:`` for the others."""
    gt_id = F.coalesce(F.col("matched_gt_id").cast("string"), F.lit("null"))
    return F.concat(F.col("category"), F.lit(":"), F.when(F.col("category") == "matched", gt_id).otherwise(F.lit("")))


def _tally(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Votes per finding and key with the earliest vote of each key; combined map-side before the shuffle."""
    cast = votes.filter(F.col("category").isNotNull()).withColumn("vote_key", vote_key())
    return cast.groupBy(*keys, "vote_key").agg(
        F.count("*").alias("n"),
        F.min("vote_no").alias("first_vote"),
        F.min_by(F.struct("category", "matched_gt_id", "reasoning"), F.col("vote_no")).alias("vote"),
    )


def majority_vote(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One label per finding from its votes (null category = failed vote).

    The most frequent key wins with at least two votes, ties go to the key seen first; a lone successful vote
    counts as it is; otherwise the finding is uncertain.
    """
    sizes = votes.groupBy(*keys).agg(F.count("*").alias("votes"), F.count("category").alias("cast_votes"))
    best = _tally(votes, keys).groupBy(*keys).agg(
        F.max_by(F.struct("n", "vote"), F.struct("n", -F.col("first_vote"))).alias("best")
    )
    joined = sizes.join(best, list(keys), "left")
    accepted = (F.col("cast_votes") == 1) | (F.col("best.n") >= 2)
    return joined.select(
        *keys,
        F.when(accepted, F.col("best.vote.category")).otherwise("uncertain").alias("category"),
        F.when(accepted, F.col("best.vote.matched_gt_id")).alias("matched_gt_id"),
        F.when(accepted, F.concat_ws("/", "best.n", "votes")).otherwise("no-majority").alias("agreement"),
        F.when(accepted, F.col("best.n")).otherwise(F.lit(0)).cast("long").alias("agreement_count"),
        F.when(accepted, F.col("best.vote.reasoning")).alias("reasoning"),
        "votes",
        "cast_votes",
    )


def no_majority_reason(votes: DataFrame, keys: Sequence[str], page: int = 1000) -> DataFrame:
    """Why a finding stays uncertain: its vote keys in order, the failed votes, and the best vote's reasoning.

    A text longer than ``page`` vote numbers continues on further rows (``page``), to be read in order.
    """
    labels = majority_vote(votes, keys).filter("category = 'uncertain' and agreement = 'no-majority'")
    undecided = labels.select(*keys, "votes", "cast_votes")
    cast = votes.filter(F.col("category").isNotNull()).join(undecided, list(keys), "left_semi")
    reasons = cast.groupBy(*keys).agg(
        F.coalesce(
            F.min_by("reasoning", F.when(F.col("category") == "novel", F.col("vote_no"))),
            F.min_by("reasoning", F.col("vote_no")),
        ).alias("best_reasoning"),
        F.min(F.floor(F.col("vote_no") / page)).alias("first_page"),
        F.max(F.floor(F.col("vote_no") / page)).alias("last_page"),
    )
    pages = (
        cast.select(*keys, F.floor(F.col("vote_no") / page).alias("page"), "vote_no", vote_key().alias("vote_key"))
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_list(F.struct("vote_no", "vote_key"))).alias("cast"))
        .select(*keys, "page", F.array_join(F.col("cast.vote_key"), ", ").alias("keys_text"))
    )
    failed = F.col("votes") - F.col("cast_votes")
    head = F.when(F.col("page") == F.col("first_page"), "No majority (").otherwise(", ")
    close = F.concat(
        F.when(failed > 0, F.concat(F.lit(", "), failed, F.lit(" failed"))).otherwise(F.lit("")),
        F.lit("). "),
        F.coalesce("best_reasoning", F.lit("")),
    )
    split_vote = (
        undecided.join(reasons, list(keys))
        .join(pages, list(keys))
        .select(
            *keys,
            "page",
            F.concat(head, "keys_text", F.when(F.col("page") == F.col("last_page"), close).otherwise(F.lit(""))).alias(
                "reasoning"
            ),
        )
    )
    all_failed = undecided.filter("cast_votes = 0").select(
        *keys,
        F.lit(0).cast("long").alias("page"),
        F.concat(F.lit("All "), "votes", F.lit(" vote(s) failed — cannot classify.")).alias("reasoning"),
    )
    return split_vote.unionByName(all_failed)


def dedup_gt_match(labels: DataFrame) -> DataFrame:
    """Keep one match per (run, ground-truth item): highest agreement, then the earliest; demote the others.

    Needs ``agreement_count``, ``agreement``, ``position`` (unique within a run, unlike a printed number) and
    ``reasoning``. A demoted row that led until a
    later finding beat it carries its agreement in the text. Leaders are found over the matches of one item in one run;
    labels that lie by run already are not moved, others are spread by run and item or, without a match, by position.
    """
    contested = (F.col("category") == "matched") & F.col("matched_gt_id").isNotNull()
    keyed = F.coalesce(contested, F.lit(False)) & F.col("run_id").isNotNull()
    level = F.coalesce(F.col("agreement_count").cast("long"), F.lit(NO_LEVEL))
    marked = labels.withColumns({"_keyed": keyed, "_level": level, "_alone": F.when(~keyed, F.col("position"))})
    matches = Window.partitionBy("run_id", "matched_gt_id", "_alone").orderBy(F.desc("_level"))
    place = F.when(F.col("_keyed"), F.col("position"))
    first = F.min(place).over(matches.rangeBetween(Window.currentRow, Window.currentRow))
    above = F.min(place).over(matches.rangeBetween(Window.unboundedPreceding, -1))
    led_until = F.when(F.col("_above").isNull(), "winner").when(F.col("position") < F.col("_above"), "led")
    joined = marked.withColumns({"_first": first, "_above": above}).withColumn(
        "_standing", F.when(F.col("_keyed") & (F.col("position") == F.col("_first")), led_until)
    )
    demoted = contested & (F.coalesce("_standing", F.lit("")) != "winner")
    led = F.when(F.col("_standing") == "led", F.concat(F.lit(" ("), "agreement", F.lit(")"))).otherwise(F.lit(""))
    note = F.concat(
        F.lit("Duplicate GT match for "), F.col("matched_gt_id").cast("string"), F.lit(" — demoted"), led, F.lit(". ")
    )
    kept = [c for c in labels.columns if c not in ("category", "matched_gt_id", "reasoning")]
    return joined.select(
        *kept,
        F.when(demoted, "uncertain").otherwise(F.col("category")).alias("category"),
        F.when(~demoted, F.col("matched_gt_id")).alias("matched_gt_id"),
        F.when(demoted, F.concat(note, F.coalesce("reasoning", F.lit("")))).otherwise(F.col("reasoning")).alias(
            "reasoning"
        ),
    )


def class_summary(labels: DataFrame) -> DataFrame:
    """Labels per category and in total for every run."""
    return labels.groupBy("run_id").agg(
        *[F.count_if(F.col("category") == name).alias(name) for name in CATEGORIES],
        F.count("*").alias("total"),
    )


def vote_stability(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of judged findings whose successful votes disagree."""
    kinds = _tally(votes, keys).groupBy(*keys).agg(F.count("*").alias("kinds"))
    return kinds.agg(
        F.count("*").alias("findings"), F.count_if(F.col("kinds") > 1).alias("unstable")
    ).withColumn("instability", ratio(F.col("unstable"), F.col("findings")))
