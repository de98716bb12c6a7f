"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree domain > language > source. At each node the children share their parent's budget in
proportion to their weights; what a child cannot use (its supply is too small) goes to its siblings first, and only what
all of them cannot use stays with the siblings of the parent, because no node is ever asked for more than its subtree
holds. A leaf that gets more than one epoch of its tokens repeats; the last, partial epoch is the token prefix of the
leaf's documents in an order seeded by (seed, epoch). All amounts are whole tokens, shares are rounded down.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import SPACES, with_small, written

LEVELS = ["domain", "lang", "source"]
BUCKET = 3  # hexadecimal digits of the seeded order that name the finest bucket
UNKNOWN = "(none)"
ONE_TASK_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Integer weights by level (1 if not named), the share of all tokens to take, and the epochs a leaf may give."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    budget_percent: int = 50
    max_epochs: int = 2
    seed: int = 17


PRODUCTION = Mix(
    weights={
        "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
        "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
        "source": {"src0": 2},
    }
)


def domain_of(source: Column) -> Column:
    """The stand-in domain of a source: its number modulo four; sources without a number are in domain0."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.coalesce(number.try_cast("long"), F.lit(0)) % 4)


def word_count(text: Column) -> Column:
    """The number of words, as the token measure of a text; 0 for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def keyed(documents: DataFrame, tokens: Column | None = None) -> DataFrame:
    """The original row as ``row`` (so its columns cannot clash), with doc_id, the leaf and the tokens beside it."""
    packed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"))
    return packed.select(
        "row",
        F.col("row.doc_id").cast("long").alias("doc_id"),
        domain_of(F.col("row.source")).alias("domain"),
        F.coalesce("row.lang", F.lit(UNKNOWN)).alias("lang"),
        F.coalesce("row.source", F.lit(UNKNOWN)).alias("source"),
        (word_count(F.col("row.text")) if tokens is None else tokens).alias("n_tokens"),
    )


def weight_of(level: str, mix: Mix) -> Column:
    out = F.lit(1)
    for name, weight in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def poured(nodes: DataFrame, parent: list[str], level: str, mix: Mix) -> DataFrame:
    """Give every node its part of ``budget`` (the parent's amount): min(supply, weight x level), exactly.

    Siblings in ascending order of supply per weight: a node is full if its supply fits into its share of what the
    earlier, full nodes leave; the first node that is not full fixes the share of itself and of all after it.
    """
    big = lambda c: c.cast("decimal(19,0)")
    order = [(F.col("supply").cast("double") / F.col("weight")).asc(), F.col(level).asc()]
    siblings = Window.partitionBy(*parent)
    before = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    weighted = nodes.withColumn("weight", weight_of(level, mix))
    shared = weighted.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
        F.row_number().over(siblings.orderBy(*order)).alias("place"),
    )
    open_place = F.when(
        big(F.col("supply")) * big(F.col("weights")) > big(F.col("left")) * big(F.col("weight")), F.col("place")
    )
    first = shared.withColumn("first_open", F.min(open_place).over(siblings))
    at_first = lambda c: F.max(F.when(F.col("place") == F.col("first_open"), F.col(c))).over(siblings)
    settled = first.select("*", at_first("left").alias("open_left"), at_first("weights").alias("open_weights"))
    amount = F.when(
        F.col("first_open").isNull() | (F.col("place") < F.col("first_open")), F.col("supply")
    ).otherwise(F.expr("cast(open_left as decimal(19,0)) * cast(weight as decimal(19,0)) div open_weights"))
    return settled.withColumn("amount", amount).drop(
        "weight", "left", "weights", "place", "first_open", "open_left", "open_weights"
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, amount): the tokens that every leaf has to give."""
    supplied = leaves.withColumn("supply", F.col("tokens") * mix.max_epochs)
    budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * mix.budget_percent // 100
    level = supplied.groupBy("domain").agg(F.sum("supply").alias("supply")).withColumn("budget", F.lit(budget).cast("long"))
    poured_level = poured(level, [], "domain", mix)
    for depth in (2, 3):
        path = LEVELS[:depth]
        given = poured_level.select(*LEVELS[: depth - 1], F.col("amount").alias("budget"))
        level = supplied.groupBy(*path).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        poured_level = poured(level.join(given, LEVELS[: depth - 1]), LEVELS[: depth - 1], path[-1], mix)
    return poured_level.select(*LEVELS, "tokens", "amount")


def order_key(mix: Mix) -> Column:
    """The place of a document in the seeded order of its leaf's partial epoch."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), "full_epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def mixing_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf: full_epochs, and the last order key that the partial epoch takes (``cut``).

    Tokens are first added up per bucket of the order, named by its first hexadecimal digits: one digit more at a time, and
    only inside the bucket in which the rest of the budget ends, so a leaf is 16 rows at each step. The last such bucket is
    looked at row by row; no task sorts a whole leaf.
    """
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    if leaves.count() <= ONE_TASK_LEAVES:  # the tree is then poured without a shuffle
        leaves = leaves.coalesce(1)
    plan = written(
        budgets(leaves, mix).select(
            *LEVELS,
            "tokens",
            "amount",
            F.when(F.col("tokens") > 0, F.expr("amount div tokens")).otherwise(0).alias("full_epochs"),
            F.when(F.col("tokens") > 0, F.col("amount") % F.col("tokens")).otherwise(0).alias("rest"),
        )
    )
    ordered = with_small(rows, plan.select(*LEVELS, "full_epochs", "rest"), LEVELS, "doc_id").withColumn("key", order_key(mix))
    so_far = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = ordered.withColumn("before", F.lit(0).cast("long"))
    for digits in range(1, BUCKET + 1):
        within = left.withColumn("bucket", F.substring("key", 1, digits))
        sums = within.groupBy(*LEVELS, "rest", "before", "bucket").agg(F.sum("n_tokens").alias("here"))
        crossing = written(
            sums.withColumn("upto", F.col("before") + F.sum("here").over(so_far))
            .filter("upto > rest")
            .groupBy(*LEVELS)
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("here")).alias("before"))).alias("c"))
            .select(*LEVELS, "c.bucket", "c.before")
        )
        left = with_small(within.drop("before"), crossing, [*LEVELS, "bucket"], "doc_id").drop("bucket")
    inside = (
        left
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key")))
        .filter("upto <= rest")
        .groupBy(*LEVELS)
        .agg(F.max("key").alias("last"))
    )
    return written(
        plan.join(crossing.select(*LEVELS, "bucket"), LEVELS, "left")
        .join(inside, LEVELS, "left")
        # keys below the crossing bucket sort before its name, keys inside it after
        .select(
            *LEVELS, "tokens", "amount", "full_epochs",
            F.when(F.col("rest") > 0, F.coalesce("last", "bucket")).otherwise("").alias("cut"),
        )
    )


def mixed(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """The rows that the plan takes, with ``copies``: the epochs in which the document occurs."""
    placed = with_small(rows, plan.select(*LEVELS, "full_epochs", "cut"), LEVELS, "doc_id").withColumn("key", order_key(mix))
    taken = (F.col("key") <= F.col("cut")).cast("long")
    return placed.withColumn("copies", F.col("full_epochs") + taken).filter("copies > 0").drop("full_epochs", "cut", "key")


def mix_sources(documents: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """One row per selected document: doc_id, domain, lang, source, n_tokens, copies.

    A null source or language is a leaf of its own; a null text has no tokens. Leaves without tokens get nothing. A
    document belongs to a prefix if all of it fits; rows that repeat an id have one place in the order and are taken or
    left together. An empty table gives an empty result.
    """
    rows = written(keyed(documents).drop("row"))
    return mixed(rows, mixing_plan(rows, mix), mix).select("doc_id", *LEVELS, "n_tokens", "copies")


def selected_rows(documents: DataFrame, mix: Mix) -> DataFrame:
    """The original rows of the mix, each as often as it occurs."""
    rows = keyed(documents)
    plan = mixing_plan(written(rows.drop("row")), mix)
    repeated = mixed(rows, plan, mix).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")


def oracle(mix: Mix = PRODUCTION, source: str = "documents") -> str:
    """The same selection in DuckDB; ``source`` names the relation with the documents."""

    def weight(level: str) -> str:
        cases = " ".join(f"when '{n}' then {w}" for n, w in mix.weights.get(level, {}).items())
        return f"case {level} {cases} else 1 end" if cases else "1"

    def pour(depth: int) -> str:
        level, parent = LEVELS[depth - 1], ", ".join(LEVELS[: depth - 1])
        path, name = ", ".join(LEVELS[:depth]), f"pour{depth}"
        by = f"partition by {parent} " if parent else ""
        budget = (
            f"(select cast(floor(sum(tokens) * {mix.budget_percent} / 100) as hugeint) from leaves)"
            if depth == 1
            else "any_value(p.amount)"
        )
        join = "" if depth == 1 else f" join pour{depth - 1} p using ({parent})"
        return f"""
{name}a as (
  select {path}, sum(l.tokens) * {mix.max_epochs} as supply, cast({weight(level)} as hugeint) as weight, {budget} as budget
  from leaves l{join} group by {path}
),
{name}b as (
  select *, budget - coalesce(sum(supply) over (w rows between unbounded preceding and 1 preceding), 0) as rem,
         sum(weight) over ({by.strip()}) - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as weights,
         row_number() over w as place
  from {name}a window w as ({by}order by cast(supply as double) / cast(weight as double), {level})
),
{name}c as (
  select *, min(case when supply * weights > rem * weight then place end) over ({by.strip()}) as first_open from {name}b
),
{name}d as (
  select *, max(case when place = first_open then rem end) over ({by.strip()}) as open_left,
         max(case when place = first_open then weights end) over ({by.strip()}) as open_weights from {name}c
),
{name} as (
  select {path}, supply, case when first_open is null or place < first_open then supply
                      else (open_left * weight) // open_weights end as amount
  from {name}d
)"""

    path = ", ".join(LEVELS)
    words = r"len([w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''])"
    return f"""
with slim as (
  select doc_id, 'domain' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as bigint), 0) % 4) as domain,
         coalesce(lang, '{UNKNOWN}') as lang, coalesce(source, '{UNKNOWN}') as source, {words} as n_tokens
  from {source}
),
leaves as (select {path}, cast(sum(n_tokens) as hugeint) as tokens from slim group by {path}),
{pour(1)},{pour(2)},{pour(3)},
plan as (
  select {path}, case when tokens > 0 then amount // tokens else 0 end as full_epochs,
         case when tokens > 0 then amount % tokens else 0 end as rest
  from pour3 join leaves using ({path})
),
ordered as (
  select s.*, full_epochs, rest,
         md5('{mix.seed}:' || full_epochs || ':' || coalesce(cast(doc_id as varchar), 'null')) as k
  from slim s join plan using ({path})
),
summed as (select *, sum(n_tokens) over (partition by {path} order by k) as upto from ordered),
chosen as (
  select doc_id, {path}, n_tokens, cast(full_epochs + (rest > 0 and upto <= rest)::int as bigint) as copies from summed
)
select doc_id, {path}, n_tokens, copies from chosen where copies > 0
"""
