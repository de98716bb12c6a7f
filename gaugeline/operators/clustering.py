"""Grouping findings by root cause: from scratch, incrementally, or from a judge's assignments.

Cluster inputs hold codebase_id, run_id, condition_id, finding_index, title, reasoning. Clusters and their members are
two tables; a finding is identified by (run_id, finding_index).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.joins import broadcast_if_small
from gaugeline.operators.matching import best_similar, prefix_length, rarest, title_words
from gaugeline.operators.refresh import USABLE_EXIT_CODES
from gaugeline.session import cut_lineage, materialised

FINDING = ["run_id", "finding_index"]
INPUT = ["codebase_id", "run_id", "condition_id", "finding_index", "title", "reasoning"]
CLUSTER = ["codebase_id", "cluster_id", "title", "reasoning", "severity"]
MEMBER = ["codebase_id", "cluster_id", "run_id", "condition_id", "finding_index", "title"]


def collect_novel(labels: DataFrame) -> DataFrame:
    """Novel and uncertain labels, the inputs of codebases with ground truth."""
    return labels.filter(F.col("category").isin("novel", "uncertain")).select(*INPUT)


def collect_all(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """All parsed findings of usable runs, the inputs of codebases without ground truth."""
    usable = runs.filter(F.col("exit_code").isin(USABLE_EXIT_CODES)).select("run_id", "codebase_id", "condition_id")
    about = F.concat(
        F.lit("Location: "), F.coalesce("location", F.lit("unknown")), F.lit(". Type: "), "vuln_type", F.lit(".")
    )
    text = F.when(F.coalesce("description", F.lit("")) != "", F.concat("description", F.lit(" "), about)).otherwise(about)
    return findings.drop("codebase_id", "condition_id").join(usable, "run_id").select(
        "codebase_id", "run_id", "condition_id", F.col("index").alias("finding_index"), "title", text.alias("reasoning")
    )


def cluster_inputs(labels: DataFrame, findings: DataFrame, runs: DataFrame, gt: DataFrame) -> DataFrame:
    """Novel labels where there is ground truth, all findings elsewhere."""
    with_gt = broadcast_if_small(gt.select("codebase_id").distinct())
    novel = collect_novel(labels).join(with_gt, "codebase_id", "left_semi")
    everything = collect_all(findings, runs.join(with_gt, "codebase_id", "left_anti"))
    return novel.unionByName(everything)


def new_findings(inputs: DataFrame, members: DataFrame) -> DataFrame:
    """Inputs that are in no cluster yet."""
    return inputs.join(members.select(*FINDING), FINDING, "left_anti")


def prune_members(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """Members that are still inputs; findings may have been relabelled or their run deleted."""
    return members.join(inputs.select(*FINDING), FINDING, "left_semi")


def prune_clusters(clusters: DataFrame, live_members: DataFrame) -> DataFrame:
    """Clusters that still have members."""
    return clusters.join(live_members.select("codebase_id", "cluster_id"), ["codebase_id", "cluster_id"], "left_semi")


def caught_conditions(members: DataFrame) -> DataFrame:
    """The conditions that caught each cluster."""
    return members.select("codebase_id", "cluster_id", "condition_id").distinct()


def prune_summary(members: DataFrame, live_members: DataFrame) -> DataFrame:
    """Findings pruned and clusters dropped per codebase."""

    def sizes(frame: DataFrame, name: str) -> DataFrame:
        per_cluster = frame.groupBy("codebase_id", "cluster_id").agg(F.count("*").alias("n"))
        return per_cluster.groupBy("codebase_id").agg(
            F.sum("n").alias(f"{name}_members"), F.count("*").alias(f"{name}_clusters")
        )

    both = sizes(members, "old").join(sizes(live_members, "live"), "codebase_id", "left").na.fill(0)
    return both.select(
        "codebase_id",
        (F.col("old_members") - F.col("live_members")).alias("pruned_findings"),
        (F.col("old_clusters") - F.col("live_clusters")).alias("dropped_clusters"),
    )


def cluster_id(title: Column, reasoning: Column) -> Column:
    """Content-based id of a new cluster."""
    return F.concat(F.lit("novel-"), F.substring(F.sha2(F.concat(title, reasoning), 256), 1, 8))


def orphan_id(finding_index: Column) -> Column:
    """Id of a cluster made for a finding nobody assigned; it may repeat over runs."""
    return F.concat(F.lit("novel-orphan-"), finding_index.cast("string"))


def place_assignments(assignments: DataFrame, chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each assigned finding with the cluster it goes to, and the text of that cluster where it is new.

    ``assignments`` holds codebase_id, chunk_no, position, member_index, assign_to, new_title, new_reasoning and
    new_severity. 'new' opens a cluster with the judge's texts (the finding's by default); an id that no earlier
    cluster has opens one for the finding. Indices outside the chunk are ignored.
    """
    place = ["codebase_id", "chunk_no", "member_index"]
    asked = assignments.join(chunks, place)
    opens = F.col("assign_to") == "new"
    title = F.when(opens, F.coalesce("new_title", "title")).otherwise(F.col("title"))
    reasoning = F.when(opens, F.coalesce("new_reasoning", "reasoning")).otherwise(F.col("reasoning"))
    drafted = asked.withColumns(
        {
            "draft_title": title,
            "draft_reasoning": reasoning,
            "draft_severity": F.when(opens, F.coalesce("new_severity", F.lit("unknown"))).otherwise(F.lit("unknown")),
            "draft_id": cluster_id(title, reasoning),
        }
    )
    opened = drafted.filter(opens).groupBy("codebase_id", F.col("draft_id").alias("assign_to")).agg(
        F.min(F.struct("chunk_no", "position")).alias("since")
    )
    known = clusters.select("codebase_id", F.col("cluster_id").alias("assign_to")).distinct().withColumn(
        "is_known", F.lit(True)
    )
    keys = ["codebase_id", "assign_to"]
    resolved = drafted.join(known, keys, "left").join(opened, keys, "left")
    joins = ~opens & (F.col("is_known").isNotNull() | (F.col("since") < F.struct("chunk_no", "position")))
    is_join = F.coalesce(joins, F.lit(False))
    return resolved.select(
        *INPUT,
        F.when(is_join, F.col("assign_to")).otherwise(F.col("draft_id")).alias("cluster_id"),
        (~is_join).alias("is_new"),
        "chunk_no",
        "position",
        "draft_title",
        "draft_reasoning",
        "draft_severity",
    )


def unassigned(chunks: DataFrame, assignments: DataFrame) -> DataFrame:
    """Findings of a chunk without an assignment; a failed chunk has none at all."""
    place = ["codebase_id", "chunk_no", "member_index"]
    return chunks.join(assignments.select(*place), place, "left_anti").select(*INPUT)


def orphan_clusters(orphans: DataFrame) -> DataFrame:
    """A cluster of its own for every orphan, as members with the cluster's text; keyed by (run, finding)."""
    return orphans.select(
        *INPUT, orphan_id(F.col("finding_index")).alias("cluster_id"), F.lit("unknown").alias("severity")
    )


def apply_assignments(
    assignments: DataFrame, chunks: DataFrame, clusters: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Clusters and members after an incremental round, without the orphans (see ``orphan_clusters``)."""
    placed = place_assignments(assignments, chunks, clusters)
    draft = F.struct(
        F.struct("chunk_no", "position").alias("at"),
        F.col("draft_title").alias("title"),
        F.col("draft_reasoning").alias("reasoning"),
        F.col("draft_severity").alias("severity"),
    )
    created = (
        placed.filter("is_new")
        .join(clusters.select("codebase_id", "cluster_id"), ["codebase_id", "cluster_id"], "left_anti")
        .groupBy("codebase_id", "cluster_id")
        .agg(F.min(draft).alias("d"))
        .select("codebase_id", "cluster_id", "d.title", "d.reasoning", "d.severity")
    )
    all_members = members.select(*MEMBER).unionByName(placed.select(*MEMBER))
    return (
        clusters.select(*CLUSTER).unionByName(created),
        all_members.dropDuplicates(["codebase_id", "cluster_id", *FINDING]),
    )


def expand_members(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Members of clusters a judge listed by index (codebase_id, chunk_no, title, reasoning, member_indices).

    Indices outside the chunk are dropped; a finding may belong to several clusters.
    """
    listed = answers.select(
        "codebase_id",
        "chunk_no",
        cluster_id(F.col("title"), F.col("reasoning")).alias("cluster_id"),
        F.explode("member_indices").alias("member_index"),
    )
    return listed.join(chunks, ["codebase_id", "chunk_no", "member_index"]).select(*MEMBER)


def connected_keys(edges: DataFrame) -> DataFrame:
    """Connected components of (scope, a, b) edges, as (scope, node, root) with the smallest node as root.

    Contraction in a random order (Bögeholz et al., 2020): every round moves each node to the first of itself and its
    neighbours in an order drawn anew by hash, so about half of the nodes and their edges are left for the next round and all
    rounds together move a few times the edges, however many there are. Neighbour lists are never gathered; their first is a
    map-side aggregate. Each round is written as a table, whose size the next one knows (that of a checkpoint is estimated, and
    multiplies from round to round). At last the moves are followed back, and components are named.
    """
    def of(end: str) -> DataFrame:
        return moves[-1].select("scope", F.col("node").alias(end), F.col("to").alias(f"to_{end}"))

    def undirected(a: str, b: str) -> list[Column]:
        return [F.col("scope"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    live = materialised(edges.filter("scope is not null and a <> b").select(*undirected("a", "b")).distinct())
    moves: list[DataFrame] = []
    while not live.isEmpty():
        def drawn(node: str) -> Column:
            return F.struct(F.xxhash64(F.lit(len(moves)), node).alias("draw"), F.col(node).alias("node"))

        both = live.select("scope", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            live.select("scope", F.col("b").alias("node"), F.col("a").alias("other"))
        )
        first = both.groupBy("scope", "node").agg(F.min(drawn("other")).alias("first"))
        moves.append(materialised(first.select("scope", "node", F.least("first", drawn("node"))["node"].alias("to"))))
        moved = live.join(of("a"), ["scope", "a"]).join(of("b"), ["scope", "b"]).filter("to_a <> to_b")
        live = materialised(moved.select(*undirected("to_a", "to_b")).distinct())
    if not moves:
        return live.select("scope", F.col("a").alias("node"), F.col("b").alias("root"))
    ends = moves.pop()
    for earlier in reversed(moves):
        later = ends.select("scope", F.col("node").alias("to"), F.col("to").alias("end"))
        ends = earlier.join(later, ["scope", "to"], "left").select("scope", "node", F.coalesce("end", "to").alias("to"))
    ends = materialised(ends)
    names = ends.groupBy("scope", "to").agg(F.min("node").alias("root"))
    return ends.join(names, ["scope", "to"]).select("scope", "node", "root")


SIMILAR = 0.7
HOT = 4096  # sets that hold a token; for each so many the sets that ask for it go to one more place


def word_key(words: Column) -> Column:
    """The node of a word set."""
    return F.concat(F.lit("w:"), F.array_join(words, " "))


def similar_groups(sets: DataFrame, theta: float = SIMILAR) -> DataFrame:
    """(scope, node, root): the distinct word sets of a scope (as ``word_key``) and the first one of their component, where
    sets link whose Jaccard reaches ``theta``.

    Links meet through rare tokens (prefix filter), which loses none: a set asks with the prefix for ``theta``. A head, the
    smaller set of a link, meets only sets of its size or larger, so the overlap is at least 2 theta / (1 + theta) of the
    head, and it is filed under the shorter prefix for that share. The sets that ask for a hot token are spread over salts,
    the heads under it are repeated for each. Links are not kept: first every set is compared with the first head of each
    of its tokens, which joins most; then each round (Boruvka) compares sets of different components only, keeps one link
    per component, and joins these, until there is none. So a round writes at most a row per set and token. A set carries its
    prefix and its root from round to round, so neither is looked up again for its tokens.
    """
    if not 0 < theta <= 1:
        raise ValueError("theta must be in (0, 1]")
    distinct = cut_lineage(sets.filter(F.size("words") > 0).select("scope", "words").distinct())
    frequencies = cut_lineage(
        distinct.select("scope", F.explode("words").alias("token")).groupBy("scope", "token").agg(F.count("*").alias("n"))
    )
    ordered = cut_lineage(rarest(distinct, frequencies, theta))
    salts = F.ceil(F.greatest(F.col("f.n"), F.lit(1)) / F.lit(HOT))  # a set without a scope has no frequencies

    def asked(frame: DataFrame, *carried: Column) -> DataFrame:
        found = frame.withColumn("f", F.explode("rare"))
        return found.select("scope", "f.token", "words", F.pmod(F.xxhash64("words"), salts).alias("salt"), *carried)

    def filed(frame: DataFrame, *carried: Column) -> DataFrame:
        shorter = F.slice("rare", F.lit(1), prefix_length(F.size("words"), 2 * theta / (1 + theta)))
        found = frame.withColumn("f", F.explode(shorter))
        return found.select("scope", "f.token", F.col("words").alias("head"), salts.alias("salts"), *carried)

    smaller = F.struct(F.size("head"), F.col("head")) < F.struct(F.size("words"), F.col("words"))
    long_enough = F.size("head") >= F.size("words") * F.lit(theta) - 1e-9
    shared = F.size(F.array_intersect("words", "head"))
    similar = smaller & long_enough & (shared / (F.size("words") + F.size("head") - shared) >= theta - 1e-9)

    first = filed(ordered).groupBy("scope", "token").agg(F.min(F.struct(F.size("head").alias("size"), "head")).alias("f"))
    stars = asked(ordered).join(first.select("scope", "token", "f.head"), ["scope", "token"]).filter(similar)
    joined = connected_keys(stars.select("scope", word_key(F.col("words")).alias("a"), word_key(F.col("head")).alias("b")))
    nodes = ordered.withColumn("node", word_key(F.col("words")))
    placed = materialised(
        nodes.join(joined, ["scope", "node"], "left").select("scope", "words", "rare", F.coalesce("root", "node").alias("root"))
    )
    while True:
        heads = filed(placed, F.col("root").alias("y")).withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
        )
        pairs = asked(placed, F.col("root").alias("x")).join(heads, ["scope", "token", "salt"])
        across = pairs.filter((F.col("x") != F.col("y")) & similar)
        ways = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
        kept = materialised(across.select("scope", F.inline(ways)).groupBy("scope", "x").agg(F.min("y").alias("y")))
        if kept.isEmpty():
            return placed.select("scope", word_key(F.col("words")).alias("node"), "root")
        merged = connected_keys(kept.select("scope", F.col("x").alias("a"), F.col("y").alias("b")))
        moved = merged.select("scope", F.col("node").alias("root"), F.col("root").alias("to"))
        placed = materialised(
            placed.join(moved, ["scope", "root"], "left").select("scope", "words", "rare", F.coalesce("to", "root").alias("root"))
        )


def cluster_findings(inputs: DataFrame, theta: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Full clustering without a judge: clusters and members.

    Inputs also hold root_cause. Two findings of a codebase belong together when they share a root cause or the set of
    title words, or have similar word sets (``similar_groups``), directly or through others. Root causes that meet in a group
    of similar sets link to the first of them, so the graph has root causes only, one edge per distinct (root cause, group),
    and never a pair of findings or sets. Findings move once, to the root of their cause. A codebase's only finding becomes
    'novel-1'.
    """
    keyed = materialised(inputs.select(*INPUT, F.concat(F.lit("c:"), "root_cause").alias("cause_key")))
    titled = keyed.select(F.col("codebase_id").alias("scope"), "cause_key", "title").distinct()
    worded = materialised(titled.select("scope", "cause_key", title_words(F.col("title")).alias("words")))
    groups = similar_groups(worded.select("scope", "words"), theta).withColumnRenamed("root", "first")
    caused = worded.filter("cause_key is not null").select("scope", "cause_key", word_key(F.col("words")).alias("node"))
    met = materialised(caused.join(groups, ["scope", "node"]).select("scope", "first", "cause_key").distinct())
    least = met.groupBy("scope", "first").agg(F.min("cause_key").alias("least"))
    edges = met.join(least, ["scope", "first"]).select("scope", F.col("cause_key").alias("a"), F.col("least").alias("b"))
    roots = connected_keys(edges).select(F.col("scope").alias("codebase_id"), F.col("node").alias("cause_key"), "root")
    totals = broadcast_if_small(keyed.groupBy("codebase_id").agg(F.count("*").alias("total")))
    name = F.when(F.col("total") == 1, "novel-1").otherwise(
        F.concat(F.lit("novel-"), F.substring(F.sha2("root", 256), 1, 12))
    )
    rooted = (
        keyed.join(roots, ["codebase_id", "cause_key"], "left")
        .withColumn("root", F.coalesce("root", "cause_key"))
        .join(totals, "codebase_id")
        .withColumn("cluster_id", name)
    )
    lead = F.min(F.struct("run_id", "finding_index", "title", "reasoning")).alias("lead")
    clusters = rooted.groupBy("codebase_id", "root", "cluster_id").agg(lead).select(
        "codebase_id",
        "cluster_id",
        F.col("lead.title").alias("title"),
        F.col("lead.reasoning").alias("reasoning"),
        F.lit("unknown").alias("severity"),
    )
    return clusters.select(*CLUSTER), rooted.filter(F.col("root").isNotNull()).select(*MEMBER)


def assign_incremental(new: DataFrame, clusters: DataFrame, theta: float = 0.5) -> DataFrame:
    """Assignments of new findings to the cluster with the most similar title from ``theta`` on, else to 'new'.

    ``new`` comes from ``judging.chunked``, so the result fits ``apply_assignments``; existing clusters stay as they are.
    """
    worded = new.withColumn("words", title_words(F.col("title")))
    offered = clusters.select(
        F.col("codebase_id").alias("scope"), title_words(F.col("title")).alias("words"),
        F.col("cluster_id").alias("target"), F.col("cluster_id").alias("position"),
    )
    best = best_similar(worded.select(F.col("codebase_id").alias("scope"), "words"), offered, theta).select(
        F.col("scope").alias("codebase_id"), "words", "target"
    )
    return worded.join(best, ["codebase_id", "words"], "left").select(
        "codebase_id",
        "chunk_no",
        F.col("member_index").alias("position"),
        "member_index",
        F.coalesce("target", F.lit("new")).alias("assign_to"),
        F.lit(None).cast("string").alias("new_title"),
        F.lit(None).cast("string").alias("new_reasoning"),
        F.lit(None).cast("string").alias("new_severity"),
    )


@dataclass(frozen=True)
class ClusterState:
    """What clustering keeps between rounds: the order of tokens, the index of word sets, and the root of every key."""

    frequencies: DataFrame  # scope, token, n: fixed by the first round, as any order serves a prefix filter
    asked: DataFrame  # scope, token, words, node: the tokens by which a set looks for sets of its size or smaller
    filed: DataFrame  # the same for the fewer tokens under which larger sets find it
    roots: DataFrame  # scope, node, root


def extend_roots(roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored roots (scope, node, root) after new edges (scope, a, b), and the rows among them that are new or changed.

    Edges are taken to the roots of their ends, and only what these connect is worked on; a component that meets no new
    edge is not touched. Of merged components the smallest root that was there before stays, so names are stable; new
    nodes name a component only among themselves.
    """

    def to_root(end: str) -> tuple[DataFrame, Column]:
        named = roots.select("scope", F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        return named, F.coalesce(F.concat(F.lit("0"), f"root_{end}"), F.concat(F.lit("1"), F.col(end)))

    named_a, label_a = to_root("a")
    named_b, label_b = to_root("b")
    ends = edges.join(named_a, ["scope", "a"], "left").join(named_b, ["scope", "b"], "left")
    ends = materialised(ends.select("scope", label_a.alias("a"), label_b.alias("b")).distinct())
    joined = connected_keys(ends)
    alone = ends.select("scope", F.explode(F.array("a", "b")).alias("node")).distinct().join(joined, ["scope", "node"], "left_anti")
    moves = materialised(joined.unionByName(alone.withColumn("root", F.col("node"))))
    target = F.substring("root", 2, 2**31 - 1)
    old, new = moves.filter(F.col("node").startswith("0") & (F.col("node") != F.col("root"))), moves.filter(F.col("node").startswith("1"))
    moved = old.select("scope", F.substring("node", 2, 2**31 - 1).alias("root"), target.alias("to"))
    rerooted = roots.join(moved, ["scope", "root"]).select("scope", "node", F.col("to").alias("root"))
    added = new.select("scope", F.substring("node", 2, 2**31 - 1).alias("node"), target.alias("root"))
    changed = materialised(rerooted.unionByName(added))
    kept = roots.join(moved.select("scope", "root"), ["scope", "root"], "left_anti").select("scope", "node", "root")
    return materialised(kept.unionByName(changed)), changed


def extend_clusters(state: ClusterState | None, inputs: DataFrame, theta: float = SIMILAR) -> tuple[ClusterState, DataFrame]:
    """The state after new findings, and the changed rows of its roots; components are those of ``cluster_findings``.

    ``inputs`` are cluster inputs with root_cause, new ones only or with known ones among them. New word sets meet the index
    of all in equi-joins on rare tokens, where the smaller set of a link is filed under the shorter prefix, as in
    ``similar_groups``; a link is kept per new set and component it meets. A finding's component is the root of its key
    ``c:<root cause>``.
    """
    cause = F.concat(F.lit("c:"), "root_cause").alias("cause_key")
    keyed = inputs.select(F.col("codebase_id").alias("scope"), cause, title_words(F.col("title")).alias("words")).distinct()
    node = F.when(F.size("words") > 0, word_key(F.col("words"))).otherwise(F.col("cause_key"))
    keyed = materialised(keyed.withColumn("node", node))
    fresh = keyed.filter(F.size("words") > 0).select("scope", "words", "node").distinct()
    if state is not None:
        fresh = fresh.join(state.roots.select("scope", "node"), ["scope", "node"], "left_anti")
    fresh = materialised(fresh)
    frequencies = state.frequencies if state is not None else materialised(
        fresh.select("scope", F.explode("words").alias("token")).groupBy("scope", "token").agg(F.count("*").alias("n"))
    )

    ordered = materialised(rarest(fresh.select("scope", "words"), frequencies, theta))

    def under(share: float) -> DataFrame:
        found = ordered.withColumn("f", F.explode(F.slice("rare", F.lit(1), prefix_length(F.size("words"), share))))
        return materialised(found.select("scope", "f.token", "words", word_key(F.col("words")).alias("node")))

    asked, filed = under(theta), under(2 * theta / (1 + theta))
    smaller = F.struct(F.size("head"), F.col("head")) < F.struct(F.size("words"), F.col("words"))
    long_enough = F.size("head") >= F.size("words") * F.lit(theta) - 1e-9
    shared = F.size(F.array_intersect("words", "head"))
    similar = smaller & long_enough & (shared / (F.size("words") + F.size("head") - shared) >= theta - 1e-9)

    def links(asking: DataFrame, heads: DataFrame) -> DataFrame:
        small = heads.select("scope", "token", F.col("words").alias("head"), F.col("node").alias("b"))
        found = asking.withColumnRenamed("node", "a").join(small, ["scope", "token"]).filter(similar)
        return found.select("scope", "a", "b")

    near = links(asked, filed)
    if state is not None:
        known = state.roots.select("scope", "node", F.col("root").alias("known_root"))

        def rooted(frame: DataFrame) -> DataFrame:
            named = frame.join(known, ["scope", "node"], "left")
            return named.select("scope", "token", "words", F.coalesce("known_root", "node").alias("node"))

        near = near.unionByName(links(asked, rooted(state.filed))).unionByName(links(rooted(state.asked), filed))
        asked, filed = (materialised(old.unionByName(new)) for old, new in ((state.asked, asked), (state.filed, filed)))
    edges = near.distinct()
    edges = edges.unionByName(keyed.select("scope", F.col("cause_key").alias("a"), F.col("node").alias("b")).distinct())
    roots = state.roots if state is not None else edges.select("scope", F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots, changed = extend_roots(roots, edges)
    return ClusterState(frequencies, asked, filed, roots), changed


def cluster_totals(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Findings and unique bugs per codebase."""
    sizes = members.groupBy("codebase_id").agg(F.count("*").alias("total_findings"))
    return (
        clusters.groupBy("codebase_id")
        .agg(F.count("*").alias("unique_bugs"))
        .join(sizes, "codebase_id", "left")
        .na.fill(0, ["total_findings"])
    )


def validation_defaults(clusters: DataFrame, replies: DataFrame, sourced: DataFrame) -> DataFrame:
    """One validation per cluster: the reply, or plausible with the cluster's severity and a reason.

    ``replies`` holds codebase_id, cluster_id, verdict, severity, reasoning, code_evidence, risk_category and
    error_code; ``sourced`` the clusters that have source code.
    """
    keys = ["codebase_id", "cluster_id"]
    answered = replies.select(
        *keys, "verdict", F.col("severity").alias("reply_severity"), F.col("reasoning").alias("reply_reasoning"),
        "code_evidence", "risk_category", "error_code",
    )
    joined = clusters.join(sourced.select(*keys).distinct().withColumn("has_source", F.lit(True)), keys, "left").join(
        answered, keys, "left"
    )
    ok = F.col("has_source").isNotNull() & F.col("verdict").isNotNull() & F.col("error_code").isNull()
    own = F.when(F.col("severity") == "unknown", "medium").otherwise(F.col("severity"))
    reason = F.when(F.col("has_source").isNull(), "No source code available for validation").otherwise(
        F.concat(F.lit("Validation failed: "), F.coalesce("error_code", F.lit("no reply")))
    )
    return joined.select(
        *keys,
        "title",
        F.when(ok, F.col("verdict")).otherwise("plausible").alias("verdict"),
        F.when(ok, F.col("reply_severity")).otherwise(own).alias("severity"),
        F.when(ok, F.col("reply_reasoning")).otherwise(reason).alias("reasoning"),
        F.when(ok, F.col("code_evidence")).alias("code_evidence"),
        F.when(ok, F.col("risk_category")).alias("risk_category"),
    )


def validation_summary(validations: DataFrame) -> DataFrame:
    """Verdict counts per codebase."""
    return validations.groupBy("codebase_id").agg(
        *[F.count_if(F.col("verdict") == name).alias(name) for name in ("confirmed", "plausible", "rejected")]
    )
