import random

import pytest

from pyspark.sql import functions as F

from gaugeline.operators import clustering, judging, matching, refresh

INPUT = "codebase_id string, run_id string, condition_id string, finding_index int, title string, reasoning string"
CAUSED = INPUT + ", root_cause string"
CLUSTER = "codebase_id string, cluster_id string, title string, reasoning string, severity string"


def finding(run, index, title, condition="c1", reasoning="why"):
    return ("cb", run, condition, index, title, reasoning)


def ids(frame):
    return {(r.run_id, r.finding_index) for r in frame.collect()}


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_connected_keys(rows, shape):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(120)]
    if shape == "random":
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)]
    elif shape == "chain":
        order = names[:]
        rng.shuffle(order)
        edges = list(zip(order, order[1:]))
    else:
        edges = [(names[77], n) for n in names]
    frame = rows([("s", a, b) for a, b in edges], "scope string, a string, b string")
    got = {r.node: r.root for r in clustering.connected_keys(frame).collect()}
    want = union_find(edges, names)
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want[n] for n in touched}


def test_all_rounds_of_components_write_a_few_times_the_edges(rows, monkeypatch):
    """A chain of 400 nodes in a shuffled order: the rows of a round fall, whatever the number of rounds."""
    written, real = [], clustering.materialised

    def counted(frame):
        frame = real(frame)
        written.append(frame.count())
        return frame

    monkeypatch.setattr(clustering, "materialised", counted)
    order = [f"n{i:03d}" for i in range(400)]
    random.Random(5).shuffle(order)
    edges = [("s", a, b) for a, b in zip(order, order[1:])] + [("s", "n003", "n003"), ("s", None, "n004"), (None, "x", "y")]
    found = clustering.connected_keys(rows(edges, "scope string, a string, b string")).collect()
    assert sorted(r.node for r in found) == sorted(order) and {(r.scope, r.root) for r in found} == {("s", "n000")}
    assert sum(written) <= 6 * 400


def test_findings_move_once_to_their_cluster(rows):
    data = [finding(f"r{i}", 1, f"Weak group g{i // 2}") + (f"c{i // 3}",) for i in range(12)]
    _, members = clustering.cluster_findings(rows(data, CAUSED))
    plan = members._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(codebase_id" in line]
    assert len(moved) <= 2 and not any("root" in line for line in moved)
    assert len({r.cluster_id for r in members.collect()}) == 2


def test_findings_without_cause_link_titles_only(rows):
    titles = {"r1": "a b c d e", "r2": "a b c d e f", "r3": "b c d e f", "r4": None}
    cause = {"r1": "x", "r2": None, "r3": "z", "r4": "w"}
    data = [finding(run, 1, title) + (cause[run],) for run, title in titles.items()] + [(None, "r5", "c1", 1, "a b c d e", "why", "v")]
    clusters, members = clustering.cluster_findings(rows(data, CAUSED))
    cluster = {r.run_id: r.cluster_id for r in members.collect()}
    assert set(cluster) == {"r1", "r3", "r4"} and cluster["r1"] == cluster["r3"] != cluster["r4"]
    assert clusters.count() == 3


def test_full_clustering_joins_by_cause_or_title(rows):
    data = [
        finding("r1", 1, "Reentrancy in exit") + ("pool::exit::reentrancy",),
        finding("r2", 1, "exit: in REENTRANCY") + ("unknown::x",),
        finding("r2", 2, "Other words here") + ("pool::exit::reentrancy",),
        finding("r3", 1, "Something else") + ("gate::other",),
        finding("r3", 2, "!!!") + ("gate::blank",),
    ]
    clusters, members = clustering.cluster_findings(rows(data, CAUSED))
    groups = {}
    for r in members.collect():
        groups.setdefault(r.cluster_id, set()).add((r.run_id, r.finding_index))
    assert sorted(map(sorted, groups.values())) == [
        [("r1", 1), ("r2", 1), ("r2", 2)], [("r3", 1)], [("r3", 2)]]
    totals = clustering.cluster_totals(clusters, members).first()
    assert (totals.total_findings, totals.unique_bugs) == (5, 3)


def test_similar_titles_are_clustered(rows):
    data = [
        finding("r1", 1, "Missing cap on fee in vault") + ("a::x",),
        finding("r2", 1, "Missing cap on fee in the vault") + ("b::y",),
        finding("r3", 1, "Missing owner of token") + ("c::z",),
    ]
    _, members = clustering.cluster_findings(rows(data, CAUSED))
    groups = {}
    for r in members.collect():
        groups.setdefault(r.cluster_id, set()).add(r.run_id)
    assert sorted(map(sorted, groups.values())) == [["r1", "r2"], ["r3"]]


def test_similar_titles_meet_past_smaller_sets_of_their_words(rows):
    titles = ["in overflow vault withdraw", "in overflow vault withdraw x", "a in overflow", "a vault withdraw"]
    data = [finding(f"r{i}", 1, title) + (f"c{i}::x",) for i, title in enumerate(titles)]
    _, members = clustering.cluster_findings(rows(data, CAUSED))
    cluster = {r.run_id: r.cluster_id for r in members.collect()}
    assert cluster["r0"] == cluster["r1"] and len(set(cluster.values())) == 3


@pytest.mark.parametrize("theta", [0.3, 0.7, 1.0])
def test_similar_groups_are_components_of_all_pairs(rows, monkeypatch, theta):
    monkeypatch.setattr(clustering, "HOT", 7)
    rng = random.Random(4)
    words = [f"w{i:02}" for i in range(14)]
    sets = sorted({(rng.choice("st"), tuple(sorted(set(rng.choices(words[: rng.choice([6, 14])], k=rng.randint(1, 9)))))) for _ in range(150)})
    frame = rows([(scope, list(own)) for scope, own in sets] + [("s", []), ("s", None)], "scope string, words array<string>")
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for s, a in sets:
        for z, b in sets:
            if s == z and a < b and len(set(a) & set(b)) / len(set(a) | set(b)) >= theta - 1e-9:
                x, y = sorted((find((s, a)), find((z, b))))
                root[y] = x
    groups = {}
    for x in sets:
        groups.setdefault(find(x), []).append("w:" + " ".join(x[1]))
    want = {(r[0], n, min(g)) for r, g in groups.items() for n in g}
    got = [tuple(r) for r in clustering.similar_groups(frame, theta).select("scope", "node", "root").collect()]
    assert len(got) == len(sets) and set(got) == want and (theta == 1.0 or len(groups) < len(sets))


def test_no_round_writes_more_than_a_row_per_set_and_token(rows, monkeypatch):
    """Sets that share nine of ten words: 300 sets, 44,850 similar pairs, one component."""
    written, real = [], clustering.cut_lineage

    def counted(frame):
        frame = real(frame)
        written.append(frame.count())
        return frame

    monkeypatch.setattr(clustering, "cut_lineage", counted)
    common = [f"c{i}" for i in range(9)]
    frame = rows([("s", sorted([*common, f"x{i:03}"])) for i in range(300)], "scope string, words array<string>")
    found = clustering.similar_groups(frame).collect()
    assert len(found) == 300 and len({r.root for r in found}) == 1 and max(written) <= 300 * 10


def test_extended_clusters_equal_a_full_clustering(rows):
    """Findings added in rounds; components that no new finding meets keep their rows, and merged ones an old name."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    data = []
    for i in range(120):
        title = " ".join(rng.choices(words, k=rng.randint(0, 6)))
        data.append((rng.choice(["s", "t"]), f"r{i}", "c", i, title, "why", f"cause{rng.randrange(60)}"))
    schema = "codebase_id string, run_id string, condition_id string, finding_index int, title string, reasoning string, root_cause string"
    state, before = None, {}
    for start, end in ((0, 70), (60, 110), (110, 120)):
        state, changed = clustering.extend_clusters(state, rows(data[start:end], schema))
        roots = {(r.scope, r.node): r.root for r in state.roots.collect()}
        assert len(roots) == state.roots.count()
        moved = {(r.scope, r.node) for r in changed.collect()}
        assert {k for k, r in roots.items() if before.get(k) != r} == moved
        assert all(before[k] != roots[k] for k in moved if k in before)
        assert all(r in {x for (s, _), x in before.items() if s == k[0]} for k, r in roots.items() if k in before)
        before = roots
        _, members = clustering.cluster_findings(rows(data[:end], schema))
        full = {r.run_id: (r.codebase_id, r.cluster_id) for r in members.collect()}
        mine = {d[1]: (d[0], roots[(d[0], "c:" + d[6])]) for d in data[:end]}
        pairs = {(full[run], mine[run]) for run in full}
        assert len(pairs) == len({f for f, _ in pairs}) == len({m for _, m in pairs})


def test_few_new_edges_touch_few_roots(rows):
    schema = "scope string, node string, root string"
    stored = rows([("s", f"n{i:03}", f"n{i // 10 * 10:03}") for i in range(200)], schema)
    edges = rows([("s", "n015", "n027"), ("s", "new", "n199"), ("s", "p", "q")], "scope string, a string, b string")
    roots, changed = clustering.extend_roots(stored, edges)
    got = {r.node: r.root for r in changed.collect()}
    assert got == {f"n{i:03}": "n010" for i in range(20, 30)} | {"new": "n190", "p": "p", "q": "p"}
    assert roots.count() == 203


def test_a_single_input_becomes_novel_1(rows):
    clusters, members = clustering.cluster_findings(rows([finding("r1", 4, "T") + ("a::b",)], CAUSED))
    assert [(r.cluster_id, r.title, r.severity) for r in clusters.collect()] == [("novel-1", "T", "unknown")]
    assert ids(members) == {("r1", 4)}


def test_new_and_pruned(rows):
    inputs = rows([finding("r1", 1, "a"), finding("r1", 2, "b"), finding("r2", 1, "c", "c2")], INPUT)
    members = rows(
        [("cb", "k1", "r1", "c1", 1, "a"), ("cb", "k1", "r9", "c3", 1, "gone"), ("cb", "k2", "r9", "c3", 2, "gone")],
        "codebase_id string, cluster_id string, run_id string, condition_id string, finding_index int, title string")
    clusters = rows([("cb", "k1", "a", "r", "high"), ("cb", "k2", "b", "r", "high")], CLUSTER)
    assert ids(clustering.new_findings(inputs, members)) == {("r1", 2), ("r2", 1)}
    live = clustering.prune_members(members, inputs)
    assert ids(live) == {("r1", 1)}
    assert [r.cluster_id for r in clustering.prune_clusters(clusters, live).collect()] == ["k1"]
    assert [r.condition_id for r in clustering.caught_conditions(live).collect()] == ["c1"]
    summary = clustering.prune_summary(members, live).first()
    assert (summary.pruned_findings, summary.dropped_clusters) == (2, 1)


def test_apply_assignments(rows):
    inputs = rows([finding(f"r{i}", 1, f"T{i}", "c2") for i in range(7)], INPUT)
    chunks = judging.chunked(inputs, judging.INCREMENTAL_CHUNK)
    assert {(r.run_id, r.chunk_no, r.member_index) for r in chunks.collect()} == {
        (f"r{i}", i // 5, i % 5 + 1) for i in range(7)}
    clusters = rows([("cb", "k1", "old", "r", "high")], CLUSTER)
    members = rows([("cb", "k1", "r0", "c2", 1, "T0")],
                   "codebase_id string, cluster_id string, run_id string, condition_id string, finding_index int, title string")
    import hashlib

    opened = "novel-" + hashlib.sha256(b"Newbecause").hexdigest()[:8]
    fallback = "novel-" + hashlib.sha256(b"T2why").hexdigest()[:8]
    assignments = rows(
        [("cb", 0, 1, 1, "k1", None, None, None), ("cb", 0, 2, 2, "new", "New", "because", "low"), ("cb", 0, 3, 3, "nope", None, None, None),
         ("cb", 0, 4, 9, "k1", None, None, None), ("cb", 1, 1, 1, opened, None, None, None), ("cb", 0, 5, 2, "k1", None, None, None)],
        "codebase_id string, chunk_no long, position int, member_index int, assign_to string, new_title string, new_reasoning string, new_severity string")
    after, people = clustering.apply_assignments(assignments, chunks, clusters, members)
    assert {(r.cluster_id, r.title, r.severity) for r in after.collect()} == {
        ("k1", "old", "high"), (opened, "New", "low"), (fallback, "T2", "unknown")}
    assert {(r.cluster_id, r.run_id) for r in people.collect()} == {
        ("k1", "r0"), ("k1", "r1"), (opened, "r1"), (opened, "r5"), (fallback, "r2")}
    orphans = clustering.orphan_clusters(clustering.unassigned(chunks, assignments))
    assert {(r.run_id, r.cluster_id) for r in orphans.collect()} == {
        ("r3", "novel-orphan-1"), ("r4", "novel-orphan-1"), ("r6", "novel-orphan-1")}


def test_expand_members(rows):
    chunks = judging.chunked(rows([finding(f"r{i}", 1, f"T{i}") for i in range(3)], INPUT), judging.FULL_CHUNK)
    answers = rows([("cb", 0, "A", "x", [1, 2, 0, 9]), ("cb", 0, "B", "x", [2])],
                   "codebase_id string, chunk_no long, title string, reasoning string, member_indices array<int>")
    got = {(r.cluster_id, r.run_id) for r in clustering.expand_members(answers, chunks).collect()}
    assert sorted(run for _, run in got) == ["r0", "r1", "r1"] and len({c for c, _ in got}) == 2


@pytest.mark.parametrize("theta", [0.3, 0.5, 0.8, 1.0])
def test_prefix_filter_finds_what_all_pairs_find(rows, theta):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    left = [("s" if i % 4 else "t", sorted(set(rng.choices(words, k=rng.randint(1, 6))))) for i in range(80)]
    right = [("s" if i % 4 else "t", sorted(set(rng.choices(words, k=rng.randint(1, 6)))), f"x{i}", i) for i in range(40)]
    got = {(r.scope, tuple(r.words)): (r.target, round(r.score, 9)) for r in matching.best_similar(
        rows(left, "scope string, words array<string>"),
        rows(right, "scope string, words array<string>, target string, position int"), theta).collect()}
    want = {}
    for scope, own in left:
        best = None
        for other_scope, theirs, target, position in right:
            score = len(set(own) & set(theirs)) / len(set(own) | set(theirs))
            if scope == other_scope and score >= theta - 1e-9 and (best is None or (-score, position) < best[:2]):
                best = (-score, position, target)
        if best:
            want[(scope, tuple(own))] = (best[2], round(-best[0], 9))
    assert got == want


def test_rule_matcher(rows):
    gt = rows([("cb", "H-01", 0, "Reentrancy in exit", "Pool", "reentrancy"), ("cb", "M-01", 1, "Fee is never capped", None, "other")],
              "codebase_id string, gt_id string, gt_pos int, title string, contract string, vuln_type string")
    found = rows(
        [("r", 1, 1, "cb", "Drain", "pool::exit::reentrancy", "reentrancy"), ("r", 2, 2, "cb", "Fee never capped", "gate::x", "other"),
         ("r", 3, 3, "cb", "Nothing alike", "gate::y", "other"), ("r", 4, 4, "cb", "Vague", "unknown::vague", "other"),
         ("r", 5, 5, "zz", "Drain", "pool::exit::reentrancy", "reentrancy")],
        "run_id string, position int, finding_index int, codebase_id string, title string, root_cause string, vuln_type string")
    got = {r.finding_index: (r.category, r.matched_gt_id, r.confidence) for r in matching.rule_matcher(found, gt).collect()}
    assert got == {1: ("matched", "H-01", "high"), 2: ("matched", "M-01", "medium"), 3: ("novel", None, "low"),
                   4: ("fp", None, "low"), 5: ("novel", None, "low")}


def test_parse_responses(rows):
    raws = ['{"category":"novel","confidence":"high","reasoning":"x","matchedGtId":null}', 'Sure {"category":"fp","confidence":"low","reasoning":"y"} ok',
            "none", "{broken}", '{"category":"maybe","confidence":"low","reasoning":"z"}', '{"category":"fp","confidence":"low"}', None]
    frame = rows(list(enumerate(raws)), "id int, raw string")
    out = judging.parse_responses(frame, judging.CLASSIFY_REPLY, judging.CLASSIFY_ENUMS, required=["reasoning"])
    assert {r.id: r.error_code for r in out.collect()} == {
        0: None, 1: None, 2: "parse", 3: "parse", 4: "validation", 5: "validation", 6: "parse"}
    arrays = rows([(0, 'x [{"a":1},{"a":2}] y'), (1, '[{"a":null}]')], "id int, raw string")
    out = judging.parse_responses(arrays, "struct<a:int>", required=["a"], shape="array")
    assert {r.id: (r.error_code, r.reply and len(r.reply)) for r in out.collect()} == {0: (None, 2), 1: ("validation", None)}


def test_retry_and_requests(rows):
    attempts = rows([("a", 1, "parse"), ("a", 2, "timeout"), ("b", 1, "validation"), ("c", 1, "exit"), ("c", 2, None), ("d", 3, "exit")],
                    "request_id string, attempt int, error_code string")
    assert [(r.request_id, r.attempt) for r in judging.retry_eligible(attempts, 3).collect()] == [("a", 2)]
    chunks = judging.chunked(rows([finding("r1", i, f"T{i}") for i in range(17)], INPUT), judging.FULL_CHUNK)
    got = {r.chunk_no: (r.findings, r.listing.split("\n")[0]) for r in judging.cluster_requests(chunks).collect()}
    assert got == {0: (15, "1. T0"), 1: (2, "1. T15")}


def test_validation_defaults(rows):
    clusters = rows([("cb", f"k{i}", "t", "r", s) for i, s in enumerate(["high", "unknown", "low"])], CLUSTER)
    replies = rows([("cb", "k0", "rejected", "low", "no", "f()", None, None), ("cb", "k1", None, None, None, None, None, "parse")],
                   "codebase_id string, cluster_id string, verdict string, severity string, reasoning string, code_evidence string, "
                   "risk_category string, error_code string")
    out = {r.cluster_id: r for r in clustering.validation_defaults(clusters, replies, clusters.filter("cluster_id <> 'k2'")).collect()}
    assert (out["k0"].verdict, out["k0"].severity) == ("rejected", "low")
    assert (out["k1"].verdict, out["k1"].severity, out["k1"].reasoning) == ("plausible", "medium", "Validation failed: parse")
    assert (out["k2"].severity, out["k2"].reasoning) == ("low", "No source code available for validation")


def test_hashes_notice_changes_and_ignore_order(rows):
    data = [finding("r1", i, f"T{i}") for i in range(4)]
    first = refresh.cluster_input_hash(rows(data, INPUT), "m").first().input_hash
    assert refresh.cluster_input_hash(rows(data[::-1], INPUT), "m").first().input_hash == first
    assert refresh.cluster_input_hash(rows(data[:3], INPUT), "m").first().input_hash != first
    assert refresh.cluster_input_hash(rows(data, INPUT), "m2").first().input_hash != first
    assert refresh.cluster_input_hash(rows(data, INPUT), "m", True).first().input_hash != first
    hashes = refresh.cluster_input_hash(rows(data, INPUT), "m")
    existing = rows([("cb", "m", first)], "codebase_id string, cluster_model string, input_hash string")
    assert refresh.stale_clusters(hashes, existing, "m").count() == 0
    assert refresh.stale_clusters(hashes, existing, "m2").count() == 1
    assert refresh.stale_clusters(hashes, existing, "m", force=True).count() == 1


def test_stale_classifications(rows):
    shape = "run_id string, gt_hash string, stdout_hash string, prompt_hash string"
    current = rows([(r, "g", "s", "p") for r in "abcd"], shape)
    existing = rows([("a", "g", "s", "p"), ("b", "g", "old", "p"), ("c", "g", "s", None)], shape)
    assert {r.run_id for r in refresh.stale_classifications(current, existing).collect()} == {"b", "c", "d"}
    assert refresh.stale_classifications(current, existing, force=True).count() == 4


def test_a_frequent_token_does_not_bring_sets_together(rows):
    schema = "codebase_id string, run_id string, condition_id string, finding_index int, title string, reasoning string, root_cause string"
    data = [("cb", f"r{i}", "c", i, f"Weak group g{i // 2}" + (" again" if i % 2 else ""), "r", f"k{i}") for i in range(120)]
    state, _ = clustering.extend_clusters(None, rows(data[:80], schema))
    state, _ = clustering.extend_clusters(state, rows(data[80:], schema))
    assert state.filed.filter("token in ('again', 'weak', 'group')").isEmpty()
    assert state.asked.join(state.filed.select("scope", "token"), ["scope", "token"]).count() == 240
    roots = {r.node: r.root for r in state.roots.collect()}
    pairs = {(roots[f"c:k{i}"], i // 2) for i in range(120)}
    assert len(pairs) == len({a for a, _ in pairs}) == 60


def test_chunks_read_their_inputs_once(spark, rows):
    calls = spark.sparkContext.accumulator(0)

    def read(title):
        calls.add(1)
        return title

    data = [("cb", i // 3, "c", i, f"t{i}", "r") for i in range(23)]
    inputs = rows(data, "codebase_id string, run_id int, condition_id string, finding_index int, title string, reasoning string")
    got = judging.chunked(inputs.withColumn("title", F.udf(read, "string")("title")), 5).collect()
    assert {(r.title, r.chunk_no, r.member_index) for r in got} == {(f"t{i}", i // 5, i % 5 + 1) for i in range(23)}
    assert calls.value == 23
