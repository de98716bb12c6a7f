"""Mixing: amounts against a plain recursion, prefixes, edge cases."""

import hashlib
import random
from collections import defaultdict

from gaugeline.llm import common, mixing


def pour(budget, nodes):
    """nodes: name -> (supply, weight)"""
    out, left, weights = {}, budget, sum(w for _, w in nodes.values())
    for name, (supply, weight) in sorted(nodes.items(), key=lambda n: (n[1][0] / n[1][1], n[0])):
        if supply * weights <= left * weight:
            out[name], left, weights = supply, left - supply, weights - weight
        else:
            out |= {n: left * w // weights for n, (_, w) in nodes.items() if n not in out}
            break
    return out


def plain(data, mix):
    leaves, members = defaultdict(int), defaultdict(list)
    for doc_id, text, lang, source in data:
        source = source or mixing.UNKNOWN
        number = "".join(c for c in source if c.isdigit())
        leaf = (f"domain{int(number or 0) % 4}", lang or mixing.UNKNOWN, source)
        n = len((text or "").split())
        leaves[leaf] += n
        members[leaf].append((doc_id, n))
    weight = lambda level, name: mix.weights.get(level, {}).get(name, 1)
    amounts = {(): sum(leaves.values()) * mix.budget_percent // 100}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in [p for p in amounts if len(p) == depth]:
            supply = defaultdict(int)
            for leaf, n in leaves.items():
                if leaf[:depth] == parent:
                    supply[leaf[depth]] += n * mix.max_epochs
            amounts |= {(*parent, k): v for k, v in pour(amounts[parent], {k: (s, weight(level, k)) for k, s in supply.items()}).items()}
    out = []
    for leaf, rows in members.items():
        epochs, rest = divmod(amounts[leaf], leaves[leaf]) if leaves[leaf] else (0, 0)
        key = lambda i: hashlib.md5(f"{mix.seed}:{epochs}:{'null' if i is None else i}".encode()).hexdigest()  # noqa: E731, B023
        for doc_id, n in rows:
            before = sum(m for other, m in rows if key(other) <= key(doc_id))
            copies = epochs + (rest > 0 and before <= rest)
            if copies:
                out.append((doc_id, *leaf, n, copies))
    return sorted(out, key=str)


def test_selection_equals_plain_recursion(spark, monkeypatch):
    rng = random.Random(4)
    data = [(i, "w " * rng.randrange(40), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src5", "web", None])) for i in range(300)]
    data += [(7, "again again", "en", "src0"), (7, "again again", "en", "src0"), (None, "no id", "en", "src0"), (900, None, "xx", "src9"), (901, "", "xx", "src9")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as domain", "2 as copies", "3 as row")
    for mix in (mixing.PRODUCTION, mixing.Mix(budget_percent=170, max_epochs=3), mixing.Mix(budget_percent=0)):
        got = sorted(map(tuple, mixing.mix_sources(frame, mix).collect()), key=str)
        assert got == plain(data, mix)
        again = mixing.selected_rows(frame, mix)
        assert again.columns == frame.columns and again.count() == sum(r[-1] for r in got)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(mixing, "ONE_TASK_LEAVES", 0)
    assert sorted(map(tuple, mixing.mix_sources(frame).collect()), key=str) == plain(data, mixing.PRODUCTION)
    assert mixing.mix_sources(frame.limit(0)).collect() == []
