"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashes of word n-grams. A fixed share of the hash space, the counted part, comes first in the common order of
all tokens: rare tokens by the number of sets that hold them, then the frequent ones, class by class; all other tokens
follow. A set may differ from a partner in at most E = n - ceil(threshold n) of its n tokens, so partners share one of its
first E+1 tokens. Tokens of class k (k > 1: frequent) are dealt to groups and stand for themselves only k at a time: a
group of c tokens counts c-k+1, and the prefix is extended until it counts E+1. Were no combination shared, at least E+1
tokens of the prefix would be missing in the partner. The number of groups follows the size band of the pair; a set whose
partners may be in the next band is indexed in both.

Tokens that one set alone holds need no signature: a set that has E+1 of them has no partner. The sets left are compared
in full: those of a large bucket with its first set, then all, in blocks, within the groups that their buckets connect.
Links are counted inside components, in blocks too; pairs are never rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import BROADCAST_BYTES, SPACES, binary, in_blocks, shuffle_partitions, texts
from gaugeline.llm.components import components
from gaugeline.session import materialised

WIDTH = 4
THRESHOLD = 85  # percent
COUNTED = 0.3  # share of the hash space whose tokens are counted
FREQUENT = ((2, 1 / 1000), (3, 1 / 50))  # class k: tokens in at least this share of the sets
FREQUENT_TOKENS = 1 << 18  # the most frequent ones at most; any set of them keeps the result exact
GROUP = {2: 4, 3: 6}  # tokens of a prefix meant for one group of the class
PLAIN = 5  # in bands below 2^5 tokens all tokens are rare
BLOCK_SETS, BLOCK_TOKENS = 512, 1 << 20  # sets compared with each other at once
CELLS = 1 << 23  # of an incidence matrix
HASHED = 1 << 22  # bytes hashed at once
CHUNK = 1 << 22  # tokens counted at once


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Per byte: what it is in lower case (A-Z only), whether it is white space of the contracts, and its 64-bit weight.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), dtype=np.uint8))
WEIGHT = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[LOWER]
STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word; ``bounds`` are the byte positions at which the texts begin and, last, end.

    A word's hash is a polynomial over the weights of its bytes, scrambled with its length.
    """
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    number = np.cumsum(first)[inside] - 1  # the word of each byte inside one
    at = np.flatnonzero(inside)
    depth = at - starts[number]
    powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(int(depth.max()), STEP))))
    cuts = np.flatnonzero(first[at])
    sums = np.add.reduceat(WEIGHT[data[at]] * powers[depth], cuts)
    lengths = np.diff(np.append(cuts, len(at))).astype(np.uint64)
    return mixed(sums + lengths * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(bounds, starts, side="right") - 1


def token_runs(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text of a binary column as sorted hashes, one text after the other, and their bounds.

    A text with fewer words than ``width`` has one n-gram of all its words. Bytes are hashed HASHED at a time, cut between
    words, so a long text needs memory for its words only.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    hashes, owners, at = [], [], 0
    while at < len(data):
        end = min(at + HASHED, len(data))
        while end < len(data) and not SPACE[data[end - 1]]:
            gap = np.flatnonzero(SPACE[data[end : end + HASHED]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + HASHED, len(data))
        h, o = word_hashes(data[at:end], np.clip(bounds, at, end) - at)
        hashes.append(h)
        owners.append(o)
        at = end
    count = len(texts)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(count + 1, dtype=np.int64)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    words = np.bincount(owners, minlength=count)
    sizes = np.minimum(words, width)[owners]  # words in an n-gram of the text
    left = np.cumsum(words)[owners] - np.arange(len(owners))  # words from here to the text's end
    heads = np.flatnonzero(left >= sizes)
    sizes, owners = sizes[heads], owners[heads]
    tokens = sizes.astype(np.uint64)
    for j in range(width):
        more = sizes > j
        tokens[more] = mixed(tokens[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[heads[more] + j])
    ends = np.cumsum(np.bincount(owners, minlength=count)).tolist()
    for start, end in zip([0, *ends[:-1]], ends):
        tokens[start:end].sort()
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1]))[: len(tokens)]
    return tokens[new], np.concatenate(([0], np.cumsum(np.bincount(owners[new], minlength=count))))


def ceil_share(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def groups(band: int, percent: int) -> dict[int, int]:
    """Groups of each class in a band."""
    errors = (1 << band) * (100 - percent) / 100
    return {k: max(1, round(errors * size / (size - k + 1) / size)) for k, size in GROUP.items()} if band >= PLAIN else {}


def bands(n: int, percent: int) -> list[int]:
    """The bands in which a set of n tokens can meet a partner at least as large."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n // percent >= 1 << own + 1 else [own]


def tail_size(n: int, counted: int, percent: int) -> int:
    """Uncounted tokens that a prefix may need."""
    lost = max(sum((k - 1) * g for k, g in groups(b, percent).items()) for b in bands(n, percent))
    need = n - ceil_share(n, percent) + 1
    return min(need, max(0, need + lost - counted), n - counted)


def token_sets(documents: DataFrame, width: int, percent: int, counted: float) -> DataFrame:
    """Written: row, doc_id, key (of the set), n, n_counted, counted, tail (tokens; null where the task met the key before)."""
    limit = np.uint64(min(int(counted * 2**64), 2**64 - 1))
    names = ["row", "doc_id", "key", "n", "n_counted", "counted", "tail"]

    def run(batches):
        met = set()
        for batch in in_blocks(batches, "text"):
            tokens, bounds = token_runs(binary(batch.column("text")), width)
            head = tokens < limit
            before = np.concatenate(([0], np.cumsum(head)))
            sizes, heads = np.diff(bounds), before[bounds[1:]] - before[bounds[:-1]]
            keys, kept = [], np.zeros(len(sizes), dtype=bool)
            tails = np.zeros(len(sizes), dtype=np.int64)
            for i, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                key = xxhash.xxh128_digest(tokens[start:end]) if end > start else None
                keys.append(key)
                if key is not None and key not in met:
                    met.add(key)
                    kept[i] = True
                    tails[i] = tail_size(end - start, int(heads[i]), percent)
            place = np.arange(len(tokens)) - np.repeat(bounds[:-1], sizes)
            mine, skip = np.repeat(kept, sizes), np.repeat(heads, sizes)
            tail = mine & (place >= skip) & (place < skip + np.repeat(tails, sizes))
            ints = [pa.array(x.astype(np.int32)) for x in (sizes, heads)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(keys, pa.binary()),
                    *ints,
                    lists(tokens[mine & head], np.where(kept, heads, 0), kept),
                    lists(tokens[tail], tails, kept),
                ],
                names=names,
            )

    numbered = texts(documents).withColumn("row", F.monotonically_increasing_id())
    schema = "row long, doc_id long, key binary, n int, n_counted int, counted array<long>, tail array<long>"
    return materialised(numbered.mapInArrow(run, schema))


def lists(values: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Runs of ``values`` as lists of longs; null where not valid."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)), mask=pa.array(~valid))


def frequent_tokens(sets: DataFrame) -> DataFrame:
    """(token, class): counted tokens that many sets hold, at most FREQUENT_TOKENS; small and written.

    A task reports what is frequent among some thousands of its sets, so a token frequent in all is reported somewhere.
    """
    least = min(share for _, share in FREQUENT)

    def run(batches):
        held, size, sets_held = [], 0, 0

        def report():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(8, least / 2 * sets_held)
            return pa.RecordBatch.from_arrays([pa.array(tokens[some]), pa.array(counts[some])], names=["token", "count"])

        for batch in batches:
            column = batch.column("counted")
            held.append(np.asarray(column.flatten(), dtype=np.int64))
            size, sets_held = size + len(held[-1]), sets_held + batch.num_rows - column.null_count
            if size >= CHUNK:
                yield report()
                held, size, sets_held = [], 0, 0
        if size:
            yield report()

    total = sets.agg(F.count("counted")).first()[0]
    share = F.col("count") / F.lit(max(total, 1))
    kind = F.lit(1)
    for k, least_share in FREQUENT:
        kind = F.when(share >= least_share, k).otherwise(kind)
    counts = sets.filter("counted is not null").select("counted").mapInArrow(run, "token long, count long")
    counts = counts.groupBy("token").agg(F.sum("count").alias("count"))
    found = counts.select("token", "count", kind.alias("class")).filter("class > 1").orderBy(F.desc("count"), "token")
    return materialised(found.limit(FREQUENT_TOKENS).select("token", "class"))


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(row, token, place): the counted tokens that more than one row holds; place orders them, its class in the high bits.

    Frequent tokens are known beforehand and stay where they are; the others meet by token.
    """
    frequent = F.broadcast(frequent_tokens(sets))  # at most FREQUENT_TOKENS
    each = sets.select(F.explode("counted").alias("token"), "row")
    named = each.join(frequent, "token").select("row", "token", F.shiftleft(F.col("class").cast("long"), 40).alias("place"))
    rare = each.join(frequent, "token", "left_anti")

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the token that may go on in the next batch

        def rows(tokens, owners):
            cuts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            sizes = np.diff(np.append(cuts, len(tokens)))
            places = np.repeat(sizes, sizes)
            some = places > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(owners[some]), pa.array(tokens[some]), pa.array(places[some])], names=["row", "token", "place"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, owners = (np.asarray(batch.column(c), dtype=np.int64) for c in ("token", "row"))
            if held and tokens[0] == held[0][0][0] and tokens[-1] == tokens[0]:
                held.append((tokens, owners))
                continue
            tokens, owners = (np.concatenate(x) for x in zip(*held, (tokens, owners)))
            last = int(np.searchsorted(tokens, tokens[-1]))
            if last:
                yield rows(tokens[:last], owners[:last])
            held = [(tokens[last:], owners[last:])]
        if held:
            yield rows(*(np.concatenate(x) for x in zip(*held)))

    dealt = rare.repartition(shuffle_partitions(sets.sparkSession), "token").sortWithinPartitions("token")
    return dealt.mapInArrow(run, "row long, token long, place long").unionByName(named)


def prefix(places, tokens, alone: int, tail, n: int, band: int, percent: int) -> list[tuple]:
    """The signatures of one set in one band; (places, tokens) ascending, ``alone`` tokens that no other set holds."""
    need = n - ceil_share(n, percent) + 1 - alone
    dealt, out = groups(band, percent), []
    groups_met: dict[tuple[int, int], list[int]] = {}
    for place, token in zip(places, tokens):
        if need <= 0:
            return out
        k = place >> 40
        if k < 2 or k not in dealt:
            out.append((1, token))
            need -= 1
            continue
        group = groups_met.setdefault((k, (token >> 20) % dealt[k]), [])
        out += [(k, *others, token) for others in combinations(group, k - 1)]
        group.append(token)
        need -= len(group) >= k
    for token in tail[: max(need, 0)]:
        out.append((1, token))
    return out


def signatures(rows: DataFrame, percent: int) -> DataFrame:
    """(sig, row) for rows with row, n, alone, tail and found, an array of (place, token)."""

    def run(batches):
        for batch in batches:
            owners, sizes, signed = [], [], []
            for r in batch.to_pylist():
                found = sorted((x["place"], x["token"]) for x in r["found"] or ())
                places, tokens = [p for p, _ in found], [t for _, t in found]
                for band in bands(r["n"], percent):
                    made = prefix(places, tokens, r["alone"], r["tail"], r["n"], band, percent)
                    width = len(GROUP) + 3
                    lead = [(band, *sorted(m[1:]), *[0] * (width - len(m) - 1), m[0]) for m in made]
                    if lead:
                        signed.append(np.array(lead, dtype=np.int64).view(np.uint64))
                        owners.append(r["row"])
                        sizes.append(len(lead))
            if not signed:
                continue
            parts = np.concatenate(signed)
            out = np.zeros(len(parts), dtype=np.uint64)
            for column in parts.T:
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.view(np.int64)), pa.array(np.repeat(np.array(owners, dtype=np.int64), sizes))], names=["sig", "row"]
            )

    return rows.mapInArrow(run, "sig long, row long")


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a block of sets."""
    count = len(sets)
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(count), [len(s) for s in sets])
    _, where, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(times), -1)
    column[shared] = np.arange(len(shared))
    column = column[where]
    owners, column = owners[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    out = np.zeros((count, count))
    step = max(1, min(CELLS // count, len(shared)))
    for start in range(0, len(shared), step):
        a, b = np.searchsorted(column, (start, start + step))
        held = np.zeros((count, step), dtype=np.float32)  # sums of ones are exact up to 2^24 cells in a step
        held[owners[a:b], column[a:b] - start] = 1
        out += held @ held.T
    return out.astype(np.int64)


def runs(batches, keys: list[str]):
    """Lists of rows (dicts) with equal keys; rows come sorted by them."""
    held, key = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if (mine := tuple(r[k] for k in keys)) != key:
                if held:
                    yield key, held
                held, key = [], mine
            held.append(r)
    if held:
        yield key, held


def tokens_of(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, dtype=np.uint64)


def pairs_frame(pairs) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def full_sets(documents: DataFrame, live: DataFrame, width: int) -> DataFrame:
    """Written: row, n, tokens (sorted 64-bit words in one cell) of the live rows (row, doc_id, key).

    Texts are read again, those whose id is live only; the ids are broadcast up to BROADCAST_BYTES.
    """
    ids = materialised(live.select(F.col("doc_id").alias("_live")).distinct())
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    docs = texts(documents)
    wanted = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_live"]), "left_semi").select("text")

    def run(batches):
        for batch in in_blocks(batches, "text"):
            tokens, bounds = token_runs(binary(batch.column("text")), width)
            found = [tokens[start:end].tobytes() for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            keys = [xxhash.xxh128_digest(x) if x else None for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["key", "tokens"])

    read = wanted.mapInArrow(run, "key binary, tokens binary")
    rows = live.select("row", "key").join(read.groupBy("key").agg(F.first("tokens").alias("tokens")), "key")
    return materialised(rows.select("row", (F.octet_length("tokens") / 8).cast("long").alias("n"), "tokens"))


def measured(frame: DataFrame) -> DataFrame:
    """A written frame of numbers, to be broadcast if it has at most BROADCAST_BYTES."""
    return F.broadcast(frame) if frame.count() * (16 + 8 * len(frame.columns)) <= BROADCAST_BYTES else frame


def star_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that link with the first set of one of their buckets (sig, row)."""
    partitions = shuffle_partitions(sets.sparkSession)
    firsts = materialised(buckets.groupBy("sig").agg(F.min("row").alias("first")))
    pairs = buckets.join(firsts, "sig").filter("row <> first").select("row", "first").distinct()
    salts = F.ceil(F.col("size") / BLOCK_SETS)  # a set with very many others meets them in several tasks
    pairs = materialised(pairs)
    often = measured(materialised(pairs.groupBy("first").agg(F.count("*").alias("size"))))
    dealt = materialised(pairs.join(often, "first").select("row", "first", F.pmod(F.xxhash64("row"), salts).alias("salt")))
    members = sets.join(measured(dealt), "row").select("first", "salt", "row", "tokens")
    wanted = measured(materialised(dealt.select("first", "salt").distinct()))
    heads = sets.withColumnRenamed("row", "first").join(wanted, "first")
    heads = heads.select("first", "salt", F.lit(None).cast("long").alias("row"), "tokens")

    def run(batches):
        head, key = None, None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                tokens = tokens_of(r["tokens"])
                if r["row"] is None:
                    head, key = tokens, r["first"]
                    continue
                assert key == r["first"]
                at = np.minimum(np.searchsorted(head, tokens), len(head) - 1)
                if linked(int((head[at] == tokens).sum()), len(head), len(tokens), percent):
                    found.append((r["row"], key))
            yield pairs_frame(found)

    rows = heads.unionByName(members).repartition(partitions, "first", "salt")
    return rows.sortWithinPartitions("first", "salt", F.col("row").asc_nulls_first()).mapInArrow(run, "a long, b long")


def in_pair_blocks(members: DataFrame, sets: DataFrame, group: str, also: str) -> DataFrame:
    """Sets of each group of the written ``members`` (group, row, also) dealt so that any two meet in one block (i, j), i <= j.

    A group's blocks hold about BLOCK_SETS sets and BLOCK_TOKENS tokens; a row comes once for each block it is paired with.
    """
    sized = sets.select("row", "n").join(measured(members), "row")
    count = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    sizes = measured(materialised(sized.groupBy(group).agg(count.alias("blocks"))))
    placed = members.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select(group, "row", also, "own", other).select(
        group, "row", also, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    rows = sets.select("row", "tokens").join(measured(materialised(pairs)), "row")
    rows = rows.repartition(shuffle_partitions(sets.sparkSession), group, "i", "j")
    return rows.sortWithinPartitions(group, "i", "j", "row")


def crossing(rows: list[dict], i: int, j: int) -> np.ndarray:
    """Which pairs of a block pair belong to it: each pair once, in any block pair of its group."""
    own = np.array([r["own"] for r in rows])
    upper = np.triu(np.ones((len(rows), len(rows)), dtype=bool), 1)
    return upper if i == j else upper & (own[:, None] != own[None, :])


def merges(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the edges (a, b), those that join two components so far: a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        if (u := root(x)) != (v := root(y)):
            parent[u] = v
            out.append((x, y))
    return out


def bucket_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges between linked sets that share a bucket (sig, row, size); enough to connect all of them.

    The sets of a bucket of over BLOCK_SETS are first compared with its first one, which joins most of a large family.
    Buckets that then hold several components, directly or through others, are one group, so that a set is sent to its
    group once and not with each of its buckets; there it is compared, in blocks, with the sets of other components.
    """
    large = buckets.filter(F.col("size") > BLOCK_SETS).select("sig", "row")
    stars = materialised(star_links(large, sets, percent))
    roots = components(stars, materialised).withColumnRenamed("node", "row")
    roots = sets.select("row").join(roots, "row", "left").select("row", F.coalesce("root", "row").alias("root"))
    roots = measured(materialised(roots))
    rooted = buckets.select("sig", "row").join(roots, "row")
    heads = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("row").alias("first"))
    heads = materialised(heads.filter("low <> high").select("sig", "first"))
    edges = rooted.join(heads, "sig").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct()
    members = components(edges, materialised).select(F.col("root").alias("group"), F.col("node").alias("row"))
    members = members.join(roots, "row")

    def run(batches):
        for (_, i, j), rows in runs(batches, ["group", "i", "j"]):
            found = [tokens_of(r["tokens"]) for r in rows]
            n = np.array([len(x) for x in found])
            root = np.array([r["root"] for r in rows])
            near = crossing(rows, i, j) & (root[:, None] != root[None, :])
            near &= linked(np.minimum(n[:, None], n[None, :]), n[:, None], n[None, :], percent)
            if near.any():
                near &= linked(overlaps(found), n[:, None], n[None, :], percent)
                a, b = np.nonzero(near)
                yield pairs_frame(merges(root[a], root[b]))

    links = in_pair_blocks(materialised(members), sets, "group", "root").mapInArrow(run, "a long, b long")
    return links.unionByName(stars)


def link_counts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(row, n_links) for members (root, row, copies): the documents of other sets that each set links with."""

    def run(batches):
        for (_, i, j), rows in runs(batches, ["root", "i", "j"]):
            found = [tokens_of(r["tokens"]) for r in rows]
            n = np.array([len(x) for x in found])
            near = linked(overlaps(found), n[:, None], n[None, :], percent) & crossing(rows, i, j)
            counts = (near | near.T) @ np.array([r["copies"] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["row"] for r in rows], pa.int64()), pa.array(counts, pa.int64())], names=["row", "links"]
            )

    parts = in_pair_blocks(members, sets, "root", "copies").mapInArrow(run, "row long, links long")
    return parts.groupBy("row").agg(F.sum("links").alias("n_links"))


def jaccard_join(
    documents: DataFrame, percent: int = THRESHOLD, width: int = WIDTH, counted: float = COUNTED
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Documents link when the Jaccard similarity of their sets of word n-grams is at least ``percent`` (70 or more).
    component_id is the smallest doc_id reachable over links, the row's own included; n_links counts the documents, other
    than the row itself, that it links with directly, equal ones included. Texts without words, null among them, have no set,
    link with nothing and are a component each. Repeated rows are documents of their own; a null id names a component only
    if there is no other. Texts of any length are read whole. Other columns are left behind, clashing ones too. An empty
    table gives an empty result. Sets are told apart by 128 bits, n-grams by 64.
    """
    if not 70 <= percent <= 100:
        raise ValueError("prefixes are long enough for thresholds from 70 to 100 percent")
    sets = token_sets(documents, width, percent, counted)
    shared = shared_tokens(sets.filter("counted is not null").select("row", "counted"))
    found = shared.groupBy("row").agg(F.collect_list(F.struct("place", "token")).alias("found"))  # at most the set itself
    need = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    narrow = sets.filter("counted is not null").select("row", "doc_id", "key", "n", "n_counted", "tail")
    first = narrow.groupBy("key").agg(F.min("row").alias("row"))  # equal sets of several tasks once
    narrow = narrow.join(first.select("row"), "row", "left_semi")
    open_ = narrow.join(found, "row", "left").withColumn("alone", F.col("n_counted") - F.coalesce(F.size("found"), F.lit(0)))
    live = materialised(open_.filter(F.col("alone") < need))
    signed = materialised(signatures(live.select("row", "n", "alone", "tail", "found"), percent).distinct())
    sizes = signed.groupBy("sig").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialised(signed.join(sizes, "sig"))
    live = materialised(live.join(buckets.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "key"))
    full = full_sets(documents, live, width)
    edges = materialised(bucket_links(buckets, full, percent))
    roots = components(edges, materialised)
    per_key = sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = materialised(per_key.join(live.select("key", "row"), "key", "left"))
    met = classes.filter("row is not null").select("key", "row", "copies", "least")
    met = materialised(met.join(roots.withColumnRenamed("node", "row"), "row"))
    counts = link_counts(met.select("root", "row", "copies"), full, percent)
    least = met.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialised(met.select("row", "root").join(least, "root").join(counts, "row").select("row", "component_id", "n_links"))
    classes = materialised(
        classes.join(named, "row", "left").select(
            "key",
            F.coalesce("component_id", "least").alias("component_id"),
            (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        )
    )
    own = sets.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"))
    joined = own.filter("key is not null").join(classes, "key").select("doc_id", "n_shingles", "component_id", "n_links")
    none = own.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(none)


ORACLE = """
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE
    WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS s
  FROM split),
classes AS (SELECT min(doc_id) AS c, count(*) AS copies, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (n + m - common)),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS c, sum(copies) AS others FROM links JOIN classes ON links.b = classes.c GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  (coalesce(others, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links
FROM sets LEFT JOIN classes USING (s) LEFT JOIN roots USING (c) LEFT JOIN counts USING (c)
"""
