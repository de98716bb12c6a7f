"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they match. Weak candidates (account-like identifiers, key-like strings, service
endpoints) are reported only when a complementary part stands in the same scope: an identifier next to a secret, a
secret next to an identifier, an endpoint next to a secret. Parts meet through an interval join: a part is filed under
every cell of its scope that its reach touches, parts of a document meet in the cells, and the exact distance decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import written

REACH = 240  # code points between linked parts, at most

# The strong patterns of the contract. Letters of the assignment are spelled out in both cases; a
# match is dropped afterwards if its value is too short, so it still takes its place.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Weak candidates: a run of characters and what the run must look like
IDENT, IDENT_FORM = r"[A-Z0-9]{12,}", r"^([A-Z]{2,5}[0-9][A-Z0-9]{8,}|[0-9]{12})$"
KEY, KEY_FORM = r"[A-Za-z0-9+/_-]{20,}", r"[0-9].*[A-Z]|[A-Z].*[0-9]"
URL = r"(https?|ftp|ssh|redis|amqp|postgres|postgresql|mysql|mongodb)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
KINDS = ["assign", "access", "hex", "ident", "key", "url"]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, IDENT, KEY, URL]))
STRONG = 3  # the first kinds
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "key": "secret", "url": "endpoint"}
WANTS = {"ident": ["secret"], "key": ["id"], "url": ["secret"]}


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches in order, each with the length of the text before it since the last match."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    parts = [found.alias("m"), gaps.alias("g")]
    if kind == "assign":
        parts.append(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("v"))
    good = {
        "assign": lambda x: F.char_length(x["v"]) >= ASSIGN_VALUE,
        "ident": lambda x: x["m"].rlike(IDENT_FORM),
        "key": lambda x: x["m"].rlike(KEY_FORM),
    }.get(kind, lambda x: F.lit(True))
    return F.transform(
        F.arrays_zip(*parts),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("nth"),
            F.char_length(x["m"]).alias("length"),
            F.char_length(x["g"]).alias("gap"),
            good(x).alias("good"),
        ),
    )


def spans(documents: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end): the spans of all patterns, and a row of null kind where there is none.

    A match that fails its form becomes a row of null kind too: it took its place in the text, and no document vanishes.
    """
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found = rows.select(
        "row", "doc_id", F.explode_outer(F.concat(*[matches(F.col("text"), kind) for kind in KINDS])).alias("s")
    ).select("row", "doc_id", "s.*")
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    placed = found.select("row", "doc_id", "kind", "good", (end - F.col("length")).alias("start"), end.alias("end"))
    return placed.select("row", "doc_id", *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("kind", "start", "end")])


def named(kind: Column, mapping: dict[str, str]) -> Column:
    return F.element_at(F.array(*[F.lit(mapping[k]) for k in KINDS]), kind + 1)


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, kind, start, end, partners) of the weak candidates that have a complementary part within reach.

    Cells are ``reach`` wide. A candidate asks in the cells that its interval widened by ``reach`` touches; a partner
    is filed under the cells it covers. Spans of one kind never overlap, so a cell holds at most ``reach`` of them and
    no document, however long, becomes one group. A part never counts as its own partner or that of a span it overlaps.
    """
    parts = found.filter("kind is not null").withColumn("role", named(F.col("kind"), ROLE))
    cell = lambda c: F.floor(c / F.lit(reach)).cast("long")
    asked = reduce(
        DataFrame.unionByName,
        [
            parts.filter(F.col("kind") == KINDS.index(kind)).select(
                "row", "kind", "start", "end", F.lit(role).alias("role"),
                F.explode(
                    F.sequence(cell(F.greatest(F.col("start") - reach, F.lit(0))), cell(F.col("end") + reach))
                ).alias("cell"),
            )
            for kind, roles in WANTS.items()
            for role in roles
        ],
    )
    filed = parts.select(
        "row", "role", F.col("start").alias("p_start"), F.col("end").alias("p_end"),
        F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("cell"),
    )
    near = (F.col("p_start") >= F.col("end")) & (F.col("p_start") - F.col("end") <= reach) | (
        F.col("start") >= F.col("p_end")
    ) & (F.col("start") - F.col("p_end") <= reach)
    return (
        asked.join(filed, ["row", "role", "cell"])
        .filter(near)
        .groupBy("row", "kind", "start", "end")
        .agg(F.count_distinct("p_start").alias("partners"))
    )


def scan_secrets(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are kind:start:end in code points, end exclusive, ordered by start and then by kind. A null text is empty and
    has no spans; a repeated row is answered once per occurrence; an empty table gives an empty result.
    """
    found = written(spans(documents))
    strong = F.col("kind") < STRONG
    everything = found.select(
        "row", "doc_id", *[F.when(strong, F.col(c)).alias(c) for c in ("kind", "start", "end")]
    ).unionByName(linked(found, reach).select("row", F.lit(None).cast("long").alias("doc_id"), "kind", "start", "end"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    written_out = lambda a: F.array_join(
        F.transform(
            a,
            lambda x: F.concat_ws(":", named(x["kind"], {k: k for k in KINDS}), x["start"], x["end"]),
        ),
        ",",
    )
    count = lambda n: F.count_if(F.col("kind") == n).alias(f"n_{KINDS[n]}")
    return (
        everything.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            *[count(n) for n in range(STRONG)],
            F.count_if(F.col("kind") >= STRONG).alias("n_linked"),
            F.sort_array(F.collect_list(span)).alias("all"),
        )
        .select(
            "doc_id", "n_assign", "n_access", "n_hex",
            F.sha2(written_out(F.filter("all", lambda x: x["kind"] < STRONG)), 256).alias("base_sha256"),
            written_out(F.col("all")).alias("spans"),
            "n_linked",
        )
    )


def oracle() -> str:
    """The same scan in DuckDB: positions from the pieces between matches, links by distance inside a document."""
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    value = {
        "assign": f"length(regexp_extract(m, '{quoted['assign']}', 2)) >= {ASSIGN_VALUE}",
        "ident": f"regexp_matches(m, '{IDENT_FORM}')",
        "key": f"regexp_matches(m, '{KEY_FORM}')",
    }
    found = "\n  union all\n".join(
        f"""  select doc_id, {n} as kind, nth, m, gap, {value.get(k, "true")} as good from (
    select doc_id, unnest(regexp_extract_all(t, '{quoted[k]}')) as m,
           unnest(string_split_regex(t, '{quoted[k]}')[1:len(regexp_extract_all(t, '{quoted[k]}'))]) as gap,
           unnest(range(len(regexp_extract_all(t, '{quoted[k]}')))) as nth
    from texts)"""
        for n, k in enumerate(KINDS)
    )
    roles = " ".join(f"when {n} then '{ROLE[k]}'" for n, k in enumerate(KINDS))
    wants = ", ".join(f"({KINDS.index(k)}, '{r}')" for k, rs in WANTS.items() for r in rs)
    names = " ".join(f"when {n} then '{k}'" for n, k in enumerate(KINDS))
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as (
{found}
),
placed as (
  select doc_id, kind, good, length(m) as n,
         cast(sum(length(gap) + length(m)) over (partition by doc_id, kind order by nth) as bigint) as stop
  from found
),
parts as (
  select doc_id, kind, stop - n as start, stop, case kind {roles} end as role from placed where good
),
weak as (
  select distinct a.doc_id, a.kind, a.start, a.stop
  from parts a
  join (values {wants}) w(kind, role) on w.kind = a.kind
  join parts b on b.doc_id = a.doc_id and b.role = w.role
  where b.start >= a.stop and b.start - a.stop <= {REACH} or a.start >= b.stop and a.start - b.stop <= {REACH}
),
reported as (
  select doc_id, kind, start, case kind {names} end || ':' || start || ':' || stop as span
  from (select doc_id, kind, start, stop from parts where kind < {STRONG} union all select * from weak)
),
lists as (
  select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
         count(*) filter (where kind = 2) as n_hex, count(*) filter (where kind >= {STRONG}) as n_linked,
         string_agg(span, ',' order by start, kind) filter (where kind < {STRONG}) as base,
         string_agg(span, ',' order by start, kind) as spans
  from reported group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       coalesce(n_linked, 0) as n_linked, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join lists using (doc_id)
"""
