"""Domain relations derived from the driver's star-schema tables, so every operator runs over whole tables.

Runs are orders, codebases are regions, conditions are order priorities, ground truth are suppliers, findings are
line items. Nothing here sorts or collects a group: identifiers that stand for an order (finding index, vote number,
ground-truth position) come from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.partitions import spread
from gaugeline.functions.text import classify_keyword
from gaugeline.operators.extraction import extract_findings
from gaugeline.operators.voting import dedup_gt_match

SEVERITIES = ["high", "medium", "low"]


class Tables:
    """Lazy readers for the tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def runs(t: Tables) -> DataFrame:
    """Runs; priority 5-LOW is the bare baseline, status P an invalid run, every 11th run unclassified."""
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_regionkey"
    )
    key, bare = F.col("o_orderkey"), F.col("o_orderpriority") == "5-LOW"
    return t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("run_id"),
        F.col("n_regionkey").alias("codebase_id"),
        F.when(bare, "bare_audit").otherwise(F.col("o_orderpriority")).alias("condition_id"),
        F.col("o_orderdate").alias("ts"),
        F.floor("o_totalprice").alias("duration_ms"),
        F.when(key % 7 != 0, (key % 400) / F.lit(4.0)).alias("cost_usd"),
        F.when(bare, "bare").otherwise("skill").alias("mode"),
        (F.col("o_orderstatus") != "P").alias("is_valid"),
        (key % 11 != 0).alias("is_classified"),
        (key % 13 == 0).alias("timed_out"),
        F.when(key % 17 == 0, 143).when(key % 19 == 0, 1).otherwise(0).alias("exit_code"),
        F.floor(F.col("o_totalprice") / 100).alias("text_chars"),
    )


def conditions(t: Tables) -> DataFrame:
    """The condition list with configured positions; 1-URGENT is left out on purpose (an unknown condition)."""
    names = t.orders.select("o_orderpriority").distinct().filter("o_orderpriority <> '1-URGENT'")
    bare = F.col("o_orderpriority") == "5-LOW"
    return names.select(
        F.when(bare, "bare_audit").otherwise(F.col("o_orderpriority")).alias("condition_id"),
        F.when(bare, "bare").otherwise("skill").alias("type"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("position"),
    )


def ground_truth(t: Tables) -> DataFrame:
    """Ground truth of four of the five codebases; region 4 has none. Every seventh item states no severity."""
    key = F.col("s_suppkey")
    severity = F.when(key % 7 == 0, None).when(key % 3 == 0, "high").when(key % 3 == 1, "medium").otherwise("low")
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .filter("n_regionkey <> 4")
        .select(
            F.col("n_regionkey").alias("codebase_id"),
            key.alias("gt_id"),
            key.alias("gt_pos"),
            severity.alias("severity"),
            F.concat(F.lit("Missing check of the stored balance in the vault of "), "s_name").alias("title"),
        )
    )


def _finding_index() -> Column:
    """A stable number per line item: (order, line) is not unique in the data."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (F.col("l_partkey") * 1_000_000_000 + cents) * 8 + F.col("l_linenumber")


def findings(t: Tables, judged: DataFrame | None = None) -> DataFrame:
    """All findings of all runs, or of the runs in ``judged`` (run_id), whose join then deals them out."""
    if judged is None:
        items = spread(t.lineitem, "l_orderkey")
    else:
        items = t.lineitem.join(judged.select(F.col("run_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    return items.join(runs(t), F.col("l_orderkey") == F.col("run_id")).select(
        "run_id",
        _finding_index().alias("finding_index"),
        "codebase_id",
        "condition_id",
        "is_valid",
        "is_classified",
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.concat(F.lit("Finding on part "), "l_partkey").alias("title"),
        "l_returnflag",
        "l_linestatus",
    )


def finding_counts(t: Tables) -> DataFrame:
    """Parsed findings per run."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("findings_count"))


def runs_counted(t: Tables) -> DataFrame:
    """``runs`` with the number of parsed findings."""
    return runs(t).join(finding_counts(t), "run_id", "left").na.fill(0, ["findings_count"])


def raw_labels(t: Tables, judged: DataFrame | None = None) -> DataFrame:
    """Labels before match deduplication, for classified runs (those in ``judged``); every sixth item is never matched."""
    items = ground_truth(t).select("codebase_id", F.col("gt_id").alias("supplier_id"), F.lit(True).alias("_known"))
    joined = findings(t, judged).filter("is_classified").join(items, ["codebase_id", "supplier_id"], "left")
    matched = (F.col("l_returnflag") == "R") & F.col("_known") & (F.col("supplier_id") % 6 != 5)
    category = (
        F.when(matched, "matched")
        .when(F.col("l_returnflag").isin("R", "A"), "fp")
        .when(F.col("l_linestatus") == "F", "novel")
        .otherwise("uncertain")
    )
    agreement = 1 + F.col("part_id") % 3
    return joined.select(
        "run_id",
        F.col("finding_index").alias("position"),
        "finding_index",
        "codebase_id",
        "condition_id",
        "is_valid",
        "part_id",
        "title",
        agreement.alias("agreement_count"),
        F.concat(agreement, F.lit("/3")).alias("agreement"),
        category.alias("category"),
        F.when(matched, F.col("supplier_id")).alias("matched_gt_id"),
        F.concat(F.lit("seen on part "), "part_id").alias("reasoning"),
    )


def labels(t: Tables, judged: DataFrame | None = None) -> DataFrame:
    """Labels after match deduplication, which looks at one run each, so ``judged`` may name the runs."""
    return dedup_gt_match(raw_labels(t, judged))


def wide_runs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, labels and ground truth with matched sets out of 400 ids: a run per customer, a label per line item."""
    key = F.col("c_custkey")
    runs_wide = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("codebase_id"),
        F.col("c_mktsegment").alias("condition_id"),
        key.alias("run_id"),
        (key % 9 != 0).alias("is_valid"),
        (key % 10 != 0).alias("is_classified"),
    )
    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    labels_wide = items.select(F.col("o_custkey").alias("run_id"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 400).alias("matched_gt_id"))
    truth = t.region.filter("r_regionkey <> 2").select(F.col("r_regionkey").alias("codebase_id"))
    return runs_wide, labels_wide, truth


def votes(t: Tables) -> DataFrame:
    """Votes on (user, day) units; the event number orders them, an error event is a failed vote."""
    kind = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("unit_user"),
        F.date_format("ts", "yyyy-MM-dd").alias("unit_day"),
        (F.col("user_id") % 4).alias("codebase_id"),
        F.col("event_id").alias("vote_no"),
        F.when(kind == "click", "matched").when(kind == "view", "novel").when(kind != "error", "fp").alias("category"),
        F.when(kind == "click", F.col("event_id") % 3).alias("matched_gt_id"),
        F.lit("high").alias("confidence"),
        F.concat(F.lit("vote "), "event_id").alias("reasoning"),
    )


def members(t: Tables, known_labels: DataFrame | None = None) -> DataFrame:
    """Cluster members: novel and uncertain findings, clustered by brand."""
    loose = (known_labels or labels(t)).filter(F.col("category").isin("novel", "uncertain"))
    parts = t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("cluster_id"))
    return loose.join(parts, "part_id").select(
        "codebase_id", "cluster_id", "run_id", "condition_id", "finding_index", "title"
    )


def clusters(t: Tables, known_labels: DataFrame | None = None) -> DataFrame:
    """One row per cluster."""
    pairs = members(t, known_labels).select("codebase_id", "cluster_id").distinct()
    number = F.col("codebase_id") + F.regexp_replace("cluster_id", "[^0-9]", "").cast("int")
    return pairs.withColumns(
        {
            "n": number,
            "title": F.concat(F.lit("Weak accounting across the shared modules of "), "cluster_id"),
            "severity": F.when(number % 3 == 0, "unknown").otherwise("high"),
        }
    )


def verdicts(t: Tables, known_labels: DataFrame | None = None) -> DataFrame:
    """Validations of the clusters."""
    return verdicts_of(clusters(t, known_labels))


def verdicts_of(known_clusters: DataFrame) -> DataFrame:
    """Validations; every fourth cluster stays unvalidated, every seventh is listed twice with another verdict."""
    base = known_clusters.filter("n % 4 <> 3")
    word = F.when(F.col("n") % 4 == 0, "confirmed").when(F.col("n") % 4 == 1, "plausible").otherwise("rejected")
    columns = [
        "codebase_id",
        "cluster_id",
        "title",
        F.when(F.col("n") % 5 == 0, "centralization-risk").alias("risk_category"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("Guard missing in the withdraw path of the module kept by "),
                                            "cluster_id")).alias("code_evidence"),
        "severity",
    ]
    first = base.select(*columns, F.lit(0).alias("pos"), word.alias("verdict"))
    again = base.filter("n % 7 = 0").select(*columns, F.lit(1).alias("pos"), F.lit("rejected").alias("verdict"))
    return first.unionByName(again)


# Word lists of the report stand-in.
REPORT_KEYWORDS = [
    "Reentrancy", "Missing Access Control", "Unchecked Return Value", "Phishing via tx.origin", "Unsafe Overflow",
    "Front-Running", "Denial of Service", "Flash Loan Attack", "Oracle Manipulation", "Delegatecall Misuse",
    "Selfdestruct Exposure", "Integer Division", "Floating Pragma", "Weak Naming",
]
REPORT_CONTRACTS = ["Vault", "Bridge", "Router", "TokenSale", "PriceOracle"]
REPORT_FUNCTIONS = ["withdraw", "transfer", "swap", "buy", "getPrice"]
REPORT_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def _words(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{word}'" for word in words) + ")"


def reports(t: Tables) -> DataFrame:
    """Report texts: every document, whole, with report headings set between its lines in ten styles by doc_id."""
    pick = {
        "keyword": f"element_at({_words(REPORT_KEYWORDS)}, cast(1 + (doc_id + i) % 14 as int))",
        "contract": f"element_at({_words(REPORT_CONTRACTS)}, cast(1 + (doc_id * 3 + i) % 5 as int))",
        "function": f"element_at({_words(REPORT_FUNCTIONS)}, cast(1 + (doc_id + i * 2) % 5 as int))",
        "severity": f"element_at({_words(REPORT_SEVERITIES)}, cast(1 + (doc_id + i) % 5 as int))",
    }
    title = "concat({keyword}, case (doc_id + i) % 3 when 0 then concat(' in ', {contract}, '.', {function}) " \
            "when 1 then concat(' in `', {function}, '()`') else concat(' of part ', i) end)"
    pick["title"] = title.format(**pick)
    header = """case doc_id % 10
      when 0 then concat('[', 40 + i % 60, '] **', (i div 4) % 3 + 1, '. ', {title}, '**',
                         case when i % 8 = 0 then concat('\\n`', {contract}, '.', {function}, '` · Confidence: 80') else '' end)
      when 1 then concat('### [', {severity}, '] ', {title},
                         case when i % 8 = 0 then concat(' — ', {contract}, '.sol:', i) else '' end)
      when 2 then concat('### ', left({severity}, 1), '-', i, ': ', {title})
      when 3 then concat('## [', left({severity}, 1), '-', i, '] ', {title})
      when 4 then concat('### ', i, '. ', {title}, ' — **', {severity}, '**')
      when 5 then concat('#### ', i, '. ', {title}, ' (', lower({severity}), ')')
      when 6 then concat('**', i, '. [', {severity}, '] ', {title}, '**')
      when 7 then concat('### ', i, '. ', {title})
      else concat('## [', 40 + i % 60, '] ', i, '. ', {title}) end""".format(**pick)
    body = """concat(
      case when i % 12 = 2 then concat('## ', {contract}, '.sol\\n') when i % 20 = 6 then '## Medium Severity\\n'
           when i % 28 = 10 then '## Summary\\n' when i % 16 = 3 then concat('### Possible ', {keyword}, ' risk\\n') else '' end,
      case when i % 4 = 0 then concat({header}, '\\n') else '' end,
      case when i % 12 = 1 then concat('```\\n', l, '\\n```') else l end)""".format(header=header, **pick)
    text = f"""case when doc_id % 10 = 9 then text else concat(
      case when doc_id % 20 = 0 then '🔐 Security Review\\n\\n' when doc_id % 20 = 7 then '## High Severity\\n' else '' end,
      array_join(transform(split(text, '\\n'), (l, i) -> {body}), '\\n'),
      '\\n| Critical | 2 | open |\\n| High | Vault | Reentrancy |\\n| 3 | [95] | Reentrancy |') end"""
    return spread(t.documents, "doc_id").select(F.col("doc_id").alias("run_id"), F.expr(text).alias("text"))


def log_lines(t: Tables) -> DataFrame:
    """Event logs: every row of ``events`` as one JSON line of the run ``user_id``; some error rows are malformed."""
    return log_lines_of(spread(t.events, "event_id"))


def log_lines_of(events: DataFrame) -> DataFrame:
    """``log_lines`` for a batch or streaming read of ``events``."""
    raw = """case event_type
      when 'signup' then concat('{"type":"system","subtype":"init","model":"model-', user_id % 3,
        '","slash_commands":["help"', case when event_id % 50 = 0 then ',"auditor"' else '' end, '],"tools":["Read"]}')
      when 'click' then concat('{"type":"assistant","parent_tool_use_id":', case when event_id % 6 = 0 then '"t1"' else 'null' end,
        ',"message":{"model":"model-', event_id % 3, '","content":[{"type":"text","text":"step ', event_id,
        '"},{"type":"tool_use","id":"t', event_id % 7, '","name":"', element_at(array('Agent','Read','Skill','Bash'),
        cast(1 + event_id % 4 as int)), '","input":{', case event_id % 4
          when 0 then concat('"description":"scan ', event_id, '"', case when event_id % 3 = 0 then ',"model":"small"' else '' end)
          when 1 then concat('"file_path":"/w/', case when event_id % 3 = 0 then 'other' else concat('cb', user_id % 4) end,
            '/contracts/F', event_id % 50, case when event_id % 5 = 0 then '.md' else '.sol' end, '"',
            case when event_id % 8 = 1 then ',"offset":10,"limit":100' else '' end)
          else '"command":"ls"' end, '}}]}}')
      when 'view' then concat('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t', event_id % 7,
        '","is_error":', value > 15, ',"content":', case
          when event_id % 499 = 0 then concat('"', repeat('x', 50010), '"')
          when event_id % 2 = 0 then concat('"agent-', event_id % 4, '-bundle: ', (event_id % 3) * 100, ' lines', repeat('\\\\nrow', cast(event_id % 15 as int)), '"')
          when event_id % 89 = 0 then '"<persisted-output> too large"'
          else concat('[{"type":"text","text":"part ', event_id, '\\\\nnext"},{"type":"image"},{"type":"text","text":"end"}]') end,
        '}]}}')
      when 'purchase' then concat('{"type":"result","stop_reason":"', case when event_id % 5 = 0 then 'max_turns' else 'end_turn' end,
        '","num_turns":', event_id % 30, ',"total_cost_usd":', event_id % 400, '.25}')
      else case when event_id % 9 = 0 then '{"type":' when event_id % 9 = 1 then ''
        else concat('{"type":"rate_limit_event","rate_limit_info":{"status":"', case when event_id % 2 = 0 then 'allowed' else 'rejected' end, '"}}') end
      end"""
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        instant.alias("ts"),
        F.expr(raw).alias("raw"),
    )


def logged_runs(t: Tables) -> DataFrame:
    """One run per user of ``events``."""
    key = F.col("run_id")
    return t.events.select(F.col("user_id").alias("run_id")).distinct().select(
        "run_id",
        (key % 4).alias("codebase_id"),
        F.concat(F.lit("cb"), key % 4).alias("condition_id"),
        F.when(key % 2 == 0, "skill").otherwise("bare").alias("mode"),
        F.when(key % 5 == 0, 143).when(key % 7 == 0, 1).otherwise(0).alias("exit_code"),
        (key % 3 == 0).alias("timed_out"),
        F.when(key % 8 == 0, 12).cast("int").alias("expected_min_agents"),
    )


def output_lines(t: Tables) -> DataFrame:
    """Lines of the run's text; every tenth run has none."""
    key = F.col("run_id")
    return logged_runs(t).filter(key % 10 != 9).select("run_id", (key % 100).cast("int").alias("output_lines"))


def scope_lists(t: Tables) -> DataFrame:
    """Scope entries of four codebases; some paths are listed both in and out of scope."""
    name = ("element_at(array('F1','F2','F12','F31','Vault','Router','TokenSale','Errors','PriceOracle','Bridge','Ledger'), "
            "cast(1 + p_partkey % 11 as int))")
    path = (f"concat(case when p_partkey % 2 = 0 then 'contracts/' else 'lib/contracts/' end, {name}, "
            "case when p_partkey % 13 = 0 then '.md' else '.sol' end)")
    return t.part.select(
        (F.col("p_size") % 4).alias("codebase_id"),
        F.expr(path).alias("path"),
        ((F.col("p_size") + F.col("p_partkey")) % 3 == 0).alias("in_scope"),
    ).distinct()


def report_runs(t: Tables) -> DataFrame:
    """The runs of the report texts, by document."""
    key = F.col("doc_id")
    return t.documents.select(
        key.alias("run_id"),
        (key % 4).alias("codebase_id"),
        F.when(key % 2 == 0, "skill").otherwise("bare").alias("mode"),
        F.concat(F.lit("cond"), key % 3).alias("condition_id"),
    )


def report_truth(t: Tables) -> DataFrame:
    """Ground truth for the report texts, one item per supplier; codebase 3 has none."""
    key = F.col("s_suppkey")

    def pick(words: list[str], index) -> Column:
        return F.element_at(F.array(*[F.lit(word) for word in words]), (index + 1).cast("int"))

    contract = pick(REPORT_CONTRACTS, key % 5)
    items = t.supplier.select(
        (key % 4).alias("codebase_id"),
        key.alias("gt_id"),
        key.alias("gt_pos"),
        contract.alias("contract"),
        F.concat(pick(REPORT_KEYWORDS, key % 14), F.lit(" in "), contract, F.lit("."), pick(REPORT_FUNCTIONS, key % 3)).alias(
            "title"
        ),
        F.when(key % 3 == 0, "high").alias("severity"),
        F.concat(F.lit("reported by "), "s_name").alias("description"),
    )
    return items.filter("codebase_id <> 3").withColumns(
        {
            "vuln_type": classify_keyword(F.col("title")),
            "location": F.lit(None).cast("string"),
            "root_cause": F.lit(None).cast("string"),
        }
    )


def report_findings(t: Tables) -> DataFrame:
    """Findings of the report texts with their codebase and condition."""
    return extract_findings(reports(t)).join(report_runs(t).select("run_id", "codebase_id", "condition_id"), "run_id")
