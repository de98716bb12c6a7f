"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeline.catalog import evaluation, grouping, inputs, live, report_tables, report_text, run_logs
from gaugeline.catalog.oracle_views import with_views
from gaugeline.plans.standins import Tables

REGISTRIES = [inputs.register, evaluation.register, report_tables.register, report_text.register, run_logs.register, grouping.register, live.register]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, folder: query(Tables(spark, folder))

    return {name: bind(query) for registry in REGISTRIES for name, query in registry.queries.items()}


def oracles() -> dict[str, str]:
    """Oracle SQL with its shared views; named subqueries marked by ``named`` follow the views."""
    out = {}
    for registry in REGISTRIES:
        for name, text in registry.oracles.items():
            extra = re.match(r"/\*with\*/(.*)/\*end\*/(.*)", text, re.S)
            if extra is None:
                out[name] = with_views(text.strip())
                continue
            views = with_views(extra[1] + extra[2])
            head = views[: -len(extra[1] + extra[2])].rstrip()
            named = extra[1].strip()
            out[name] = (f"{head},\n{named}" if head else f"with {named}") + "\n" + extra[2].strip()
            if re.search(r"\bfrom reach\b", named):
                out[name] = out[name].replace("with ", "with recursive ", 1)
    out["a14_write_report_tables"] = inputs.report_counts_sql(out)
    return out
