"""Column functions for report text: trimming, keywords, locations, slugs and root-cause keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions import report_patterns as p


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(p.SPACE))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A regex group, null when the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    found = text.rlike(patterns[0])
    for pattern in patterns[1:]:
        found = found | text.rlike(pattern)
    return found


def taken_until(lines: Column, stop: str) -> Column:
    """The leading lines before the first one that matches ``stop``."""
    position = F.array_position(F.transform(lines, lambda line: line.rlike(stop)), True)
    return F.when(position > 0, F.slice(lines, F.lit(1), (position - 1).cast("int"))).otherwise(lines)


def classify_keyword(title: Column) -> Column:
    """The first keyword class whose pattern occurs in the title."""
    label = F.lit("other")
    for name, pattern in reversed(p.KEYWORD_RULES):
        label = F.when(title.rlike(pattern), F.lit(name)).otherwise(label)
    return label


def long_words(text: Column) -> Column:
    """Lower-case words of more than two characters, punctuation removed, repeats kept."""
    plain = F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9\s]", "")
    return F.filter(F.split(plain, r"\s+"), lambda word: F.length(word) > 2)


def title_slug(title: Column) -> Column:
    """The first four long words, joined by hyphens."""
    plain = F.lower(F.regexp_replace(title, r"[^a-zA-Z0-9\s]", ""))
    words = F.filter(F.split(plain, r"\s+"), lambda word: F.length(word) > 2)
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 4), "-"), F.lit("")), F.lit("unknown"))


def title_location(title: Column, explicit: Column) -> Column:
    """Contract.function from the title, else from the file and a called function, else one of them."""
    dotted = F.when(
        title.rlike(p.DOTTED_NAME),
        F.concat_ws(".", F.regexp_extract(title, p.DOTTED_NAME, 1), F.regexp_extract(title, p.DOTTED_NAME, 2)),
    )
    contract = group(explicit, p.SOURCE_FILE)
    function = group(title, p.CALLED_FUNCTION)
    return F.coalesce(
        dotted,
        F.when(contract.isNotNull() & function.isNotNull(), F.concat_ws(".", contract, function)),
        contract,
        function,
        group(title, p.NAMED_FUNCTION),
    )


def root_cause_key(location: Column, keyword: Column, slug: Column) -> Column:
    """contract::function::keyword, or less when the location says less; keyword and slug are those of the title."""
    parts = F.split(F.lower(location), r"\.")
    contract, function = F.get(parts, F.lit(0)), F.nullif(F.get(parts, F.lit(1)), F.lit(""))
    return (
        F.when(location.isNull(), F.concat(F.lit("unknown::"), slug))
        .when(function.isNotNull(), F.concat_ws("::", contract, function, keyword))
        .when(keyword != "other", F.concat_ws("::", contract, keyword))
        .otherwise(F.concat_ws("::", contract, slug))
    )
