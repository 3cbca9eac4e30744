"""Rules over model output and specifications, as columns: the first broken rule, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of an assessment, from most to least significant.
LABELS = ("SIGNIFICANT", "INCREMENTAL", "UNSUPPORTED", "PROMOTIONAL")
ASSESSMENT = "claimed_change string, problem_addressed string, significance string, reason string, supporting_evidence array<struct<claim_component: string, quote: string>>"
ASSESSMENT_KEYS = ("claimed_change", "problem_addressed", "reason", "significance", "supporting_evidence")


def first_broken(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose condition holds; an unknown condition counts as broken."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def assessment_error(raw_object: Column, text: Column) -> Column:
    """Of a model's assessment of one item, in the order in which errors take precedence."""
    from .text import grounded

    got = F.from_json(raw_object, ASSESSMENT)
    keys = F.array_sort(F.json_object_keys(raw_object))
    quotes = F.transform(got["supporting_evidence"], lambda e: e["quote"])
    return first_broken(
        ("NOT_AN_OBJECT", raw_object.isNull()),
        ("WRONG_KEYS", keys != F.array(*[F.lit(k) for k in ASSESSMENT_KEYS])),
        ("UNKNOWN_LABEL", ~F.upper(F.trim(got["significance"])).isin(*LABELS)),
        ("EMPTY_REASON", F.trim(got["reason"]) == ""),
        ("QUOTE_COUNT", (F.size(quotes) < 1) | (F.size(quotes) > 3)),
        ("REPEATED_QUOTE", F.size(F.array_distinct(quotes)) != F.size(quotes)),
        ("UNGROUNDED_QUOTE", ~F.forall(quotes, lambda x: grounded(x, text))),
    )


def answer_error(citations: Column, supplied: Column, assessed: Column) -> Column:
    """Of a synthesis: citations must be among the supplied ids, and every supplied id assessed exactly once."""
    return first_broken(
        ("NO_CITATION", F.size(citations) == 0),
        ("REPEATED_CITATION", F.size(F.array_distinct(citations)) != F.size(citations)),
        ("UNKNOWN_CITATION", F.size(F.array_except(citations, supplied)) > 0),
        ("NOT_EXACT_COVER", (F.array_sort(assessed) != F.array_sort(supplied))),
    )


def decision_error(scope: Column, support: Column, label: Column) -> Column:
    """Of a blind decision: out of scope means no support and no label; in scope needs both."""
    inside = scope == "IN_SCOPE"
    return first_broken(
        ("SCOPE_MISSING", scope.isNull()),
        ("OUT_OF_SCOPE_WITH_VERDICT", ~inside & (support.isNotNull() | label.isNotNull())),
        ("IN_SCOPE_WITHOUT_SUPPORT", inside & support.isNull()),
        ("IN_SCOPE_WITHOUT_LABEL", inside & label.isNull()),
    )


def call_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    return F.round((tokens_in * rate_in + tokens_out * rate_out) / 1_000_000, 8)


def fitted_calls(units: Column, fraction: float, default: int, ceiling: int) -> Column:
    """Calls whose `fraction` still covers one more than the units, between a default and a ceiling."""
    return F.least(F.greatest(F.ceil((units + 1) / F.lit(fraction)), F.lit(default)), F.lit(ceiling))
