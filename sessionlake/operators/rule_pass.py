"""Rules applied to the tables their scope names."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.functions.rules import Rule, RuleError, apply_in_order, counts_map
from sessionlake.operators.extract import TEMPLATE, with_template

# Text columns per table: what users wrote, and what agents answered.
PROMPT_TEXT = {"prompts": ["message"]}
USER_TEXT = {"prompts": ["message", "active_file", "open_tabs", "my_request"]}
# Stored events as JSON: global rules reach the strings inside, see ``json_rules``.
RAW_JSON = {
    "prompts": ["raw_json"],
    "events": ["data", "raw_json"],
    "token_messages": ["raw_json"],
    "turn_context_messages": ["raw_json"],
    "agent_reasoning_messages": ["raw_json"],
    "function_plan_messages": ["raw_json"],
    "function_calls": ["raw_call_json", "raw_output_json"],
    "prelude_parts": ["events_json"],
    "ingest_errors": ["context"],
}
AGENT_TEXT = {
    "agent_reasoning_messages": ["text"],
    "function_plan_messages": ["arguments"],
    "function_calls": ["arguments", "output"],
}


def rules_for(rules: Iterable[Rule], table: str, column: str, fields: dict) -> list[Rule]:
    """Rules that reach a column, in order.

    Prompt rules reach prompts.message, global rules all user and agent text, and
    field rules the columns that ``fields`` gives for their id ("table.column").
    """
    reach_all = column in USER_TEXT.get(table, []) or column in AGENT_TEXT.get(table, [])
    kept = []
    for rule in rules:
        if rule.scope == "prompt":
            reached = column in PROMPT_TEXT.get(table, [])
        elif rule.scope == "global":
            reached = reach_all
        else:
            reached = f"{table}.{column}" in fields.get(rule.id, ())
        if reached:
            kept.append(rule)
    return kept


class Redacted(NamedTuple):
    """A redacted table with a count column for each rule that reaches it."""

    frame: DataFrame
    counts: list[tuple[str, str]]

    def by_rule(self) -> dict[str, Column]:
        sums: dict[str, Column] = {}
        for rule_id, name in self.counts:
            sums[rule_id] = sums[rule_id] + F.col(name) if rule_id in sums else F.col(name)
        return sums

    def with_map(self) -> DataFrame:
        """The counts as one map, ``rule_counts``, of the rules that matched."""
        found = counts_map(self.by_rule())
        return self.frame.withColumn("rule_counts", found).drop(*(n for _, n in self.counts))

    def plain(self) -> DataFrame:
        return self.frame.drop(*(name for _, name in self.counts))

    def matches(self, *keys: str) -> DataFrame | None:
        """(keys, rule_id, n): one row of sums for each key, then unpivoted."""
        if not self.counts:
            return None
        sums = self.by_rule()
        rows = self.frame.groupBy(*keys).agg(
            *(F.sum(count).alias(f"_{n}") for n, count in enumerate(sums.values()))
        )
        pairs = [
            F.struct(F.lit(rule_id).alias("rule_id"), F.col(f"_{n}").alias("n"))
            for n, rule_id in enumerate(sums)
        ]
        return rows.select(*keys, F.inline(F.array(*pairs))).where("n > 0")


def check_fields(rules: Iterable[Rule], fields: dict) -> None:
    """A field rule that names no column would silently do nothing."""
    idle = [r.id for r in rules if r.enabled and r.scope == "field" and not fields.get(r.id)]
    if idle:
        raise RuleError(f"Field rules without a column: {', '.join(idle)}")


def redact_table(
    frame: DataFrame,
    table: str,
    rules: Iterable[Rule],
    fields: dict | None = None,
    prefix: str = "_rule",
) -> Redacted:
    """Table with its text columns redacted, and how often each rule matched."""
    rules, order, fields = list(rules), frame.columns, fields or {}
    counts: list[tuple[str, str]] = []
    for n, column in enumerate(order):
        wanted = rules_for(rules, table, column, fields)
        if wanted:
            frame, found = apply_in_order(frame, column, wanted, column, f"{prefix}{n}")
            counts += found.items()
    return Redacted(frame.select(*order, *(name for _, name in counts)), counts)


def redact_prompts(messages: DataFrame, rules: Iterable[Rule], fields: dict | None = None) -> Redacted:
    """User messages redacted first, then their template parts with field rules.

    The parts come from the redacted message, so no rule has to find its text twice.
    """
    rules, fields = list(rules), fields or {}
    told = redact_table(messages, "prompts", rules, fields)
    parts = {
        rule_id: [c for c in columns if c in {f"prompts.{name}" for name in TEMPLATE}]
        for rule_id, columns in fields.items()
    }
    by_field = [rule for rule in rules if rule.scope == "field"]
    done = redact_table(with_template(told.frame), "prompts", by_field, parts, "_part")
    return Redacted(done.frame, [*told.counts, *done.counts])


def rule_matches(redacted: Iterable[Redacted], *keys: str) -> DataFrame | None:
    """(keys, rule_id, matches) over all redacted tables; None if no rule reaches any."""
    rows = None
    for one in redacted:
        found = one.matches(*keys)
        if found is not None:
            rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        return None
    return rows.groupBy(*keys, "rule_id").agg(F.sum("n").alias("matches"))


def rule_totals(redacted: Iterable[Redacted]) -> DataFrame | None:
    return rule_matches(redacted)
