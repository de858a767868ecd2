"""Ingest of session files into the stored tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake.functions.json_rules import redact_json
from sessionlake.functions.rules import Rule
from sessionlake.operators import (
    calls,
    chunks,
    events,
    extract,
    lake,
    redactions,
    rule_pass,
    sessions,
    summary,
    tables,
)
from sessionlake.schemas import EXTRA_TABLES, TABLES
from sessionlake.session import remove_folder, stage, staging_folder
from sessionlake.sources import discovery, jsonl
from sessionlake.sources.paths import escape_path


class IngestFailed(ValueError):
    """A file could not be ingested and bad files are not tolerated."""


@dataclass
class Ingested:
    """Frames of one ingest, ready to be written or queried."""

    tables: dict[str, DataFrame]
    summary: DataFrame
    failed_files: DataFrame
    first_failure: str | None
    rule_totals: DataFrame | None = None


def failed_files(grouped: DataFrame) -> DataFrame:
    """Files that cannot be stored as a whole, with their first reason."""
    nested = sessions.session_details(grouped).where("nested").select(
        "file_path",
        F.lit(None).cast("bigint").alias("line_number"),
        F.lit("nested value in a session field").alias("reason"),
    )
    line = F.coalesce("line_number", F.lit(0))
    return (
        events.file_errors(grouped)
        .unionByName(nested)
        .groupBy("file_path")
        .agg(F.min_by(F.struct("line_number", "reason"), line).alias("f"))
        .select("file_path", "f.line_number", "f.reason")
    )


def build(
    lines: DataFrame,
    files: DataFrame,
    on_bad_file: str = "fail",
    rules: Iterable[Rule] = (),
    fields: dict[str, list[str]] | None = None,
    manual: DataFrame | None = None,
    folder: str | None = None,
) -> Ingested:
    """All tables of the given lines.

    Parsed lines are written until they are numbered; every table reads the numbered
    ones from ``folder`` with its own columns. Bad files are left out of all tables:
    with 'quarantine' only those, with 'fail' also all files after the first one.
    Rules come first, message before template, then the ``manual`` redactions.
    ``fields`` gives the columns ("table.column") of each field rule.
    """
    rules = list(rules)
    rule_pass.check_fields(rules, fields or {})
    if on_bad_file not in ("fail", "quarantine"):
        raise ValueError(f"on_bad_file must be 'fail' or 'quarantine', not {on_bad_file!r}")
    spark = lines.sparkSession
    before = staging_folder(spark)
    parsed = stage(events.parse_lines(lines), "parsed", before)
    numbered = stage(events.number_and_group(parsed), "grouped", folder)
    remove_folder(spark, before)
    failed = stage(failed_files(numbered), "failed", folder)
    worst = discovery.first_files(failed, 1).first()
    grouped, kept = numbered, files
    if worst is not None:
        dropped = failed.select("file_path")
        if on_bad_file == "fail":
            start = discovery.discovery_order(F.lit(worst.file_path))
            dropped = files.where(discovery.discovery_order() >= start)
        grouped = chunks.without_files(numbered, dropped)
        kept = files.join(dropped.select("file_path"), "file_path", "left_anti")
    errors = events.ingest_errors(grouped)
    parts = sessions.prelude_parts(grouped)
    built = {
        "files": kept.select("file_path", F.current_timestamp().alias("ingested_at")),
        "sessions": sessions.sessions(grouped, kept, parts, sessions.CELL_PARTS),
        "prompts": extract.prompts(grouped),
        "token_messages": extract.token_messages(grouped),
        "turn_context_messages": extract.turn_context_messages(grouped),
        "agent_reasoning_messages": extract.agent_reasoning_messages(grouped),
        "function_plan_messages": extract.function_plan_messages(grouped),
        "function_calls": calls.function_calls(grouped),
        "events": extract.base_events(grouped),
        "prelude_parts": parts,
        "ingest_errors": errors,
    }
    counted = summary.with_error_lists(
        summary.summaries(grouped, calls.match_calls(grouped), kept, errors),
        errors,
        summary.CELL_ERRORS,
    )
    redacted: list[rule_pass.Redacted] = []
    if rules:
        told = rule_pass.redact_prompts(extract.messages(grouped), rules, fields)
        redacted.append(told)
        built["prompts"] = told.plain()
        named = {c.split(".")[0] for columns in (fields or {}).values() for c in columns}
        for name in (set(rule_pass.AGENT_TEXT) | named) & set(built) - {"prompts"}:
            done = rule_pass.redact_table(built[name], name, rules, fields)
            redacted.append(done)
            built[name] = done.plain()
        everywhere = [rule for rule in rules if rule.enabled and rule.scope == "global"]
        for name, columns in rule_pass.RAW_JSON.items() if everywhere else ():
            built[name] = built[name].withColumns(
                {c: redact_json(F.col(c), everywhere) for c in columns}
            )
        if everywhere:
            built["sessions"] = sessions.sessions(
                grouped, kept, built["prelude_parts"], sessions.CELL_PARTS
            )
    if manual is not None:
        text = rule_pass.USER_TEXT["prompts"]
        built["prompts"] = redactions.apply_manual(built["prompts"], manual, text)
    found = rule_pass.rule_matches(redacted, "file_path")
    if found is not None:
        found = stage(found, "rule_matches", folder)
    counted = _with_rule_counts(counted, found)
    failure = worst.reason if worst is not None and on_bad_file == "fail" else None
    totals = None
    if found is not None:
        totals = found.groupBy("rule_id").agg(F.sum("matches").alias("matches"))
    return Ingested(built, counted, failed, failure, totals)


def _with_rule_counts(counted: DataFrame, found: DataFrame | None) -> DataFrame:
    """Summary rows with ``rule_counts``, the matches of each rule in the file."""
    none = F.create_map().cast("map<string,bigint>")
    if found is None:
        return counted.withColumn("rule_counts", none)
    maps = found.groupBy("file_path").agg(
        F.map_from_entries(F.collect_list(F.struct("rule_id", "matches"))).alias("rule_counts")
    )
    joined = counted.join(maps, "file_path", "left")
    return joined.withColumn("rule_counts", F.coalesce("rule_counts", none))


def ingest_directory(
    spark: SparkSession,
    root: str,
    base: str,
    limit: int | None = None,
    on_bad_file: str = "fail",
    rules: Iterable[Rule] = (),
    fields: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Ingest the session files below ``root`` into the tables at ``base``.

    Gives the summary per file: counts, error list and matches of each rule. Files
    ingested before are replaced. The manual redactions stored at ``base`` hold for
    the new rows. With 'fail' the files before the first bad one are stored, then
    IngestFailed is raised.
    """
    files = discovery.session_files(spark, root)
    if limit is not None:
        files = discovery.first_files(files, limit)
    if files.isEmpty():
        raise discovery.NoSessionsFound(f"No session files found under {root}")
    lines = jsonl.read_lines(spark, root, limit)
    return run(spark, lines, files, base, on_bad_file, rules, fields)


def ingest_file(
    spark: SparkSession,
    path: str,
    base: str,
    rules: Iterable[Rule] = (),
    fields: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Ingest one explicitly named file; an empty one has a session all the same."""
    named = spark.read.format("binaryFile").load(escape_path(path)).inputFiles()
    files = spark.createDataFrame([(uri,) for uri in named], "uri string").select(
        discovery.readable_path(F.col("uri")).alias("file_path")
    )
    return run(spark, jsonl.read_file(spark, path), files, base, "fail", rules, fields)


def run(
    spark: SparkSession,
    lines: DataFrame,
    files: DataFrame,
    base: str,
    on_bad_file: str,
    rules: Iterable[Rule] = (),
    fields: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Build and store the tables of some lines; staged tables go when they are read."""
    folder = staging_folder(spark)
    manual = tables.read_table(spark, base, "redactions")
    if manual.isEmpty():
        manual = None
    try:
        built = build(lines, files, on_bad_file, rules, fields, manual, folder)
        return store(spark, built, base)
    finally:
        remove_folder(spark, folder)


def store(spark: SparkSession, result: Ingested, base: str) -> DataFrame:
    """Write the tables of an ingest and give its summary."""
    counted = stage(result.summary, "summary")
    store_tables(spark, result.tables, base)
    if result.first_failure is not None:
        raise IngestFailed(result.first_failure)
    return counted


def store_tables(spark: SparkSession, built: dict[str, DataFrame], base: str) -> lake.Record:
    """Add the rows of the ingested files to the stored tables, all at once.

    Rows go to a new version. Days that hold a file stored before are written anew,
    without its old rows; all other days stay as they are. One commit then makes the
    version valid in all tables. Files keep their ids.
    """
    folder = staging_folder(spark)
    before = lake.newest(spark, base)
    live, version = before.live, lake.new_version(before)
    try:
        files = stage(built["files"].select("file_path"), "new_files", folder)
        stored = tables.read_table(spark, base, "files", record=before)
        known = stored.join(files, "file_path", "left_semi").select(lake.day_of()).distinct()
        days = [row.day for row in known.collect()]  # as many as the calendar has
        ids = tables.assign_ids(stored, files)
        for name in [*TABLES, *EXTRA_TABLES]:
            if name not in built:
                continue
            rows = built[name].join(ids, "file_path") if name == "files" else built[name]
            rows = tables.conform(rows, name)
            if days:
                old = tables.read_table(spark, base, name, days, before)
                rows = tables.replace_files(old, rows, files)
            written = lake.write_rows(rows, base, name, version)
            live = lake.with_version(live, name, version, written, days)
        return lake.commit(spark, base, before, live)
    finally:
        remove_folder(spark, folder)
