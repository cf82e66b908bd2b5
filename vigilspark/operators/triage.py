"""Report ingest and triage across cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.tables import TRIAGE_RANK, rank


def content_key(sha256: Column, identity: Column, finding_id: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(filled(sha256), F.concat(F.lit("sha256:"), sha256)).when(filled(identity), F.concat(F.lit("artifact:"), identity)).otherwise(F.concat(F.lit("finding:"), F.coalesce(finding_id, F.lit(""))))


def groups(findings: DataFrame) -> DataFrame:
    """One row per content_key: worst tier (an all-clean group has none), highest score, places, hosts, rules.

    Lists hold distinct values only and are built by map-side aggregation."""
    r = rank("tier", TRIAGE_RANK)
    rule = F.when(F.trim("knowledge_ref") != "", F.col("knowledge_ref"))
    g = findings.groupBy("content_key").agg(
        F.max_by("tier", r).alias("tier"), F.max(r).alias("_r"), F.max("score").alias("score"), F.count_distinct(F.concat_ws("|", "host", "file_path")).alias("locations"),
        F.array_sort(F.collect_set("host")).alias("hosts"), F.array_sort(F.collect_set(rule)).alias("rules"), F.count(F.lit(1)).alias("findings"),
    )
    return g.withColumn("tier", F.when(F.col("_r") > 0, F.col("tier")).otherwise("")).drop("_r")


def worst_first(grouped: DataFrame) -> DataFrame:
    return grouped.orderBy(F.desc(rank("tier", TRIAGE_RANK)), F.desc("score"), F.desc("locations"), "content_key")


def decisions_for(grouped: DataFrame, decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Prior decisions on the groups' contents with the case's name where there is one."""
    hit = decisions.join(grouped.select("content_key"), "content_key", "left_semi")
    return hit.join(cases, "case_id", "left")


def with_decisions(grouped: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups with how often and how their content was decided before; none is an empty list."""
    d = decisions.groupBy("content_key").agg(F.count(F.lit(1)).alias("n"), F.max_by("verdict", F.struct("decided_at", "decision_id")).alias("last_verdict"), F.array_sort(F.collect_set("verdict")).alias("verdicts"))
    return grouped.join(d, "content_key", "left").select(*grouped.columns, F.coalesce("n", F.lit(0)).alias("decisions"), "last_verdict", F.coalesce("verdicts", F.array().cast("array<string>")).alias("verdicts"))


def integrity(reports: DataFrame, manifests: DataFrame) -> DataFrame:
    """run_id, integrity: reports (run_id, sha256) against manifest entries (run_id, listed); a run without a usable entry is
    unverified."""
    joined = reports.join(manifests, "run_id", "left")
    label = F.when(F.coalesce("listed", F.lit("")) == "", "unverified").when(F.lower("listed") == F.lower("sha256"), "verified").otherwise("altered")
    return joined.select("run_id", label.alias("integrity"))


def ingest(existing: DataFrame, incoming: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of runs that aren't there yet; a run delivered twice counts once."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def run_folders(files: DataFrame) -> DataFrame:
    """dir, state from a flat list of files (path): run (a report is there), incomplete (a manifest only), ignored."""
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    part = name == "manifest.json"
    g = files.groupBy(folder.alias("dir")).agg(F.bool_or(name == "report.json").alias("r"), F.bool_or(part).alias("p"), F.count(F.lit(1)).alias("files"))
    return g.select("dir", F.when(F.col("r"), "run").when(F.col("p"), "incomplete").otherwise("ignored").alias("state"), "files")
