"""Outputs: event projection for SIEMs, text lines, manifests, build ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class, category, activity and status numbers of a detection finding.
CLASS_UID, CATEGORY_UID, ACTIVITY_ID, STATUS_NEW = 2004, 2, 1, 1
OCSF_VERSION, ATTACK_VERSION = "1.8.0", "14"


def severity(tier: Column) -> Column:
    return F.when(tier == "confirmed", 5).when(tier == "likely-malicious", 4).when(tier == "suspicious", 3).otherwise(1)


def confidence(tier: Column) -> Column:
    return F.when(tier.isin("confirmed", "likely-malicious"), 3).when(tier == "suspicious", 2).otherwise(1)


def tactic(technique: Column) -> Column:
    return F.when(technique == "T1620", "TA0005").otherwise("TA0003")


def ocsf(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One detection finding per scored finding, as columns; `event` is the JSON record."""
    pair = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), value))
    c = F.col
    pid = F.when(c("path").isNull(), c("pid").cast("string"))
    out = scored.join(verdicts.select("host", "incomplete"), "host")
    out = out.select(
        "fingerprint",
        F.lit(CLASS_UID * 100 + ACTIVITY_ID).alias("type_uid"),
        severity(c("tier")).alias("severity_id"),
        confidence(c("tier")).alias("confidence_id"),
        F.lit(STATUS_NEW).alias("status_id"),
        F.concat("view", F.lit(": "), "identity").alias("title"),
        F.array_compact(F.array(pair("device.hostname", c("host")), pair("file.name", c("path")), pair("process.pid", pid))).alias("observables"),
        F.transform("mitre", tactic).alias("tactics"),
        "mitre",
        c("evidence").alias("message"),
        F.struct("tier", "view", "score", "correlation_id", "basis", "knowledge_ref", "family", "incomplete").alias("unmapped"),
        "incomplete",
    )
    return out


def ocsf_json(events: DataFrame, product: str = "vigilspark", time_millis: Column | None = None) -> DataFrame:
    """The records as one JSON text each (NDJSON when written as text)."""
    time = time_millis if time_millis is not None else F.lit(0).cast("long")
    attacks = F.transform("mitre", lambda t: F.struct(F.struct(t.alias("uid")).alias("technique"), F.struct(tactic(t).alias("uid")).alias("tactic"), F.lit(ATTACK_VERSION).alias("version")))
    record = F.struct(
        F.lit(ACTIVITY_ID).alias("activity_id"), F.lit(CATEGORY_UID).alias("category_uid"), F.lit(CLASS_UID).alias("class_uid"), "type_uid", time.alias("time"), "severity_id", "confidence_id", "status_id",
        "message", F.struct(F.lit(OCSF_VERSION).alias("version"), F.struct(F.lit(product).alias("name")).alias("product")).alias("metadata"),
        F.struct(F.col("fingerprint").alias("uid"), "title").alias("finding_info"), "observables", attacks.alias("attacks"), "unmapped",
    )
    return events.select("fingerprint", F.to_json(record).alias("event"))


def summary(scored: DataFrame) -> DataFrame:
    """fingerprint, line: a finding's lines in the text summary."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    who = F.coalesce(F.nullif("path", F.lit("")), F.nullif("identity", F.lit("")), F.lit("(unidentified target)"))
    head = F.concat(F.lit("  ["), "tier", F.lit("] "), "view", F.lit(" score="), F.col("score").cast("string"), F.lit(" — "), who)
    family = F.when(filled("family"), F.concat(F.lit("family="), "family"))
    mitre = F.when(F.size("mitre") > 0, F.concat(F.lit("["), F.array_join("mitre", ","), F.lit("]")))
    detail = F.concat(F.lit("      "), F.concat_ws("  ", F.concat(F.lit("rule="), "knowledge_ref"), F.concat(F.lit("basis="), "basis"), family, mitre))
    return scored.select("fingerprint", F.concat_ws("\n", head, detail, F.when(filled("evidence"), F.concat(F.lit("      "), "evidence"))).alias("line"))


def coverage_lines(coverage: DataFrame) -> DataFrame:
    counted = F.col("unreadable").isNotNull() | F.col("not_regular").isNotNull()
    skipped = (F.coalesce("unreadable", F.lit(0)) + F.coalesce("not_regular", F.lit(0))).cast("string")
    line = F.concat("view", F.lit(": "), "status", F.lit(", "), F.col("targets").cast("string"), F.lit(" targets"), F.when(counted, F.concat(F.lit(", skipped "), skipped)).otherwise(""), F.when(F.col("truncated"), ", stopped early").otherwise(""))
    return coverage.select("host", "view", line.alias("line"))


def manifest(files: DataFrame) -> DataFrame:
    """name, sha256 of files (name, content), for a table that readers sort by name."""
    return files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """name, state: ok, altered, missing (listed only), unlisted (found only)."""
    both = listed.select("name", F.col("sha256").alias("want")).join(found.select("name", F.col("sha256").alias("have")), "name", "full_outer")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.col("have"), "ok").otherwise("altered")
    return both.select("name", state.alias("state"))


def build_id(*parts: Column) -> Column:
    """A name derived from its parts, each ended by a NUL: b- and 12 hex digits."""
    ended = F.concat(*(F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\x00")) for p in parts))
    return F.concat(F.lit("b-"), F.substring(F.sha2(ended, 256), 1, 12))
