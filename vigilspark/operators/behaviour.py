"""Event-log detectors and what the telemetry could have shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.classify import windows_basename
from vigilspark.functions.tables import EXPECTED_CHILDREN, SHELL_CHILDREN

NEWEST_PER_CHANNEL = 2000
IIS_CHANNEL = "Microsoft-IIS-Configuration/Operational"


def _finding(rows: DataFrame, basis: str, ref: Column, identity: Column, evidence: Column) -> DataFrame:
    return rows.select("host", "ord", F.lit("behavioral").alias("view"), F.lit(basis).alias("basis"), ref.alias("knowledge_ref"), identity.alias("identity"), evidence.alias("evidence"))


def view_state(events: DataFrame) -> DataFrame:
    """Failed view-state validation, as context. events: host, ord, event_id, channel, provider, values."""
    hit = (F.col("event_id") == 1316) & F.lower("provider").startswith("asp.net") & F.exists("values", lambda v: F.contains(F.lower(v), F.lit("viewstate")))
    return _finding(events.where(hit), "behavioral-context", F.lit("kb:behavioral/viewstate-mac-failure"), F.lit("asp.net:viewstate-mac-failure"), F.lit("view-state validation failed"))


def iis_config(events: DataFrame) -> DataFrame:
    hit = (F.col("channel") == IIS_CHANNEL) & F.col("event_id").isin(29, 50)
    evidence = F.concat(F.lit("server configuration changed, event "), F.col("event_id").cast("string"))
    return _finding(events.where(hit), "behavioral-context", F.lit("kb:behavioral/iis-config-change"), F.lit("iis:config-change"), evidence)


def with_process(events: DataFrame) -> DataFrame:
    """parent and child image of process creations, from either source; data: map of named values."""
    security = (F.col("channel") == "Security") & (F.col("event_id") == 4688)
    sysmon = F.contains("channel", F.lit("Sysmon")) & (F.col("event_id") == 1)
    named = lambda a, b: F.when(security, F.col("data")[a]).when(sysmon, F.col("data")[b])
    return events.withColumn("parent_image", named("ParentProcessName", "ParentImage")).withColumn("child_image", named("NewProcessName", "Image"))


def worker_children(events: DataFrame) -> DataFrame:
    """Children of the web server's worker process: shells and unexpected ones; expected and unnamed ones are no finding."""
    p = with_process(events).withColumn("c", windows_basename(F.col("child_image")))
    p = p.where(F.lower("parent_image").endswith("\\w3wp.exe") & (F.coalesce("c", F.lit("")) != "") & ~F.col("c").isin(*EXPECTED_CHILDREN))
    shell = F.col("c").isin(*SHELL_CHILDREN)
    ref = F.when(shell, "kb:behavioral/w3wp-child-process").otherwise("kb:behavioral/w3wp-anomalous-child")
    return _finding(p, "behavioral", ref, F.concat(F.lit("proc:w3wp->"), "c"), F.concat(F.lit("worker process started "), "c", F.when(shell, " (shell)").otherwise(" (unexpected)")))


def detect(events: DataFrame) -> DataFrame:
    return view_state(events).unionByName(iis_config(events)).unionByName(worker_children(events))


def telemetry(events: DataFrame) -> DataFrame:
    """host, has_4688, has_parent, has_sysmon, status: degraded where no process creation with its parent could be seen."""
    s4688 = (F.col("channel") == "Security") & (F.col("event_id") == 4688)
    sysmon = (F.col("event_id") == 1) & F.contains("channel", F.lit("Sysmon"))
    parent = s4688 & (F.coalesce(F.col("data")["ParentProcessName"], F.lit("")) != "")
    g = events.groupBy("host").agg(F.bool_or(s4688).alias("has_4688"), F.bool_or(parent).alias("has_parent"), F.bool_or(sysmon).alias("has_sysmon"))
    return g.withColumn("status", F.when(F.col("has_sysmon") | F.col("has_parent"), "ran").otherwise("degraded"))


def newest_per_channel(events: DataFrame, most: int = NEWEST_PER_CHANNEL) -> DataFrame:
    """The newest events of each host and channel. Spark keeps at most `most` rows of a group per task before the shuffle
    (rank limit pushed below the exchange), so a loud channel doesn't travel."""
    w = Window.partitionBy("host", "channel").orderBy(F.desc("time"), F.desc("ord"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
