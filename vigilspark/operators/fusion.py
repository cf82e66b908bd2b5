"""Evidence fusion: labels, fingerprints, dedup, corroboration, scores and host verdicts.

Input rows are findings: host, view, basis, knowledge_ref, evidence, family, tier, score, allowlisted, path, pid, identity and
ord, the position that settles ties. Everything is partitioned by host, so hosts are assessed together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import tables as t
from vigilspark.functions.classify import at_least, tier_of_score
from vigilspark.functions.tables import rank


def family_label(family: Column, evidence: Column) -> Column:
    """The family, or the one whose constant the evidence holds; the first in the table wins."""
    label = F.nullif(family, F.lit(""))
    for constant, name in t.FAMILY_CONSTANTS:
        label = F.coalesce(label, F.when(F.contains(F.lower(evidence), F.lit(constant)), F.lit(name)))
    return label


def mitre_tags(view: Column, knowledge_ref: Column, evidence: Column, iis_config_ref: str = "kb:behavioral/iis-config-change") -> Column:
    wired = F.exists(F.array(*map(F.lit, t.IIS_CONTRACTS)), lambda c: F.contains(evidence, c))
    ids = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(view == "disk", ids("T1505.003"))
        .when(view == "java-mem", ids("T1505.003", "T1620"))
        .when((view == "dotnet-mem") & wired, ids("T1505.003", "T1505.004", "T1620"))
        .when(view == "dotnet-mem", ids("T1505.003", "T1620"))
        .when((view == "behavioral") & (knowledge_ref == iis_config_ref), ids("T1505.003", "T1505.004"))
        .when(view == "behavioral", ids("T1505.003"))
    )


def target_key(path: Column, pid: Column, identity: Column) -> Column:
    who = F.coalesce(identity, F.lit(""))
    return F.when(path.isNotNull(), F.concat(F.lit("file:"), path)).when(pid.isNotNull(), F.concat(F.lit("proc:"), pid.cast("string"), F.lit(":"), who)).otherwise(who)


def fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits over the parts joined by pipes; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def normalise(findings: DataFrame) -> DataFrame:
    """Adds correlation_id, target_key, mitre and fingerprint, and fills family."""
    c = F.col
    out = findings.withColumn("correlation_id", F.concat(F.lit("incident-"), F.coalesce(F.nullif(c("host"), F.lit("")), F.lit("unknown"))))
    out = out.withColumn("family", F.coalesce(family_label(c("family"), c("evidence")), c("family")))
    out = out.withColumn("mitre", mitre_tags(c("view"), c("knowledge_ref"), c("evidence"))).withColumn("target_key", target_key(c("path"), c("pid"), c("identity")))
    return out.withColumn("fingerprint", fingerprint(*(c(x) for x in ("host", "view", "target_key", "basis", "knowledge_ref", "evidence", "family"))))


def dedup_fingerprint(findings: DataFrame) -> DataFrame:
    """One row per fingerprint: the highest score, the earliest of equals, at the first one's place.

    The maximum is combined in each task before the shuffle (by sorting the task's rows, as a struct is no mutable buffer), so
    a fingerprint that fills a table is no hot key."""
    others = [x for x in findings.columns if x not in ("fingerprint", "ord")]
    best = F.max_by(F.struct(*others), F.struct("score", -F.col("ord")))
    return findings.groupBy("fingerprint").agg(best.alias("b"), F.min("ord").alias("ord")).select("fingerprint", "ord", "b.*")


def attributed(family: Column) -> Column:
    return F.coalesce(family.isin(*t.ATTRIBUTED_FAMILIES), F.lit(False))


def credible(allowlisted: Column, family: Column, basis: Column) -> Column:
    return ~allowlisted & (attributed(family) | basis.isin(*t.CREDIBLE_BASES))


def corroborate(findings: DataFrame) -> DataFrame:
    """Adds corroborated: another row of the host is credible and either from another view, or of an attributed family on
    the same target. Counted on two aggregates (views of a host, targets of a host and view) and joined back: where these are
    small they are broadcast, and where not the adaptive planner splits the rows of a host that has most of them."""
    f = findings.withColumn("_cred", credible(F.col("allowlisted"), F.col("family"), F.col("basis"))).withColumn("_attr", attributed(F.col("family")) & ~F.col("allowlisted"))
    views = f.where("_cred").groupBy("host").agg(F.collect_set("view").alias("_views"))
    peers = f.where("_attr").groupBy("host", "view", "target_key").agg(F.count(F.lit(1)).alias("_peers"))
    f = f.join(views, "host", "left").join(peers, ["host", "view", "target_key"], "left")
    across = F.coalesce(F.size(F.array_except("_views", F.array("view"))) > 0, F.lit(False))
    within = F.coalesce("_peers", F.lit(0)) - F.col("_attr").cast("int") > 0
    return f.withColumn("corroborated", across | within).drop("_cred", "_attr", "_views", "_peers")


def score(findings: DataFrame) -> DataFrame:
    """Replaces tier and score by the fused ones."""
    tier, n, corr, basis = F.col("tier"), F.col("score"), F.col("corroborated"), F.col("basis")
    given = F.coalesce(tier, F.lit(""))
    pair = lambda a, b: F.struct(F.lit(a).alias("tier") if isinstance(a, str) else a.alias("tier"), (F.lit(b) if isinstance(b, int) else b).cast("int").alias("score"))
    content = (
        F.when(given == "confirmed", pair("confirmed", n))
        .when(corr & (given == "likely-malicious"), pair("confirmed", at_least(n, 90)))
        .when(n > 0, pair(F.when(given == "", tier_of_score(n)).otherwise(given), n))
        .when(given != "", pair(given, n))
        .otherwise(pair("likely-malicious", 70))
    )
    memory = (
        F.when(given == "confirmed", pair("confirmed", at_least(n, 85)))
        .when((given == "likely-malicious") & corr, pair("confirmed", at_least(n, 95)))
        .when(given == "likely-malicious", pair("likely-malicious", at_least(n, 80)))
        .when(corr, pair("likely-malicious", 75))
        .otherwise(pair("suspicious", 50))
    )
    named = F.when(corr, pair("confirmed", at_least(n, 95))).when(given == "confirmed", pair("confirmed", n)).otherwise(pair("likely-malicious", at_least(n, 80)))
    fused = (
        F.when(attributed(F.col("family")), named)
        .when(basis.isin(*t.CONTENT_BASES), content)
        .when(basis.isin(*t.MEMORY_BASES), memory)
        .when(basis == "behavioral", F.when(corr, pair("likely-malicious", 75)).otherwise(pair("suspicious", 50)))
        .when(basis == "behavioral-context", pair("clean", 10))
        .otherwise(pair("suspicious", 45))
    )
    return findings.withColumn("_f", fused).withColumn("tier", F.col("_f.tier")).withColumn("score", F.col("_f.score")).drop("_f")


def assess(findings: DataFrame) -> DataFrame:
    """The whole of fusion up to scored, deduplicated findings."""
    return score(corroborate(dedup_fingerprint(normalise(findings))))


def host_verdicts(scored: DataFrame, coverage: DataFrame) -> DataFrame:
    """host, tier, score, incomplete, exit_code: the worst tier and highest score; a failed or truncated view makes the scan
    incomplete, and an incomplete clean scan is unknown. Hosts without findings are clean."""
    worst = scored.groupBy("host").agg(F.max_by("tier", rank("tier", t.VERDICT_RANK)).alias("w"), F.max(rank("tier", t.VERDICT_RANK)).alias("r"), F.max("score").alias("s"))
    gaps = coverage.groupBy("host").agg(F.bool_or((F.col("status") == "failed") | F.col("truncated")).alias("gap"))
    both = gaps.join(worst, "host", "full_outer")
    tier = F.when(F.coalesce("r", F.lit(0)) > 0, F.col("w")).otherwise("clean")
    gap = F.coalesce("gap", F.lit(False))
    out = both.select("host", F.when(gap & (tier == "clean"), "unknown").otherwise(tier).alias("tier"), F.greatest(F.coalesce("s", F.lit(0)), F.lit(0)).alias("score"), gap.alias("incomplete"))
    return out.withColumn("exit_code", exit_code(F.col("tier"), F.col("incomplete")))


def exit_code(tier: Column, incomplete: Column) -> Column:
    """0 clean, 2 suspicious, 3 likely-malicious, 4 confirmed, 5 incomplete with nothing found."""
    return F.when(tier == "confirmed", 4).when(tier == "likely-malicious", 3).when(tier == "suspicious", 2).when(incomplete, 5).otherwise(0)


def dedup_by_rule(findings: DataFrame) -> DataFrame:
    """One row per path and knowledge_ref: the highest score; of equals the first by source and position."""
    w = Window.partitionBy("path", "knowledge_ref").orderBy(F.desc("score"), "source_ord", "ord")
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
