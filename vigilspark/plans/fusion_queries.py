"""Fusion queries: labels, fingerprints, dedup, corroboration, scores, verdicts and their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.classify import tier_of_score
from vigilspark.functions.tables import rank, VERDICT_RANK, TRIAGE_RANK
from vigilspark.operators import fusion, outputs
from vigilspark.plans.projections import view, with_views

_LABEL = """CASE WHEN family IS NOT NULL AND family <> '' THEN family WHEN contains(lower(evidence), 'e45e329feb5d925b') THEN 'Behinder'
  WHEN contains(lower(evidence), '3c6e0b8a9c15224a') THEN 'Godzilla' ELSE family END"""
_MITRE = """CASE WHEN view = 'disk' THEN 'T1505.003' WHEN view = 'java-mem' THEN 'T1505.003,T1620' WHEN view = 'dotnet-mem' AND contains(evidence, 'IHttpModule') THEN 'T1505.003,T1505.004,T1620'
  WHEN view = 'dotnet-mem' THEN 'T1505.003,T1620' WHEN view = 'behavioral' AND knowledge_ref = 'kb:behavioral/iis-config-change' THEN 'T1505.003,T1505.004' WHEN view = 'behavioral' THEN 'T1505.003' END"""
_ATTR = "coalesce(family IN ('Behinder', 'Godzilla', 'AntSword', 'ChinaChopper', 'IceScorpion'), false)"
_NORM = f"""norm0 AS (SELECT ord, host, view, basis, knowledge_ref, evidence, {_LABEL} AS family, tier, score, allowlisted, path, pid, identity, {_MITRE} AS mitre,
    CASE WHEN path IS NOT NULL THEN 'file:' || path WHEN pid IS NOT NULL THEN 'proc:' || pid || ':' || identity ELSE identity END AS target_key, 'incident-' || host AS correlation_id FROM v_finding),
  norm AS (SELECT *, substr(sha256(concat_ws('|', host, view, target_key, basis, knowledge_ref, evidence, coalesce(family, ''))), 1, 16) AS fingerprint FROM norm0)"""
_DEDUP = """dedup AS (SELECT * EXCLUDE (ord, first_ord), first_ord AS ord FROM (SELECT *, min(ord) OVER (PARTITION BY fingerprint) AS first_ord FROM norm
    QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, ord) = 1))"""
_CORR = f"""marked AS (SELECT *, {_ATTR} AS attr, NOT allowlisted AND ({_ATTR} OR basis IN ('signature', 'structural-heuristic', 'behavioral', 'provenance-anomaly', 'memory-region-anomaly', 'etw-dynamic-load', 'reachability-dispatch')) AS cred FROM dedup),
  corr AS (SELECT a.*, EXISTS (SELECT 1 FROM marked g WHERE g.host = a.host AND g.fingerprint <> a.fingerprint AND g.cred AND (g.view <> a.view OR (g.attr AND g.target_key = a.target_key))) AS corroborated FROM marked a)"""
_SCORE = """scored AS (SELECT * EXCLUDE (tier, score), CASE
      WHEN attr THEN CASE WHEN corroborated OR tier = 'confirmed' THEN 'confirmed' ELSE 'likely-malicious' END
      WHEN basis IN ('signature', 'heuristic', 'taint') THEN CASE WHEN tier = 'confirmed' THEN 'confirmed' WHEN corroborated AND tier = 'likely-malicious' THEN 'confirmed'
        WHEN score > 0 AND tier = '' THEN CASE WHEN score >= 85 THEN 'confirmed' WHEN score >= 60 THEN 'likely-malicious' WHEN score >= 40 THEN 'suspicious' ELSE 'clean' END WHEN tier <> '' THEN tier ELSE 'likely-malicious' END
      WHEN basis IN ('structural-heuristic', 'provenance-anomaly', 'memory-region-anomaly', 'etw-dynamic-load', 'reachability-dispatch', 'stomp-diff') THEN
        CASE WHEN tier = 'confirmed' THEN 'confirmed' WHEN tier = 'likely-malicious' THEN CASE WHEN corroborated THEN 'confirmed' ELSE 'likely-malicious' END WHEN corroborated THEN 'likely-malicious' ELSE 'suspicious' END
      WHEN basis = 'behavioral' THEN CASE WHEN corroborated THEN 'likely-malicious' ELSE 'suspicious' END WHEN basis = 'behavioral-context' THEN 'clean' ELSE 'suspicious' END AS tier,
    CAST(CASE
      WHEN attr THEN CASE WHEN corroborated THEN greatest(score, 95) WHEN tier = 'confirmed' THEN score ELSE greatest(score, 80) END
      WHEN basis IN ('signature', 'heuristic', 'taint') THEN CASE WHEN tier = 'confirmed' THEN score WHEN corroborated AND tier = 'likely-malicious' THEN greatest(score, 90) WHEN score > 0 OR tier <> '' THEN score ELSE 70 END
      WHEN basis IN ('structural-heuristic', 'provenance-anomaly', 'memory-region-anomaly', 'etw-dynamic-load', 'reachability-dispatch', 'stomp-diff') THEN
        CASE WHEN tier = 'confirmed' THEN greatest(score, 85) WHEN tier = 'likely-malicious' THEN CASE WHEN corroborated THEN greatest(score, 95) ELSE greatest(score, 80) END WHEN corroborated THEN 75 ELSE 50 END
      WHEN basis = 'behavioral' THEN CASE WHEN corroborated THEN 75 ELSE 50 END WHEN basis = 'behavioral-context' THEN 10 ELSE 45 END AS INT) AS score FROM corr)"""
_RANK = "CASE tier WHEN 'confirmed' THEN 3 WHEN 'likely-malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END"
_VERDICT = f"""worst AS (SELECT host, max({_RANK}) AS r, max(score) AS s FROM scored GROUP BY host),
  gaps AS (SELECT host, bool_or(status = 'failed' OR truncated) AS gap FROM v_coverage GROUP BY host),
  verdict AS (SELECT host, CASE coalesce(r, 0) WHEN 3 THEN 'confirmed' WHEN 2 THEN 'likely-malicious' WHEN 1 THEN 'suspicious' ELSE CASE WHEN coalesce(gap, false) THEN 'unknown' ELSE 'clean' END END AS tier,
    greatest(coalesce(s, 0), 0) AS score, coalesce(gap, false) AS incomplete FROM gaps FULL OUTER JOIN worst USING (host))"""
_EXIT = "CAST(CASE tier WHEN 'confirmed' THEN 4 WHEN 'likely-malicious' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'unknown' THEN 5 ELSE CASE WHEN incomplete THEN 5 ELSE 0 END END AS INT)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return fusion.assess(view(spark, d, "v_finding"))


def score_to_tier(spark, d):
    f = view(spark, d, "v_finding")
    return f.groupBy(tier_of_score(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def tier_ranks(spark, d):
    f = view(spark, d, "v_finding").select("tier").distinct()
    return f.select("tier", rank("tier", VERDICT_RANK).alias("verdict_rank"), rank("tier", TRIAGE_RANK).alias("triage_rank"), rank("tier", TRIAGE_RANK, -1).alias("display_rank"))


def mitre_tags(spark, d):
    f = fusion.normalise(view(spark, d, "v_finding"))
    return f.select("ord", F.array_join("mitre", ",").alias("mitre"))


def family_label(spark, d):
    return fusion.normalise(view(spark, d, "v_finding")).select("ord", "family", fusion.attributed(F.col("family")).alias("attributed"))


def finding_fingerprint(spark, d):
    return fusion.normalise(view(spark, d, "v_finding")).select("ord", "correlation_id", "target_key", "fingerprint")


def dedup_fingerprint(spark, d):
    return fusion.dedup_fingerprint(fusion.normalise(view(spark, d, "v_finding"))).select("fingerprint", "ord", "score", "tier", "host")


def credible_signals(spark, d):
    f = fusion.dedup_fingerprint(fusion.normalise(view(spark, d, "v_finding")))
    return f.select("fingerprint", fusion.credible(F.col("allowlisted"), F.col("family"), F.col("basis")).alias("credible"))


def corroboration(spark, d):
    return fusion.corroborate(fusion.dedup_fingerprint(fusion.normalise(view(spark, d, "v_finding")))).select("fingerprint", "corroborated")


def fusion_score(spark, d):
    return _scored(spark, d).select("fingerprint", "host", "view", "basis", "tier", "score")


def host_verdict(spark, d):
    return fusion.host_verdicts(_scored(spark, d), view(spark, d, "v_coverage"))


def exit_codes(spark, d):
    return host_verdict(spark, d).groupBy("exit_code").agg(F.count(F.lit(1)).alias("hosts"))


def dedup_origin_rule(spark, d):
    f = view(spark, d, "v_finding").where("path is not null").withColumn("source_ord", F.col("ord") % 6)
    return fusion.dedup_by_rule(f).select("path", "knowledge_ref", "score", "source_ord", "ord")


def ocsf_projection(spark, d):
    rows = outputs.ocsf(_scored(spark, d), host_verdict(spark, d))
    return rows.select("fingerprint", "type_uid", "severity_id", "confidence_id", "status_id", "title", F.array_join("observables", ";").alias("observables"), F.array_join("tactics", ",").alias("tactics"), "incomplete")


def summary_lines(spark, d):
    return outputs.summary(_scored(spark, d))


def coverage_lines(spark, d):
    return outputs.coverage_lines(view(spark, d, "v_coverage"))


def skip_totals(spark, d):
    """Absent counters stay absent: a view without skip accounting isn't one with zero skips."""
    c = view(spark, d, "v_coverage")
    return c.groupBy("view").agg(F.sum("unreadable").alias("unreadable"), F.sum("not_regular").alias("not_regular"), F.sum("targets").alias("targets"), F.count_if("truncated").alias("truncated"))


QUERIES = {
    f.__name__: f
    for f in (score_to_tier, tier_ranks, mitre_tags, family_label, finding_fingerprint, dedup_fingerprint, credible_signals, corroboration, fusion_score, host_verdict, exit_codes, dedup_origin_rule, ocsf_projection, summary_lines, coverage_lines, skip_totals)
}

_F, _FC = ("v_finding",), ("v_finding", "v_coverage")
_ALL = f"WITH {_NORM}, {_DEDUP}, {_CORR}, {_SCORE}"
ORACLES = {
    "score_to_tier": with_views(_F, "SELECT CASE WHEN score >= 85 THEN 'confirmed' WHEN score >= 60 THEN 'likely-malicious' WHEN score >= 40 THEN 'suspicious' ELSE 'clean' END AS tier, count(*) AS n, min(score) AS low, max(score) AS high FROM v_finding GROUP BY 1"),
    "tier_ranks": with_views(_F, f"SELECT DISTINCT tier, CAST({_RANK} AS INT) AS verdict_rank, CAST(CASE tier WHEN 'unknown' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'likely-malicious' THEN 3 WHEN 'confirmed' THEN 4 ELSE 0 END AS INT) AS triage_rank, CAST(CASE tier WHEN 'clean' THEN 0 WHEN 'unknown' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'likely-malicious' THEN 3 WHEN 'confirmed' THEN 4 ELSE -1 END AS INT) AS display_rank FROM v_finding"),
    "mitre_tags": with_views(_F, f"SELECT ord, {_MITRE} AS mitre FROM v_finding"),
    "family_label": with_views(_F, f"SELECT ord, family, {_ATTR} AS attributed FROM (SELECT ord, {_LABEL} AS family FROM v_finding)"),
    "finding_fingerprint": with_views(_F, f"WITH {_NORM} SELECT ord, correlation_id, target_key, fingerprint FROM norm"),
    "dedup_fingerprint": with_views(_F, f"WITH {_NORM}, {_DEDUP} SELECT fingerprint, ord, score, tier, host FROM dedup"),
    "credible_signals": with_views(_F, f"WITH {_NORM}, {_DEDUP}, {_CORR} SELECT fingerprint, cred AS credible FROM marked"),
    "corroboration": with_views(_F, f"WITH {_NORM}, {_DEDUP}, {_CORR} SELECT fingerprint, corroborated FROM corr"),
    "fusion_score": with_views(_F, f"{_ALL} SELECT fingerprint, host, view, basis, tier, score FROM scored"),
    "host_verdict": with_views(_FC, f"{_ALL}, {_VERDICT} SELECT host, tier, score, incomplete, {_EXIT} AS exit_code FROM verdict"),
    "exit_codes": with_views(_FC, f"{_ALL}, {_VERDICT} SELECT {_EXIT} AS exit_code, count(*) AS hosts FROM verdict GROUP BY 1"),
    "dedup_origin_rule": with_views(_F, "SELECT path, knowledge_ref, score, ord % 6 AS source_ord, ord FROM v_finding WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path, knowledge_ref ORDER BY score DESC, ord % 6, ord) = 1"),
    "ocsf_projection": with_views(_FC, f"""{_ALL}, {_VERDICT} SELECT s.fingerprint, 200401 AS type_uid, CAST(CASE s.tier WHEN 'confirmed' THEN 5 WHEN 'likely-malicious' THEN 4 WHEN 'suspicious' THEN 3 ELSE 1 END AS INT) AS severity_id,
        CAST(CASE s.tier WHEN 'confirmed' THEN 3 WHEN 'likely-malicious' THEN 3 WHEN 'suspicious' THEN 2 ELSE 1 END AS INT) AS confidence_id, 1 AS status_id, s.view || ': ' || s.identity AS title,
        concat_ws(';', 'device.hostname=' || s.host, 'file.name=' || s.path, 'process.pid=' || CASE WHEN s.path IS NULL THEN s.pid END) AS observables,
        CASE WHEN s.mitre IS NULL THEN NULL ELSE regexp_replace(regexp_replace(s.mitre, 'T1505[.]00[34]', 'TA0003', 'g'), 'T1620', 'TA0005', 'g') END AS tactics, v.incomplete FROM scored s JOIN verdict v USING (host)"""),
    "summary_lines": with_views(_F, f"""{_ALL} SELECT fingerprint, concat_ws(chr(10), '  [' || tier || '] ' || view || ' score=' || score || ' — ' || coalesce(path, identity, '(unidentified target)'),
        '      ' || concat_ws('  ', 'rule=' || knowledge_ref, 'basis=' || basis, CASE WHEN family <> '' THEN 'family=' || family END, CASE WHEN mitre IS NOT NULL THEN '[' || mitre || ']' END), CASE WHEN evidence <> '' THEN '      ' || evidence END) AS line FROM scored"""),
    "coverage_lines": with_views(("v_coverage",), "SELECT host, view, view || ': ' || status || ', ' || targets || ' targets' || CASE WHEN unreadable IS NOT NULL OR not_regular IS NOT NULL THEN ', skipped ' || (coalesce(unreadable, 0) + coalesce(not_regular, 0)) ELSE '' END || CASE WHEN truncated THEN ', stopped early' ELSE '' END AS line FROM v_coverage"),
    "skip_totals": with_views(("v_coverage",), "SELECT view, CAST(sum(unreadable) AS BIGINT) AS unreadable, CAST(sum(not_regular) AS BIGINT) AS not_regular, CAST(sum(targets) AS BIGINT) AS targets, count(*) FILTER (truncated) AS truncated FROM v_coverage GROUP BY view"),
}
