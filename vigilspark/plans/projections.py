"""Deterministic projections of the star schema into this engine's relations.

Each is one SQL text in the part of SQL that Spark and DuckDB share; {table} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def pick(expr: str, values: list[str | None]) -> str:
    """CASE over the remainder of expr by the number of values."""
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {arms} END)"


_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_TIER = "CASE WHEN {0} >= 85 THEN 'confirmed' WHEN {0} >= 60 THEN 'likely-malicious' WHEN {0} >= 40 THEN 'suspicious' ELSE 'clean' END"
_BASES = ["signature", "heuristic", "taint", "structural-heuristic", "provenance-anomaly", "memory-region-anomaly", "etw-dynamic-load", "reachability-dispatch", "stomp-diff", "behavioral", "behavioral-context"]
_FAMILIES = [None, "Behinder", "GenericEval", None, "Godzilla", "", "GenericJSP", None, "AntSword", None, "ReverseShell", None, None, "ChinaChopper", None, "SSIExec", None, None, None]
_SUFFIXES = [".php", ".php.bak", ".class.php", ".config.json", ".txt", "", ".jsp", ".aspx", ".asp", ".pl", ".py", ".cgi", ".shtml", ".html", ".JSPX", ".phar", ".war", ".config", ".jpg.phtml", "/.htaccess", ".asp.txt", ".INC", ".tar.gz", ".master"]
_VIEWS = "CASE event_type WHEN 'error' THEN 'disk' WHEN 'click' THEN 'java-mem' WHEN 'view' THEN 'dotnet-mem' WHEN 'purchase' THEN 'native-mem' ELSE 'behavioral' END"

PROJECTIONS: dict[str, str] = {
    "v_finding": f"""
        SELECT event_id AS ord, concat('host-', CAST(user_id % 40 AS STRING)) AS host, {_VIEWS} AS view,
          {pick("event_id", _BASES)} AS basis,
          CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'kb:behavioral/iis-config-change' ELSE concat('kb:rule/', CAST(event_id % 6 AS STRING)) END AS knowledge_ref,
          concat('rule ', CAST(event_id % 3 AS STRING), CASE WHEN event_id % 29 = 0 THEN ' key E45E329FEB5D925B' WHEN event_id % 31 = 0 THEN ' key 3c6e0b8a9c15224a' WHEN event_id % 5 = 0 THEN ' IHttpModule' ELSE '' END) AS evidence,
          {pick("event_id", _FAMILIES)} AS family,
          CASE WHEN event_id % 13 = 0 THEN '' ELSE {_TIER.format("(event_id * 7 % 101)")} END AS tier,
          CAST(event_id * 7 % 101 AS INT) AS score, event_id % 17 = 0 AS allowlisted,
          CASE WHEN event_type IN ('error', 'signup') THEN concat('/srv/', CAST({_K} % 5 AS STRING), '.php') END AS path,
          CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(event_id % 4 AS INT) END AS pid,
          concat('id-', CAST({_K} % 3 AS STRING)) AS identity
        FROM {{events}}""",
    "v_coverage": f"""
        SELECT host, view, status, status = 'degraded' AND n % 31 = 0 AS truncated,
          CASE WHEN view = 'disk' THEN n % 5 END AS unreadable, CASE WHEN view = 'disk' THEN n % 3 END AS not_regular, n % 11 AS targets
        FROM (SELECT concat('host-', CAST(h AS STRING)) AS host, v.view AS view, h * 5 + v.no AS n, {pick("h * 5 + v.no", ["ran", "ran", "n/a", "ran", "degraded", "ran", "ran", "n/a", "ran"])} AS status0,
            CASE WHEN (h * 5 + v.no) % 23 = 0 THEN 'failed' ELSE {pick("h * 5 + v.no", ["ran", "ran", "n/a", "ran", "degraded", "ran", "ran", "n/a", "ran"])} END AS status
          FROM (SELECT DISTINCT user_id % 40 AS h FROM {{events}}) hosts
          CROSS JOIN (SELECT 0 AS no, 'disk' AS view UNION ALL SELECT 1, 'java-mem' UNION ALL SELECT 2, 'dotnet-mem' UNION ALL SELECT 3, 'native-mem' UNION ALL SELECT 4, 'behavioral') v) x""",
    "v_file": f"""
        SELECT concat('/srv/d', CAST(doc_id AS STRING), {pick("doc_id", _SUFFIXES)}) AS path,
          concat({pick("doc_id * 5", ["", "<?php $a = 1; ", "<%@ page import=\"java.util.List\" %>", "#!/usr/bin/perl\nuse strict;\n", "import os\n", "<!--#include file=\"a.html\" -->", "<script runat = \"server\">", "<? x ", "Server.CreateObject(\"a\") ", "\n#!/usr/bin/python3\n", "my $x = 1;"])}, text) AS content
        FROM {{documents}}
        UNION ALL
        SELECT concat('/www/p', CAST(page_id AS STRING), {pick("page_id", _SUFFIXES)}), html FROM {{pages}}""",
    "v_rule": f"""
        SELECT p_partkey AS rule_id, concat('rule_', CAST(p_partkey AS STRING)) AS identifier,
          CASE WHEN p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#13') THEN 'foundation' WHEN p_partkey % 3 = 0 THEN 'own' ELSE 'community' END AS layer,
          CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS source_pack,
          CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_size END AS score, p_name AS description, p_partkey % 23 = 0 AS deleted
        FROM {{part}}""",
    "v_revision": """
        SELECT l_partkey AS rule_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS INT) AS revision,
          concat('rule text ', CAST(l_orderkey % 97 AS STRING)) AS body, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(l_orderkey % 100 AS INT) END AS meta_score,
          l_orderkey % 8 <> 0 AS has_description, l_orderkey % 50 <> 0 AS has_meta
        FROM {lineitem}""",
    "v_set": "SELECT s_suppkey AS set_id, s_name AS name, s_suppkey % 3 = 0 AS takes_own, s_suppkey % 5 = 0 AS takes_foundation, s_suppkey % 7 AS named FROM {supplier}",
    "v_named": "SELECT DISTINCT s.s_suppkey AS set_id, l.l_partkey AS rule_id FROM {supplier} s JOIN {lineitem} l ON l.l_suppkey = s.s_suppkey WHERE l.l_linenumber = 1",
    "v_exclusion": "SELECT l_suppkey AS set_id, l_partkey AS rule_id, min(concat('reason ', CAST(l_orderkey % 5 AS STRING))) AS reason FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_partkey",
    "v_scan": """
        SELECT o_orderkey AS scan_id, concat('run-', CAST(o_orderkey AS STRING)) AS run_id, o_custkey AS case_id, concat('host-', CAST(o_custkey % 50 AS STRING)) AS host,
          o_orderdate AS started, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'unverified' ELSE 'altered' END AS integrity FROM {orders}""",
    "v_scan_finding": f"""
        SELECT l_orderkey AS scan_id, l_linenumber AS ref, CASE WHEN l_partkey % 4 = 0 THEN concat('sha256:', CAST(l_partkey % 300 AS STRING)) WHEN l_partkey % 4 = 1 THEN concat('artifact:', CAST(l_suppkey AS STRING)) ELSE concat('finding:', CAST(l_partkey % 500 AS STRING)) END AS content_key,
          concat('host-', CAST(l_suppkey % 50 AS STRING)) AS host, concat('/srv/', CAST(l_partkey % 40 AS STRING)) AS file_path,
          CASE WHEN l_linenumber = 3 THEN '' ELSE concat('kb:', CAST(l_partkey % 12 AS STRING)) END AS knowledge_ref,
          {_TIER.format("(l_partkey * 3 % 101)")} AS tier, CAST(l_partkey * 3 % 101 AS INT) AS score
        FROM {{lineitem}}""",
    "v_decision": """
        SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 4 < 2 THEN concat('sha256:', CAST(o_custkey % 300 AS STRING)) ELSE concat('finding:', CAST(o_custkey % 500 AS STRING)) END AS content_key,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS case_id, CASE o_orderstatus WHEN 'F' THEN 'malicious' WHEN 'O' THEN 'benign' ELSE 'unsure' END AS verdict, o_orderdate AS decided_at FROM {orders}""",
    "v_event": f"""
        SELECT event_id AS ord, concat('host-', CAST(user_id % 40 AS STRING)) AS host, CAST((CASE event_type WHEN 'error' THEN 1316 WHEN 'click' THEN 4688 WHEN 'view' THEN 1 WHEN 'purchase' THEN 29 ELSE 50 END) AS INT) AS event_id,
          CASE event_type WHEN 'error' THEN 'Application' WHEN 'click' THEN 'Security' WHEN 'view' THEN 'Microsoft-Windows-Sysmon/Operational' ELSE CASE WHEN event_id % 3 = 0 THEN 'System' ELSE 'Microsoft-IIS-Configuration/Operational' END END AS channel,
          CASE WHEN event_id % 4 = 0 THEN 'Other' ELSE 'ASP.NET 4.0' END AS provider, ts AS time,
          CASE WHEN event_id % 5 = 0 THEN 'ViewState invalid' ELSE 'plain' END AS detail,
          CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN 'C:\\Windows\\explorer.exe' ELSE 'C:\\inetsrv\\W3WP.exe' END END AS parent,
          CASE WHEN event_type IN ('click', 'view') THEN concat('C:\\tools\\', {pick(_K, ["cmd.exe", "csc.exe", "Powershell.EXE", "odd.exe", "conhost.exe", "", "whoami.exe", "app.exe", "werfault.exe"])}) END AS child
        FROM {{events}}""",
    "v_region": """
        SELECT l_orderkey AS pid, l_linenumber AS region_no, l_partkey * 65536 AS base, (l_suppkey % 16 + 1) * 4096 AS size,
          CAST(CASE l_linenumber % 4 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 64 ELSE 128 END AS INT) AS protect, l_orderkey % 3 = 0 AS backed,
          l_partkey % 11 = 0 AS has_pe, l_orderkey % 4 = 0 AS managed, l_partkey % 13 = 0 AS stomped, l_partkey % 7 = 0 AS patched
        FROM {lineitem}""",
    "v_thread": "SELECT event_id AS thread_id, user_id * 17 % 1500 * 4 + event_id % 4 AS pid, (event_id * 37 % 2000) * 65536 + event_id % 9 * 4096 AS start_address FROM {events}",
    "v_class": f"""
        SELECT l_orderkey AS pid, l_linenumber AS class_no, {pick("l_partkey", ["spoofed", "disk-absent", "unverifiable", "corroborated", "disk-absent", "corroborated"])} AS status,
          {pick("l_suppkey", ["javax.servlet.Filter", "java.lang.Object", "org.apache.catalina.Valve", "com.example.Thing", "java.util.List"])} AS contract,
          {pick("l_partkey * 3 + l_linenumber", ["", "exec", "file", "exec,file", "tunnel", "file,net", ""])} AS caps, l_orderkey % 5 = 0 AS out_of_contract, l_orderkey % 7 = 0 AS generated, l_partkey % 9 = 0 AS contradiction
        FROM {{lineitem}}""",
    "v_root": f"""
        SELECT CAST(o_custkey % 30 AS STRING) AS host, concat('/var/www', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('/', CAST(o_orderkey % 4 AS STRING)) END, CASE WHEN o_orderkey % 5 = 0 THEN '/app' ELSE '' END) AS path,
          {pick("o_orderkey", ["apache-config", "nginx-dump", "iis-config", "tomcat-process", "convention"])} AS mechanism,
          {pick("o_orderkey", ["config", "config", "config", "explicit", "convention"])} AS provenance FROM {{orders}}""",
    "v_snippet": f"""
        SELECT doc_id, concat({pick("doc_id", ["Uryyb jbeyq ", "%41%42 &#65; ", "plain ", "\\\\x41\\\\x42\\\\x43\\\\x44\\\\x45\\\\x46 ", "aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ= ", "chr(72).chr(101).chr(108).chr(108).chr(111) "])}, text) AS content FROM {{documents}}""",
}


def sql_for(name: str, engine: str) -> str:
    """The projection's text for "spark" (tables as {table}) or "duckdb"."""
    text = PROJECTIONS[name]
    if engine == "duckdb":
        # string literals hold backslashes as they stand in DuckDB; Spark reads escapes
        text = text.replace("\\\\", "\\")
        return re.sub(r"\{(\w+)\}", r"\1", text)
    return text.replace("\\", "\\\\") if name == "v_event" else text


def with_views(names: list[str] | tuple[str, ...], query: str) -> str:
    """A DuckDB query over projections."""
    head = ",\n".join(f"{n} AS ({sql_for(n, 'duckdb')})" for n in names)
    body = query.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = sql_for(name, "spark")
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
