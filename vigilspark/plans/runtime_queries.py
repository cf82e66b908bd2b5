"""Managed-runtime, scan-planning and clone queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.operators import clones, layers, rules, runtime, scan
from vigilspark.plans.projections import table, view, with_views


def class_ladder(spark, d):
    k = F.col("l_partkey")
    c = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", k, (k % 4 == 0).alias("wired"), (k % 3 == 0).alias("trusted"), (k % 5 == 0).alias("generated"), (k % 7 == 0).alias("out_of_contract"), (k % 11 == 0).alias("anomaly"), (k % 2 == 0).alias("mismatch"),
        F.slice(F.array(F.when(k % 13 == 0, "exec").otherwise("crypto"), F.lit("define"), F.lit("reflect")), F.lit(1), (F.col("l_suppkey") % 4).cast("int")).alias("capabilities"),
    )
    return runtime.class_ladder(c).groupBy("l_partkey", "tier", "score").agg(F.count(F.lit(1)).alias("n"))


def repositories(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    classes = p.select((k % 20).alias("pid"), F.concat(F.lit("C"), k.cast("string")).alias("class_name"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("/opt/app"), (k % 6).cast("string"), F.lit("/lib/"), (k % 50).cast("string"), F.lit(".jar"))).alias("code_source"))
    repos = p.select((k % 20).alias("pid"), F.concat(F.lit("/opt/app"), (k % 3).cast("string"), F.when(k % 2 == 0, "/").otherwise("/lib")).alias("prefix"), (k % 20 < 15).alias("application")).distinct()
    return runtime.out_of_contract(classes, repos)


def wired_elements(spark, d):
    p = table(spark, d, "part").withColumn("class_name", F.concat(F.lit("C"), (F.col("p_partkey") % 900).cast("string")))
    e = p.where("p_partkey % 2 = 0").select("class_name", (F.col("p_size") % 5 == 0).alias("trusted"), (F.col("p_size") % 7 == 0).alias("generated"), (F.col("p_size") % 3 == 0).alias("has_source"))
    return runtime.wired_elements(e, p.where("p_partkey % 3 = 0"))


def constant_facts(spark, d):
    words = F.array(*map(F.lit, ["java/lang/Runtime", "x", "X-Accel-Buffering", "javax/crypto/Cipher", "javax/naming/InitialContext", "e45e329feb5d925b", "run /bin/sh now"]))
    pools = table(spark, d, "part").select("p_partkey", F.array(F.get(words, (F.col("p_partkey") % 7).cast("int")), F.get(words, (F.col("p_size") % 7).cast("int")), F.lit("plain")).alias("strings"))
    return runtime.constant_facts(pools).select("p_partkey", "family", "confidence", F.array_join("capabilities", ",").alias("capabilities"))


def chain_positions(spark, d):
    k = F.col("p_partkey")
    n = table(spark, d, "part").select((k % 7).alias("chain"), k.alias("address"), F.when(k % 70 < 56, k + 7).alias("next"))
    return runtime.chain_positions(n)


def late_loads(spark, d):
    e = table(spark, d, "events")
    loads = e.select((F.col("user_id") % 9).alias("pid"), (F.col("event_id") % 60).alias("assembly_id"), F.when(F.col("event_id") % 3 == 0, "").otherwise("/x.dll").alias("il_path"))
    names = e.select((F.col("user_id") % 9).alias("pid"), (F.col("event_id") % 60).alias("assembly_id")).distinct().where("assembly_id % 4 <> 0").withColumn("name", F.concat(F.lit("A"), F.col("assembly_id").cast("string")))
    carved = names.where("assembly_id % 5 = 1").select("pid", "name")
    return runtime.late_loads(loads, names, carved)


def changed_sections(spark, d):
    p = table(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("module"), F.lit(".text").alias("section"), F.sha2("p_name", 256).alias("digest"))
    disk = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("module"), F.lit(".text").alias("section"), F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name")), 256).alias("digest"))
    return runtime.changed_sections(m, disk)


def best_per_sink(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("artifact"), (F.col("l_linenumber") % 5).alias("sink"), (F.col("l_partkey") * 7 % 90).alias("score"), (F.col("l_suppkey") % 10).alias("provenance"), F.col("l_partkey").alias("class"), F.col("l_orderkey").alias("method"), (F.col("l_partkey") % 8 != 0).alias("valid"))
    return runtime.best_per_sink(c).select("artifact", "sink", "score", "provenance", "class", "method")


def loose_classes(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/srv/"), (k % 12).cast("string"), F.when(k % 3 == 0, "/WEB-INF/classes/a/WEB-INF/classes/").when(k % 3 == 1, "/WEB-INF/classes/").otherwise("/"), k.cast("string"), F.lit(".class"))
    c = table(spark, d, "part").select(path.alias("path"), F.col("p_size").cast("long").alias("size"))
    return runtime.retained(c, 600).select("path", "application", "kept")


def view_selection(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("host"), F.when(F.col("c_custkey") % 2 == 0, "linux").otherwise("windows").alias("os"))
    views = ["disk", "java-mem", "dotnet-mem", "native-mem", "behavioral"]
    asked = c.withColumn("view", F.explode(F.array(*map(F.lit, views))))
    can = spark.createDataFrame([("disk", "linux"), ("disk", "windows"), ("java-mem", "linux"), ("java-mem", "windows"), ("dotnet-mem", "windows"), ("native-mem", "windows"), ("behavioral", "windows")], "view string, os string")
    return scan.select_views(asked, can, spark.createDataFrame([("disk",), ("java-mem",), ("behavioral",)], "view string"))


def technique_cells(spark, d):
    found = view(spark, d, "v_scan_finding").select(F.concat(F.lit("r"), (F.col("scan_id") % 9).cast("string")).alias("rule"))
    bridge = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("rule"), F.concat(F.lit("c"), (F.col("n_nationkey") % 4).cast("string"), F.lit(", c"), (F.col("n_nationkey") % 3).cast("string"), F.lit(",")).alias("cells"))
    return scan.cells(found, bridge)


def layer_rescan(spark, d):
    found = rules.rule_set(*(f'rule {name} {{ strings: $a = "{text}" condition: $a }}' for name, text in (("hello", "hello world"), ("run", "Hello"), ("hexed", "ABCDEF"))))
    f = view(spark, d, "v_snippet").select(F.concat(F.lit("/s/"), F.col("doc_id").cast("string"), F.lit(".php")).alias("path"), F.concat(F.lit("eval("), "content").alias("content"))
    return scan.rescan(f, found)


def clone_groups(spark, d):
    f = view(spark, d, "v_file").select("path", F.col("content").alias("text"))
    return clones.groups(clones.fingerprints(f))


def base64_and_rot(spark, d):
    s = view(spark, d, "v_snippet")
    return s.select("doc_id", F.size(layers.base64_runs(F.col("content"))).alias("runs"), F.substr(layers.rot13(F.col("content")), F.lit(1), F.lit(12)).alias("head"))


QUERIES = {
    f.__name__: f
    for f in (class_ladder, repositories, wired_elements, constant_facts, chain_positions, late_loads, changed_sections, best_per_sink, loose_classes, view_selection, technique_cells, layer_rescan, clone_groups, base64_and_rot)
}

_LADDER = """WITH c AS (SELECT l_partkey, l_partkey % 4 = 0 AS w, l_partkey % 3 = 0 AS t, l_partkey % 5 = 0 AS g, l_partkey % 7 = 0 AS o, l_partkey % 11 = 0 AS a, l_partkey % 2 = 0 AS m, least(l_suppkey % 4, 3) AS n, l_suppkey % 4 > 0 AND l_partkey % 13 = 0 AS x FROM lineitem),
  s AS (SELECT l_partkey, CASE WHEN o AND w AND NOT g THEN 90 WHEN o AND x THEN 80 WHEN o AND NOT g THEN 55 WHEN t AND NOT w AND NOT a THEN 0 WHEN g AND NOT w AND NOT a AND n = 0 THEN 0
    WHEN a AND n > 0 AND (NOT m OR x) THEN CASE WHEN w THEN 92 ELSE 80 END WHEN a AND n > 0 THEN 65 WHEN a AND w AND NOT m THEN 92 WHEN a AND w THEN 60 WHEN a THEN 65 WHEN w THEN CASE WHEN n > 0 THEN 95 ELSE 85 END WHEN n >= 2 THEN 80 WHEN n = 1 THEN 55 ELSE 50 END AS score FROM c)
  SELECT l_partkey, CASE WHEN score = 0 THEN 'clean' WHEN score >= 80 THEN 'likely-malicious' ELSE 'suspicious' END AS tier, CAST(score AS INT) AS score, count(*) AS n FROM s GROUP BY ALL"""
_LEXEMES = r"""'"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|[0-9]+(?:\.[0-9]+)?|[A-Za-z_$][0-9A-Za-z_$]*|[^\s0-9A-Za-z_$]'"""
_KEYWORDS = ", ".join(f"'{k}'" for k in clones.KEYWORDS)
_CLONES = rf"""WITH t AS (SELECT path, regexp_extract_all(regexp_replace(content, '(?s)/\*.*?\*/|<!--.*?-->', ' ', 'g'), {_LEXEMES}) AS k FROM v_file),
    s AS (SELECT path, len(k) AS n, sha256(array_to_string([CASE WHEN regexp_matches(x, '^["'']') THEN 'S' WHEN regexp_matches(x, '^[0-9]') THEN 'N' WHEN lower(x) IN ({_KEYWORDS}) THEN lower(x) WHEN regexp_matches(x, '^[A-Za-z_$]') THEN 'I' ELSE x END FOR x IN k], ' ')) AS structure,
      sha256(array_to_string(list_sort(list_distinct([x FOR x IN k IF regexp_matches(x, '^["''0-9]')])), ' ')) AS literal FROM t)
    SELECT structure, min(path) AS first_path, count(*) AS files, count(DISTINCT literal) AS variants FROM s WHERE n > 0 GROUP BY structure HAVING count(*) > 1"""
ORACLES = {
    "class_ladder": _LADDER,
    "repositories": """WITH c AS (SELECT p_partkey % 20 AS pid, 'C' || p_partkey AS class_name, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '/opt/app' || (p_partkey % 6) || '/lib/' || (p_partkey % 50) || '.jar' END AS code_source FROM part),
        r AS (SELECT DISTINCT p_partkey % 20 AS pid, '/opt/app' || (p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/lib' END AS prefix, p_partkey % 20 < 15 AS application FROM part)
        SELECT pid, class_name, code_source, code_source <> '' AND EXISTS (SELECT 1 FROM r WHERE r.pid = c.pid AND application) AND NOT EXISTS (SELECT 1 FROM r WHERE r.pid = c.pid AND starts_with(c.code_source, r.prefix || '/')) AS out_of_contract FROM c""",
    "wired_elements": """WITH l AS (SELECT DISTINCT 'C' || (p_partkey % 900) AS class_name, true AS w FROM part WHERE p_partkey % 2 = 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 3 <> 0), r AS (SELECT DISTINCT 'C' || (p_partkey % 900) AS class_name, true AS f FROM part WHERE p_partkey % 3 = 0)
        SELECT class_name, coalesce(w, false) AS wired, coalesce(f, false) AS found FROM l FULL OUTER JOIN r USING (class_name)""",
    "constant_facts": """WITH i AS (SELECT p_partkey, p_partkey % 7 AS x, p_size % 7 AS y FROM part) SELECT p_partkey, CASE WHEN 5 IN (x, y) THEN 'behinder' WHEN 2 IN (x, y) THEN 'suo5' END AS family, CASE WHEN 5 IN (x, y) THEN 0.9::DOUBLE WHEN 2 IN (x, y) THEN 0.85::DOUBLE END AS confidence,
        concat_ws(',', CASE WHEN 3 IN (x, y) THEN 'crypto' END, CASE WHEN 0 IN (x, y) OR 6 IN (x, y) THEN 'exec' END, CASE WHEN 4 IN (x, y) THEN 'jndi' END, CASE WHEN 2 IN (x, y) THEN 'tunnel' END) AS capabilities FROM i""",
    "chain_positions": """WITH RECURSIVE n AS (SELECT p_partkey % 7 AS chain, p_partkey AS address, CASE WHEN p_partkey % 70 < 56 THEN p_partkey + 7 END AS next FROM part),
        walk AS (SELECT chain, address, 0 AS position FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.chain = a.chain AND b.next = a.address) UNION ALL SELECT w.chain, n.next, w.position + 1 FROM walk w JOIN n ON n.chain = w.chain AND n.address = w.address WHERE EXISTS (SELECT 1 FROM n z WHERE z.chain = n.chain AND z.address = n.next))
        SELECT chain, address, CAST(position AS BIGINT) AS position FROM walk""",
    "late_loads": """WITH l AS (SELECT DISTINCT user_id % 9 AS pid, event_id % 60 AS a FROM events WHERE event_id % 3 = 0), n AS (SELECT DISTINCT pid, CASE WHEN a % 4 = 0 THEN '(unnamed)' ELSE 'A' || a END AS name, a FROM l)
        SELECT DISTINCT pid, name FROM n WHERE name = '(unnamed)' OR a % 5 <> 1""",
    "changed_sections": "SELECT p_partkey AS module, '.text' AS section FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 = 0 AND p_name <> p_brand",
    "best_per_sink": "SELECT l_orderkey % 200 AS artifact, l_linenumber % 5 AS sink, l_partkey * 7 % 90 AS score, l_suppkey % 10 AS provenance, l_partkey AS class, l_orderkey AS method FROM lineitem WHERE l_partkey % 8 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey % 200, l_linenumber % 5 ORDER BY l_partkey * 7 % 90 DESC, l_suppkey % 10, l_partkey, l_orderkey) = 1",
    "loose_classes": """WITH c AS (SELECT '/srv/' || (p_partkey % 12) || CASE p_partkey % 3 WHEN 0 THEN '/WEB-INF/classes/a/WEB-INF/classes/' WHEN 1 THEN '/WEB-INF/classes/' ELSE '/' END || p_partkey || '.class' AS path, p_size AS size,
          CASE p_partkey % 3 WHEN 0 THEN '/srv/' || (p_partkey % 12) || '/WEB-INF/classes/a/' WHEN 1 THEN '/srv/' || (p_partkey % 12) || '/' END AS app FROM part)
        SELECT path, coalesce(app, path) AS application, sum(size) OVER (PARTITION BY coalesce(app, path) ORDER BY path ROWS UNBOUNDED PRECEDING) <= 600 AS kept FROM c""",
    "view_selection": """SELECT 'h' || c_custkey AS host, v AS view, CASE WHEN c_custkey % 2 = 0 AND v IN ('dotnet-mem', 'native-mem', 'behavioral') THEN 'n/a' WHEN v IN ('dotnet-mem', 'native-mem') THEN 'failed' ELSE 'run' END AS status
        FROM customer, (VALUES ('disk'), ('java-mem'), ('dotnet-mem'), ('native-mem'), ('behavioral')) t(v)""",
    "clone_groups": with_views(("v_file",), _CLONES),
    "technique_cells": with_views(("v_scan_finding",), "WITH b AS (SELECT 'r' || n_nationkey AS rule, 'c' || (n_nationkey % 4) AS cell FROM nation UNION SELECT 'r' || n_nationkey, 'c' || (n_nationkey % 3) FROM nation) SELECT cell, count(*) AS detections FROM v_scan_finding f JOIN b ON b.rule = 'r' || (f.scan_id % 9) GROUP BY 1"),
    "base64_and_rot": with_views(("v_snippet",), "SELECT doc_id, CAST(len([r FOR r IN regexp_extract_all(content, '[A-Za-z0-9+/]{24,}={0,2}') IF length(r) % 4 = 0 AND regexp_full_match(r, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)')]) AS INT) AS runs, substr(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm'), 1, 12) AS head FROM v_snippet"),
}
