"""Classification, rule, behavioural and memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.functions import classify
from vigilspark.functions.tables import EXPECTED_CHILDREN, EXTENSIONS, PIPELINE_CONTRACTS, SCOPE_CONTEXTS, SCOPE_SIGNS, SHELL_CHILDREN, WEB_SOURCE
from vigilspark.operators import behaviour, memory, rules
from vigilspark.plans.projections import table, view, with_views

#: A pack over the projected files; harmless patterns that exercise the algebra.
PACK = r"""
private rule has_import { strings: $a = "import" $b = /use\s+strict/ condition: any of them }
rule script_marker { meta: lang = "asp-family" score = 75 family = "GenericASPX" strings: $a = "<SCRIPT" nocase $b = "runat" condition: all of them }
rule many_the { meta: score = 45 strings: $a = /\bthe\b/ $b = "The" condition: #a >= 12 and $b }
rule short_file { meta: score = "n/a" strings: $a = "e" condition: filesize < 900 and $a }
rule two_of_three { meta: score = 60 family = "Mixed" strings: $a1 = "qui" $a2 = "der" $a3 = "para" $z = "zzzz" condition: 2 of ($a*) and not $z }
rule php_start { meta: lang = "php" score = 88 strings: $a = "<?" $b = { 3C 3F 70 ?? 70 } condition: $a at 0 and uint16(0) == 0x3F3C and ($b or filesize > 0) }
rule early_word { meta: lang = "web-generic" score = 30 strings: $a = "die" fullword nocase condition: $a in (0..400) }
rule builds_on { meta: lang = "python" score = 85 family = "ReverseShell" strings: $a = "os" condition: has_import and $a }
"""
RULES = rules.rule_set(PACK)


def _files(spark, d):
    return view(spark, d, "v_file").select("path", F.col("content").alias("text"))


def classify_path(spark, d):
    f = view(spark, d, "v_file")
    return f.select("path", classify.language(F.col("path")).alias("lang"), classify.canonical_extension(F.col("path")).alias("ext"))


def file_context_counts(spark, d):
    f = view(spark, d, "v_file")
    return f.groupBy(classify.language(F.col("path")).alias("context")).agg(F.count(F.lit(1)).alias("files"))


def language_signs(spark, d):
    f = rules.with_context(_files(spark, d))
    return f.select("path", F.array_join("signs", ",").alias("signs"))


def binary_gate(spark, d):
    t = table(spark, d, "documents")
    text = F.concat(F.substr("text", F.lit(1), (F.col("doc_id") % 12000).cast("int")), F.when(F.col("doc_id") % 3 == 0, F.lit("\x00")).otherwise(""), F.substr("text", F.lit(1), F.lit(300)))
    return t.select("doc_id", classify.looks_binary(text).alias("is_binary"))


def rule_admission(spark, d):
    scopes = ["", *sorted(SCOPE_CONTEXTS), "cobol"]
    f = rules.with_context(_files(spark, d)).withColumn("scope", F.explode(F.array(*map(F.lit, scopes))))
    return f.groupBy("scope", rules.admission(F.col("scope"), F.col("context"), F.col("signs")).alias("admission")).agg(F.count(F.lit(1)).alias("files"))


def skip_accounting(spark, d):
    return rules.skipped_unread(_files(spark, d))


def signature_matches(spark, d):
    m = rules.matches(_files(spark, d), RULES)
    return m.select("path", "rule", F.array_join("strings", ",").alias("strings"))


def signature_findings(spark, d):
    f = rules.findings(rules.matches(_files(spark, d), RULES), RULES)
    return f.groupBy("rule", "tier", "score", "family").agg(F.count(F.lit(1)).alias("files"))


def rule_validate(spark, d):
    return rules.validate(_files(spark, d), RULES)


def pack_from_table(spark, d):
    """A rule of rule text for each benchmark passage, gathered as a set and run over all documents."""
    items = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.split(F.col("text"), " "), 1, 5), " ").alias("words"))
    quoted = F.regexp_replace(F.regexp_replace("words", "\n", r"\\\\n"), '"', r'\\\\"')
    body = F.concat(F.lit("rule passage_"), F.col("item_id").cast("string"), F.lit(' { strings: $a = "'), quoted, F.lit('" $b = "'), quoted, F.lit('" nocase condition: any of them }'))
    found = rules.rule_set_of(items.select(body.alias("body")))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return rules.matches(docs, found).select("path", "rule", F.array_join("strings", ",").alias("strings"))


def thousand_rules(spark, d):
    """A pack of a rule for each part, in one plan: hits over all documents, by rule."""
    parts = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    body = F.concat(F.lit("rule part_"), F.col("p_partkey").cast("string"), F.lit(' { strings: $a = "'), F.get("w", 0), F.lit('" nocase $b = "'), F.get("w", 1), F.lit('" fullword $n = "'), F.col("p_partkey").cast("string"), F.lit('" fullword condition: $a or $b and filesize < 2KB or #n > 1 }'))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return rules.hit_counts_of(docs, parts.select(body.alias("body")))


def compile_check(spark, d):
    """Rule rows each by itself: sound ones, ones that refer to a rule that is or isn't there, and broken ones."""
    k = F.col("p_partkey").cast("string")
    n = F.col("p_partkey") % 5
    head = F.concat(F.lit("rule r"), k, F.lit(" { "))
    body = F.when(n == 0, F.concat(head, F.lit('strings: $a = "x" condition: $a }'))).when(n == 1, F.concat(head, F.lit("condition: r"), (F.col("p_partkey") - 1).cast("string"), F.lit(" }")))
    body = body.when(n == 2, F.concat(head, F.lit("condition: nobody }"))).when(n == 3, F.concat(head, F.lit('strings: $a = "x" condition: $b }'))).otherwise(F.concat(head, F.lit("condition: ")))
    return rules.compile_status(table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), body.alias("body"))).select("rule_id", "identifier", "status")


def pattern_summary(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    return g.select("l_suppkey", classify.bounded_list(F.col("ids"), 6).alias("summary"))


def file_drop_paths(spark, d):
    """Which roots hold which paths, by segments."""
    f = view(spark, d, "v_file").select("path")
    roots = F.array(*map(F.lit, ["/srv", "/srv/d1", "/www/", "/ww", "/srv/d10.txt"]))
    return f.select("path", F.array_join(F.filter(roots, lambda r: classify.within(F.col("path"), r)), ",").alias("roots"))


def _events(spark, d):
    e = view(spark, d, "v_event")
    names = {"Security": ("ParentProcessName", "NewProcessName"), "Sysmon": ("ParentImage", "Image")}
    entry = lambda p, c: F.map_from_arrays(F.array(F.lit(p), F.lit(c)), F.array("parent", "child"))
    data = F.when(F.col("channel") == "Security", entry(*names["Security"])).when(F.contains("channel", F.lit("Sysmon")), entry(*names["Sysmon"]))
    return e.withColumn("data", data).withColumn("values", F.array("detail"))


def behaviour_viewstate(spark, d):
    return behaviour.view_state(_events(spark, d)).select("ord", "host", "basis", "identity")


def behaviour_iis(spark, d):
    return behaviour.iis_config(_events(spark, d)).select("ord", "host", "evidence")


def behaviour_w3wp_child(spark, d):
    return behaviour.worker_children(_events(spark, d)).select("ord", "host", "knowledge_ref", "identity")


def telemetry_coverage(spark, d):
    return behaviour.telemetry(_events(spark, d))


def events_top_per_channel(spark, d):
    return behaviour.newest_per_channel(view(spark, d, "v_event"), 20).select("ord", "host", "channel")


def _regions(spark, d):
    return memory.mark_thread_starts(view(spark, d, "v_region"), view(spark, d, "v_thread"))


def thread_range_join(spark, d):
    j = memory.interval_join(view(spark, d, "v_region"), view(spark, d, "v_thread"), ["pid"], "base", "size", "start_address")
    return j.select("pid", "region_no", "thread_id")


def region_overlap(spark, d):
    r = view(spark, d, "v_region")
    a = r.select("pid", F.col("region_no").alias("l"), F.col("base").alias("l_start"), (F.col("base") + F.col("size") * 40).alias("l_end"))
    b = r.select("pid", F.col("region_no").alias("r"), F.col("base").alias("r_start"), (F.col("base") + F.col("size") * 40).alias("r_end"))
    return memory.overlap_join(a, b, ["pid"]).where("l < r").select("pid", "l", "r")


def region_ladder(spark, d):
    return memory.region_ladder(_regions(spark, d)).select("pid", "region_no", "tier", "score", F.array_join("signals", ",").alias("signals"), memory.protection_name(F.col("protect")).alias("protection"))


def max_run_length(spark, d):
    b = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("k"), (F.col("l_partkey") % 1500).alias("rva"))
    return memory.byte_runs(b, ["k"])


def stomp_classify(spark, d):
    r = max_run_length(spark, d).withColumn("total", F.col("k") * 400)
    return r.select("k", memory.stomp_class(F.col("modified"), F.col("total"), F.col("max_run")).alias("class"))


def jvm_ladder(spark, d):
    c = view(spark, d, "v_class").withColumn("contracts", F.array("contract")).withColumn("capabilities", F.filter(F.split("caps", ","), lambda x: x != ""))
    return memory.jvm_ladder(c).select("pid", "class_no", "tier", "score", "knowledge_ref")


def claim_verify(spark, d):
    p = table(spark, d, "part")
    claims = p.select(F.concat(F.lit("com.acme.C"), (F.col("p_partkey") % 700).cast("string")).alias("class_name"), F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("/lib/"), (F.col("p_partkey") % 40).cast("string"), F.lit(".jar"))).alias("code_source"), (F.col("p_partkey") % 17 == 0).alias("nested")).distinct()
    entries = p.select(F.concat(F.lit("/lib/"), (F.col("p_partkey") % 40).cast("string"), F.lit(".jar")).alias("archive"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("inst/com/acme/C"), (F.col("p_partkey") % 350).cast("string"), F.lit(".classdata"))).otherwise(F.concat(F.lit("com/acme/C"), (F.col("p_partkey") % 350).cast("string"), F.lit(".class"))).alias("entry"))
    files = p.where("p_partkey % 40 < 33").select(F.concat(F.lit("/lib/"), (F.col("p_partkey") % 40).cast("string"), F.lit(".jar")).alias("path"), (F.col("p_partkey") % 40 != 7).alias("readable")).distinct()
    return memory.verify_claims(claims, entries, files).groupBy("code_source", "status").agg(F.count(F.lit(1)).alias("n"))


def dotnet_ladder(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    m = p.select(
        k, (k % 3 == 0).alias("verified"), (k % 5 == 0).alias("generated"), (k % 7 == 0).alias("spoofed"), (k % 4 == 0).alias("convention"),
        F.when(k % 11 == 0, F.array(F.lit("IHttpModule"))).otherwise(F.array().cast("array<string>")).alias("contracts"),
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (k % 4).cast("int")).alias("capabilities"),
    )
    return memory.module_ladder(m).select("p_partkey", "tier", "score", "signal")


def suspicion_rank(spark, d):
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    c = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("pid"), F.concat_ws(".", k.cast("string"), F.col("l_orderkey").cast("string"), n.cast("string")).alias("class_name"), F.when(k % 6 == 0, F.array(F.lit("javax.servlet.Filter"))).otherwise(F.array(F.lit("x.Y"))).alias("contracts"),
        F.when(k % 4 == 0, F.array(F.lit("exec"))).otherwise(F.array().cast("array<string>")).alias("capabilities"), F.when(n % 2 == 0, F.array(F.lit("service"))).otherwise(F.array(F.lit("run"))).alias("methods"),
        (k % 5 == 0).alias("disk_absent"), (k % 7 == 0).alias("out_of_contract"), (k % 3 == 0).alias("generated"), (k % 13 == 0).alias("bootstrap"), (k % 9 == 0).alias("platform"), (k % 97 == 0).alias("watched"),
    )
    return memory.capture(c).select("pid", "class_name", "suspicion", "rank")


def probe_coverage(spark, d):
    e = table(spark, d, "events")
    t = e.select(F.concat(F.lit("host-"), (F.col("user_id") % 40).cast("string")).alias("host"), F.col("event_type").alias("view"), (F.col("event_id") % 5 != 0).alias("ok"), (F.col("event_id") % 41 == 0).alias("early"), (F.col("user_id") % 3 != 0).alias("present"))
    return memory.probe_status(t)


def module_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("image_base"), F.col("p_brand").alias("name"))
    m = memory.merge_modules(p.where("image_base % 3 <> 0"), p.where("image_base % 4 = 0"))
    return m.select("image_base", "name", "reached", "scanned")


QUERIES = {
    f.__name__: f
    for f in (
        classify_path, file_context_counts, language_signs, binary_gate, rule_admission, skip_accounting, signature_matches, signature_findings, rule_validate, pack_from_table, thousand_rules, compile_check, pattern_summary, file_drop_paths,
        behaviour_viewstate, behaviour_iis, behaviour_w3wp_child, telemetry_coverage, events_top_per_channel, thread_range_join, region_overlap, region_ladder, max_run_length, stomp_classify,
        jvm_ladder, claim_verify, dotnet_ladder, suspicion_rank, probe_coverage, module_merge,
    )
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _re2(pattern: str) -> str:
    return pattern.replace("(?dis)", "(?is)").replace("(?di)", "(?i)").replace("(?dm)", "(?m)").replace("(?d)", "").replace("'", "''")


_LANG = f"""exts(ext, lang, web) AS (VALUES {_values([(e, lang, lang in WEB_SOURCE) for lang, es in EXTENSIONS.items() for e in es])}),
  parts AS (SELECT path, content, string_split(regexp_replace(lower(regexp_extract(path, '[^/]*$', 0)), '^[.]+', ''), '.') AS p FROM v_file),
  suffixes AS (SELECT path, unnest(range(2, len(p) + 1)) AS i, p FROM parts),
  hits AS (SELECT s.path, arg_max(e.lang, s.i) AS lang FROM suffixes s JOIN exts e ON e.ext = s.p[s.i] WHERE s.i = len(s.p) OR e.web GROUP BY s.path),
  named AS (SELECT parts.path, parts.content, parts.p, coalesce(hits.lang, 'unknown') AS lang FROM parts LEFT JOIN hits USING (path))"""
SHOWN = {lang: f"regexp_matches(content, '{_re2(p)}')" for lang, p in classify.SIGNS.items()}
SHOWN["aspx"], SHOWN["cgi"] = SHOWN["asp"], f"({SHOWN['perl']} OR {SHOWN['python']})"
SIGNED = f"{_LANG}, signed AS (SELECT path, content, lang, concat_ws(',', " + ", ".join(f"CASE WHEN {SHOWN[x]} THEN '{x}' END" for x in WEB_SOURCE) + ") AS signs FROM named)"
_OVERLAP = "len(list_intersect(string_split(signs, ','), string_split(bysign, ','))) > 0"
_ADMIT = f"""CASE WHEN scope = '' THEN 'undeclared' WHEN (contexts IS NULL AND lang <> 'unknown') OR list_contains(string_split(contexts, ','), lang) THEN 'declared'
   WHEN lang <> 'unknown' THEN 'refused' WHEN coalesce({_OVERLAP}, false) THEN 'unknown-language' ELSE 'refused' END"""


def _admitted(scope: str) -> str:
    contexts, signs = (",".join(t[scope]) for t in (SCOPE_CONTEXTS, SCOPE_SIGNS))
    return f"(list_contains(string_split('{contexts}', ','), lang) OR (lang = 'unknown' AND len(list_intersect(string_split(signs, ','), string_split('{signs}', ','))) > 0))"


def _strings(*pairs) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + ")"


_STRICT = "regexp_matches(content, 'use\\s+strict')"
_EARLY = "(?is)\\A((?:.*?[^0-9A-Za-z])??)die(?:[^0-9A-Za-z]|\\z)"
_HOLDS = {
    "script_marker": (f"contains(lower(content), '<script') AND contains(content, 'runat') AND {_admitted('asp-family')}", _strings(("a", "contains(lower(content), '<script')"), ("b", "contains(content, 'runat')"))),
    "many_the": ("len(regexp_extract_all(content, '\\bthe\\b')) >= 12 AND contains(content, 'The')", _strings(("a", "regexp_matches(content, '\\bthe\\b')"), ("b", "contains(content, 'The')"))),
    "short_file": ("strlen(content) < 900 AND contains(content, 'e')", "'a'"),
    "two_of_three": ("CAST(contains(content, 'qui') AS INT) + CAST(contains(content, 'der') AS INT) + CAST(contains(content, 'para') AS INT) >= 2 AND NOT contains(content, 'zzzz')", _strings(("a1", "contains(content, 'qui')"), ("a2", "contains(content, 'der')"), ("a3", "contains(content, 'para')"))),
    "php_start": (f"starts_with(content, '<?') AND {_admitted('php')}", _strings(("a", "contains(content, '<?')"), ("b", "regexp_matches(content, '(?s)<\\?p.p')"))),
    "early_word": (f"regexp_matches(content, '{_EARLY}') AND strlen(regexp_extract(content, '{_EARLY}', 1)) <= 400 AND {_admitted('web-generic')}", "'a'"),
    "builds_on": (f"(contains(content, 'import') OR {_STRICT}) AND contains(content, 'os') AND {_admitted('python')}", "'a'"),
}
_MATCHES = f"{SIGNED}, matches AS (" + " UNION ALL ".join(f"SELECT path, '{r}' AS rule, {s} AS strings FROM signed WHERE {c}" for r, (c, s) in _HOLDS.items()) + ")"
_FACTS = {"script_marker": ("GenericASPX", 75, "likely-malicious"), "many_the": (None, 45, "suspicious"), "short_file": (None, 70, "likely-malicious"), "two_of_three": ("Mixed", 60, "likely-malicious"), "php_start": (None, 88, "confirmed"), "early_word": (None, 30, "clean"), "builds_on": ("ReverseShell", 85, "confirmed")}
_PROC = f"""proc AS (SELECT ord, host, regexp_extract(lower(trim(child)), '[^\\\\/]*$', 0) AS c FROM v_event WHERE event_id IN (4688, 1) AND ends_with(lower(parent), '\\w3wp.exe'))"""
_WIRED = f"contract IN ({_in(PIPELINE_CONTRACTS)})"
_ACTS = "(caps LIKE '%exec%' OR caps LIKE '%tunnel%')"
_NCAPS = "(CASE WHEN caps = '' THEN 0 ELSE len(string_split(caps, ',')) END)"


def _rungs(column: int) -> str:
    rows = [
        (f"status = 'spoofed' AND {_WIRED}", "likely-malicious", 95, "codesource-spoofed"), (f"status = 'spoofed' AND {_ACTS}", "likely-malicious", 90, "codesource-spoofed"), ("status = 'spoofed'", "suspicious", 60, "codesource-spoofed"),
        (f"status = 'disk-absent' AND {_WIRED}", "likely-malicious", 95, "fileless-pipeline-class"), (f"status = 'disk-absent' AND ({_ACTS} OR {_NCAPS} >= 2)", "likely-malicious", 80, "fileless-capable-class"),
        (f"status = 'disk-absent' AND {_NCAPS} = 1", "suspicious", 55, "fileless-class"), ("status = 'disk-absent'", "suspicious", 50, "fileless-class"), (f"status = 'unverifiable' AND {_WIRED}", "suspicious", 50, "unverifiable-origin"),
        (f"out_of_contract AND {_WIRED} AND NOT generated", "likely-malicious", 90, "codesource-out-of-contract"), (f"out_of_contract AND {_ACTS}", "likely-malicious", 80, "codesource-out-of-contract"), ("out_of_contract AND NOT generated", "suspicious", 55, "codesource-out-of-contract"),
    ]
    return "CASE " + " ".join(f"WHEN {r[0]} THEN " + (str(r[column]) if column == 2 else f"'{'kb:java-mem/' if column == 3 else ''}{r[column]}'") for r in rows) + " END"


_THREADS = "marked AS (SELECT r.*, EXISTS (SELECT 1 FROM v_thread t WHERE t.pid = r.pid AND t.start_address >= r.base AND t.start_address < r.base + r.size) AS thread_start FROM v_region r)"
_WX = "(protect & 192) <> 0"
_JIT = f"(managed AND NOT backed AND NOT ({_WX} OR has_pe OR thread_start))"
_RAISED = f"greatest(50, CASE WHEN {_WX} THEN 80 ELSE 0 END, CASE WHEN thread_start THEN 85 ELSE 0 END, CASE WHEN has_pe THEN 90 ELSE 0 END)"
_RUNS = "bytes AS (SELECT DISTINCT l_suppkey % 40 AS k, l_partkey % 1500 AS rva FROM lineitem), runs AS (SELECT k, count(*) AS run FROM (SELECT k, rva - row_number() OVER (PARTITION BY k ORDER BY rva) AS i FROM bytes) GROUP BY k, i), agg AS (SELECT k, CAST(sum(run) AS BIGINT) AS modified, max(run) AS max_run FROM runs GROUP BY k)"
ORACLES = {
    "classify_path": with_views(("v_file",), f"WITH {_LANG} SELECT path, lang, CASE WHEN len(p) > 1 THEN '.' || p[len(p)] ELSE '' END AS ext FROM named"),
    "file_context_counts": with_views(("v_file",), f"WITH {_LANG} SELECT lang AS context, count(*) AS files FROM named GROUP BY 1"),
    "language_signs": with_views(("v_file",), f"WITH {SIGNED} SELECT path, signs FROM signed"),
    "binary_gate": "SELECT doc_id, doc_id % 3 = 0 AND strlen(substr(text, 1, CAST(doc_id % 12000 AS INT))) < 8000 AS is_binary FROM documents",
    "rule_admission": with_views(("v_file",), f"WITH {SIGNED}, scopes(scope, contexts, bysign) AS (VALUES {_values([('', None, None), *((s, ','.join(SCOPE_CONTEXTS[s]), ','.join(SCOPE_SIGNS[s])) for s in SCOPE_CONTEXTS), ('cobol', None, None)])}) SELECT scope, {_ADMIT} AS admission, count(*) AS files FROM signed, scopes GROUP BY 1, 2"),
    "skip_accounting": with_views(("v_file",), f"WITH {SIGNED} SELECT count(DISTINCT path) AS no_language_detector FROM signed WHERE lang = 'unknown' AND signs = ''"),
    "signature_matches": with_views(("v_file",), f"WITH {_MATCHES} SELECT path, rule, strings FROM matches"),
    "signature_findings": with_views(("v_file",), f"WITH {_MATCHES}, facts(rule, family, score, tier) AS (VALUES " + ", ".join(f"('{r}', " + ("NULL" if f is None else f"'{f}'") + f", {s}, '{t}')" for r, (f, s, t) in _FACTS.items()) + ") SELECT rule, tier, score, family, count(*) AS files FROM matches JOIN facts USING (rule) GROUP BY ALL"),
    "rule_validate": with_views(("v_file",), f"WITH {_MATCHES}, names(rule) AS (VALUES {', '.join(f"('{r}')" for r in _FACTS)}) SELECT rule, count(m.path) AS hits FROM names LEFT JOIN matches m USING (rule) GROUP BY 1 UNION ALL SELECT 'has_import', count(*) FROM v_file WHERE contains(content, 'import') OR {_STRICT}"),
    "pack_from_table": """WITH b AS (SELECT 'passage_' || item_id AS rule, array_to_string(string_split(text, ' ')[1:5], ' ') AS w FROM benchmark),
        m AS (SELECT CAST(doc_id AS VARCHAR) AS path, rule, contains(text, w) AS a, contains(translate(text, {0}), translate(w, {0})) AS b FROM documents, b)
        SELECT path, rule, concat_ws(',', CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END) AS strings FROM m WHERE a OR b""".format("'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"),
    "thousand_rules": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, string_split(p_name, ' ') AS w FROM part), d AS (SELECT doc_id AS r, text, strlen(text) AS n, lower(text) AS low FROM documents),
        firsts AS (SELECT w1, r FROM (SELECT DISTINCT w[1] AS w1 FROM p), d WHERE contains(low, lower(w1))),
        seconds AS (SELECT w2, r FROM (SELECT DISTINCT w[2] AS w2 FROM p), d WHERE n < 2048 AND contains(text, w2) AND regexp_matches(text, '(^|[^0-9A-Za-z])' || w2 || '([^0-9A-Za-z]|$)')),
        tokens AS (SELECT doc_id AS r, unnest(regexp_extract_all(text, '[0-9A-Za-z]+')) AS token FROM documents),
        numbers AS (SELECT token, r FROM tokens WHERE regexp_full_match(token, '[0-9]+') GROUP BY ALL HAVING count(*) > 1),
        hits AS (SELECT k, r FROM p JOIN firsts ON w[1] = w1 UNION SELECT k, r FROM p JOIN seconds ON w[2] = w2 UNION SELECT k, r FROM p JOIN numbers ON token = k)
        SELECT 'part_' || k AS rule, count(*) AS files FROM hits GROUP BY 1""",
    "compile_check": "SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 5 < 3 THEN 'r' || p_partkey END AS identifier, CASE p_partkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'unresolved' ELSE 'failed' END AS status FROM part",
    "pattern_summary": "WITH g AS (SELECT l_suppkey, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS ids FROM lineitem GROUP BY 1) SELECT l_suppkey, array_to_string(ids[1:6], ', ') || CASE WHEN len(ids) > 6 THEN ' (+' || (len(ids) - 6) || ' more)' ELSE '' END AS summary FROM g",
    "file_drop_paths": with_views(("v_file",), "SELECT path, concat_ws(',', " + ", ".join(f"CASE WHEN path = '{r}' OR path = '{r.rstrip('/')}' OR starts_with(path, '{r.rstrip('/')}/') THEN '{r}' END" for r in ["/srv", "/srv/d1", "/www/", "/ww", "/srv/d10.txt"]) + ") AS roots FROM v_file"),
    "behaviour_viewstate": with_views(("v_event",), "SELECT ord, host, 'behavioral-context' AS basis, 'asp.net:viewstate-mac-failure' AS identity FROM v_event WHERE event_id = 1316 AND starts_with(lower(provider), 'asp.net') AND contains(lower(detail), 'viewstate')"),
    "behaviour_iis": with_views(("v_event",), "SELECT ord, host, 'server configuration changed, event ' || event_id AS evidence FROM v_event WHERE channel = 'Microsoft-IIS-Configuration/Operational' AND event_id IN (29, 50)"),
    "behaviour_w3wp_child": with_views(("v_event",), f"WITH {_PROC} SELECT ord, host, CASE WHEN c IN ({_in(SHELL_CHILDREN)}) THEN 'kb:behavioral/w3wp-child-process' ELSE 'kb:behavioral/w3wp-anomalous-child' END AS knowledge_ref, 'proc:w3wp->' || c AS identity FROM proc WHERE c <> '' AND c NOT IN ({_in(EXPECTED_CHILDREN)})"),
    "telemetry_coverage": with_views(("v_event",), "SELECT host, bool_or(event_id = 4688) AS has_4688, bool_or(event_id = 4688 AND coalesce(parent, '') <> '') AS has_parent, bool_or(event_id = 1) AS has_sysmon, CASE WHEN bool_or(event_id = 1) OR bool_or(event_id = 4688 AND coalesce(parent, '') <> '') THEN 'ran' ELSE 'degraded' END AS status FROM v_event GROUP BY host"),
    "events_top_per_channel": with_views(("v_event",), "SELECT ord, host, channel FROM v_event QUALIFY row_number() OVER (PARTITION BY host, channel ORDER BY time DESC, ord DESC) <= 20"),
    "thread_range_join": with_views(("v_region", "v_thread"), "SELECT r.pid, r.region_no, t.thread_id FROM v_region r JOIN v_thread t ON t.pid = r.pid AND t.start_address >= r.base AND t.start_address < r.base + r.size"),
    "region_overlap": with_views(("v_region",), "SELECT a.pid, a.region_no AS l, b.region_no AS r FROM v_region a JOIN v_region b ON a.pid = b.pid AND a.region_no < b.region_no AND a.base < b.base + b.size * 40 AND b.base < a.base + a.size * 40"),
    "region_ladder": with_views(("v_region", "v_thread"), f"""WITH {_THREADS} SELECT pid, region_no, CASE WHEN backed AND stomped THEN 'likely-malicious' WHEN backed AND patched THEN 'suspicious' WHEN backed OR {_JIT} THEN 'clean' WHEN {_RAISED} > 50 THEN 'likely-malicious' ELSE 'suspicious' END AS tier,
        CAST(CASE WHEN backed AND stomped THEN 90 WHEN backed AND patched THEN 55 WHEN backed OR {_JIT} THEN 0 ELSE {_RAISED} END AS INT) AS score,
        CASE WHEN backed AND stomped THEN 'module-stomped' WHEN backed AND patched THEN 'inline-patched-code' WHEN backed THEN 'image-backed' WHEN {_JIT} THEN 'jit-owned' ELSE concat_ws(',', 'unbacked-executable-region', CASE WHEN {_WX} THEN 'rwx' END, CASE WHEN thread_start THEN 'thread-start' END, CASE WHEN has_pe THEN 'pe-image' END) END AS signals,
        CASE WHEN {_WX} THEN 'RWX' WHEN (protect & 240) <> 0 THEN 'RX' ELSE 'non-exec' END AS protection FROM marked"""),
    "max_run_length": f"WITH {_RUNS} SELECT k, modified, max_run FROM agg",
    "stomp_classify": f"WITH {_RUNS} SELECT k, CASE WHEN k * 400 <= 0 OR modified <= 0 THEN 'clean' WHEN modified / (k * 400) >= 0.05 OR max_run >= 256 THEN 'stomped' ELSE 'patched' END AS class FROM agg",
    "jvm_ladder": with_views(("v_class",), f"SELECT pid, class_no, {_rungs(1)} AS tier, {_rungs(2)} + CASE WHEN contradiction THEN 5 ELSE 0 END AS score, CASE WHEN contradiction THEN 'kb:java-mem/loader-contradiction' ELSE {_rungs(3)} END AS knowledge_ref FROM v_class WHERE {_rungs(2)} IS NOT NULL"),
    "claim_verify": """WITH claims AS (SELECT DISTINCT 'com.acme.C' || (p_partkey % 700) AS class_name, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '/lib/' || (p_partkey % 40) || '.jar' END AS code_source, p_partkey % 17 = 0 AS nested FROM part),
        entries AS (SELECT '/lib/' || (p_partkey % 40) || '.jar' AS archive, CASE WHEN p_partkey % 3 = 0 THEN 'inst/com/acme/C' || (p_partkey % 350) || '.classdata' ELSE 'com/acme/C' || (p_partkey % 350) || '.class' END AS entry FROM part),
        files AS (SELECT DISTINCT '/lib/' || (p_partkey % 40) || '.jar' AS path, p_partkey % 40 <> 7 AS readable FROM part WHERE p_partkey % 40 < 33),
        v AS (SELECT c.code_source, CASE WHEN nested THEN 'unverifiable' WHEN code_source = '' THEN 'disk-absent' WHEN f.path IS NULL THEN 'spoofed' WHEN NOT f.readable THEN 'unverifiable'
          WHEN EXISTS (SELECT 1 FROM entries e WHERE e.archive = c.code_source AND e.entry IN (replace(c.class_name, '.', '/') || '.class', 'inst/' || replace(c.class_name, '.', '/') || '.classdata')) THEN 'corroborated' ELSE 'spoofed' END AS status FROM claims c LEFT JOIN files f ON f.path = c.code_source)
        SELECT code_source, status, count(*) AS n FROM v GROUP BY ALL""",
    "dotnet_ladder": """WITH m AS (SELECT p_partkey, p_partkey % 3 = 0 AS verified, p_partkey % 5 = 0 AS generated, p_partkey % 7 = 0 AS spoofed, p_partkey % 11 = 0 OR (p_partkey % 4 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0) AS wired, least(p_partkey % 4, 3) AS n FROM part),
        s AS (SELECT *, CAST(CASE WHEN verified AND NOT wired THEN 0 WHEN generated AND NOT wired AND n = 0 THEN 0 WHEN wired AND n > 0 THEN 95 WHEN wired THEN 85 WHEN n >= 2 THEN 80 WHEN n = 1 THEN 55 ELSE 50 END AS INT) AS score FROM m)
        SELECT p_partkey, CASE WHEN score = 0 THEN 'clean' WHEN score >= 80 THEN 'likely-malicious' ELSE 'suspicious' END AS tier, score, CASE WHEN spoofed AND score > 0 THEN 'spoofed-strong-name' END AS signal FROM s""",
    "suspicion_rank": """WITH c AS (SELECT l_orderkey % 50 AS pid, l_partkey || '.' || l_orderkey || '.' || l_linenumber AS class_name, l_partkey % 6 = 0 AS wired, l_partkey % 4 = 0 AS cap, l_linenumber % 2 = 0 AS hook, l_partkey % 5 = 0 AS absent, l_partkey % 7 = 0 AS ooc,
          l_partkey % 3 = 0 AS gen, l_partkey % 13 = 0 AS boot, l_partkey % 9 = 0 AS plat, l_partkey % 97 = 0 AS watched FROM lineitem),
        s AS (SELECT *, CAST(CASE WHEN plat THEN 0 WHEN watched THEN 100 ELSE greatest(0, 40 * wired::INT + 30 * absent::INT + 30 * ooc::INT + 15 * (wired AND absent)::INT + 15 * cap::INT + 10 * hook::INT - 55 * gen::INT + 10 * boot::INT) END AS INT) AS suspicion FROM c WHERE NOT plat AND (watched OR ((absent OR ooc) AND NOT gen) OR wired))
        SELECT pid, class_name, suspicion, CAST(row_number() OVER (PARTITION BY pid ORDER BY suspicion DESC, class_name) AS INT) AS rank FROM s QUALIFY rank <= 128""",
    "probe_coverage": """WITH g AS (SELECT 'host-' || (user_id % 40) AS host, event_type AS view, count(*) FILTER (user_id % 3 <> 0) AS n, count(*) FILTER (user_id % 3 <> 0 AND event_id % 5 = 0) AS bad, bool_or(user_id % 3 <> 0 AND event_id % 41 = 0) AS truncated FROM events GROUP BY 1, 2)
        SELECT host, view, CASE WHEN n = 0 THEN 'n/a' WHEN bad = n THEN 'failed' WHEN bad > 0 THEN 'degraded' ELSE 'ran' END AS status, truncated, n, bad FROM g""",
    "module_merge": "SELECT p_partkey AS image_base, p_brand AS name, p_partkey % 4 = 0 AS reached, p_partkey % 3 <> 0 AS scanned FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 0",
}
