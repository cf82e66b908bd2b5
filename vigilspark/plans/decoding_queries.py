"""Decoding, taint, discovery and diagnostics queries. Those whose pass runs in Python mappers have no SQL; tests hold them
against fixtures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from vigilspark.operators import discovery, layers, rules
from vigilspark.operators.taint import bytecode, classcode, classfile, scripts, ssi
from vigilspark.packs import own_rules
from vigilspark.plans import class_bytes
from vigilspark.plans.detection_queries import SHOWN, SIGNED
from vigilspark.plans.projections import table, view, with_views

#: Inert sources: statements of each language, which stand before a document's whole text as a comment.
SCRIPTS = {
    ".php": ["<?php $q = $_GET['q']; system($q); ?>", "<?php $f = 'sys' . 'tem'; $f($_POST['a']); ?>", "<?php echo 'hello'; ?>", "<?php include($_REQUEST['p']); ?>"],
    ".pl": ["#!/usr/bin/perl\nuse CGI;\nmy $v = param('v');\nmy $w = $v;\nsystem($w);\n", "#!/usr/bin/perl\nprint 1;\n"],
    ".py": ["import os, cgi\nform = cgi.FieldStorage()\nc = form.getvalue('c')\nos.system(c)\n", "import os\nos.system('ls')\n"],
    ".asp": ['<%\nDim a\na = Request("x")\nExecute a\n%>', '<%\nResponse.Write "x"\n%>'],
    ".jsp": ['<% String c = request.getParameter("c"); Runtime.getRuntime().exec(c); %>', '<% out.println("x"); %>'],
}
_COMMENT = {".php": ("<?php /* ", " */ ?>"), ".pl": ("# ", ""), ".py": ("# ", ""), ".asp": ("<% ' ", " %>"), ".jsp": ("<%-- ", " --%>")}
#: What the passes find in the sources, in order.
FOUND = [
    ("phptaint:sink-on-request", "DynamicDispatch", 85, "heuristic"), ("phptaint:sink-on-request", "DynamicDispatch", 85, "heuristic"), None, ("phptaint:sink-on-request", "GenericEval", 80, "heuristic"),
    ("perlpytaint:sink-on-request", "GenericCmdExec", 85, "taint"), None, ("perlpytaint:sink-on-request", "GenericCmdExec", 85, "taint"), None,
    ("asptaint:sink-on-request", "ClassicASP", 85, "taint"), None, ("javadisk:request-exec", "GenericJSP", 85, "heuristic"), None,
]
_SSI = ['<!--#set var="a" value="$QUERY_STRING" --><!--#exec cmd="ls ${a}" -->', '<!--#include virtual="/x/$HTTP_HOST" -->', '<!--#set var="b" value="fixed" --><!--#exec cmd="$b" -->', "<!--#echo var=\"DATE\" -->", "plain"]


def _sources(spark, d):
    flat = [(e, t, *_COMMENT[e]) for e, texts in SCRIPTS.items() for t in texts]
    parts = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("etoc", row, strict=True))) for row in flat))
    docs = table(spark, d, "documents").withColumn("s", F.get(parts, (F.col("doc_id") % len(flat)).cast("int")))
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^0-9A-Za-z \u00C0-\u024F]", " ")
    return docs.select(F.concat(F.lit("/srv/"), F.col("doc_id").cast("string"), "s.e").alias("path"), F.concat("s.t", "s.o", words, "s.c").alias("text"))


def rot13(spark, d):
    return view(spark, d, "v_snippet").select("doc_id", F.sha2(layers.rot13(F.col("content")), 256).alias("digest"))


def hex_runs(spark, d):
    return view(spark, d, "v_snippet").select("doc_id", F.array_join(layers.hex_runs(F.col("content")), ",").alias("runs"))


def base64_runs(spark, d):
    return view(spark, d, "v_snippet").select("doc_id", F.array_join(layers.base64_runs(F.col("content")), ",").alias("runs"))


def chr_runs(spark, d):
    return view(spark, d, "v_snippet").select("doc_id", F.array_join(layers.chr_runs(F.col("content")), ",").alias("runs"))


#: A letter under each of the seven escapes, around a document's text.
_ESCAPED = r"\x41\u{42}\u0043\104%45&#x46;&#71;"


def escape_normalise(spark, d):
    """All escapes undone, by what the layers use: documents without signs of escapes of their own, between escaped letters."""
    text = F.translate(F.coalesce("text", F.lit("")), "%&\\", "")
    f = table(spark, d, "documents").select("doc_id", F.concat(F.lit(_ESCAPED), text, F.lit(_ESCAPED)).alias("content"))
    return layers.normalised(f, "content").select("doc_id", F.sha2("content", 256).alias("digest"))


#: Expressions over two words (<w> and <v>; <r>, <b> and <h> are <w> reversed, in base64 and in hex), and what they fold to.
EXPRESSIONS = [
    ("$a = '<w>' . '<v>' . \"<w>\";", "$a = '<w><v><w>';"), ("b = '<w>' + '<v>'", "b = '<w><v>'"), ("reverse('<r>')", "'<w>'"), ("'<r>'[::-1]", "'<w>'"), ("decode_base64('<b>')", "'<w>'"), ("base64.b64decode('<b>').decode()", "'<w>'"),
    ("pack('H*', '<h>') . '<v>'", "'<w><v>'"), ("bytes.fromhex('<h>')", "'<w>'"), ("getattr(<w>, 'x' + '<v>')(1)", "<w>.x<v>(1)"), ("fn = 'x<w>'\nfn(2)", "fn = 'x<w>'\nx<w>(2)"), ("chr(72).chr(0x69) . '<w>'", "'Hi<w>'"), ("f(<w>, '<v>')", "f(<w>, '<v>')"),
]


def fold_expressions(spark, d):
    w = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]{3,12})"), F.lit(1)), lambda x: x != "")
    docs = table(spark, d, "documents").withColumn("w", w).withColumn("w1", F.coalesce(F.get("w", 0), F.lit("one"))).withColumn("w2", F.coalesce(F.get("w", 1), F.lit("two")))
    e = F.get(F.array(*(F.lit(x) for x, _ in EXPRESSIONS)), (F.col("doc_id") % len(EXPRESSIONS)).cast("int"))
    for sign, value in (("<r>", F.reverse("w1")), ("<b>", F.base64(F.col("w1").cast("binary"))), ("<h>", F.hex("w1")), ("<w>", F.col("w1")), ("<v>", F.col("w2"))):
        e = F.replace(e, F.lit(sign), value)
    return layers.folded_text(docs.select("doc_id", e.alias("content")), "content")


def decoded_layers(spark, d):
    f = view(spark, d, "v_snippet").select(F.col("doc_id").cast("string").alias("path"), "content")
    return layers.decoded_layers(f).select("path", "ordinal", "method", F.sha2("data", 256).alias("digest"), "truncated")


def ssi_taint(spark, d):
    pages = F.array(*map(F.lit, _SSI))
    f = table(spark, d, "documents").select(F.concat(F.lit("/srv/"), F.col("doc_id").cast("string"), F.lit(".shtml")).alias("path"), F.concat(F.get(pages, (F.col("doc_id") % len(_SSI)).cast("int")), F.lit("\n"), "text").alias("text"))
    return ssi.findings(f)


def script_taint(spark, d):
    return scripts.all_findings(_sources(spark, d)).select("path", "knowledge_ref", "family", "score", "basis", "tier")


#: What the engine's own rules find in the sources: place in the list, rule, family, score.
OWN_FOUND = [(1, "php_name_from_pieces", "DynamicDispatch", 70), (3, "php_includes_request", "GenericInclude", 75), (6, "python_request_to_shell", "GenericCmdExec", 78), (10, "jsp_request_to_process", "GenericJSP", 78)]


def own_pack_findings(spark, d):
    """The engine's own detection rules over the sources."""
    found = own_rules()
    return rules.findings(rules.matches(_sources(spark, d), found), found).select("path", "rule", "family", "score", "tier", "admission")


def pass_admission(spark, d):
    """How many files each script pass examines: by name, or by sign where the name says nothing."""
    f = view(spark, d, "v_file").select("path", F.col("content").alias("text"))
    out = None
    for name, admitted in scripts.ADMITTED.items():
        rows = admitted(f).agg(F.count(F.lit(1)).alias("files")).select(F.lit(name).alias("pass"), "files")
        out = rows if out is None else out.unionByName(rows)
    return out


def pass_skips(spark, d):
    """Files that a pass admits and leaves out for their size, under limits that the table reaches."""
    f = view(spark, d, "v_file").select("path", F.col("content").alias("text"))
    return scripts.skipped(f, dict.fromkeys(scripts.LIMITS, 4000)).select("path", "pass", "bytes")


def _archives(group: pa.Table) -> pa.Table:
    """One archive of class files from rows path, class, method, owner, name."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("class", "method", "owner", "name")), strict=True))
    classes: dict[str, dict[str, list]] = {}
    for class_, method, owner, name in rows:
        classes.setdefault(class_, {}).setdefault(method, []).append(("call", owner, name, "()V", "static"))
    members = [(f"{c}.class", class_bytes.class_file(c, [(m, "()V", [*dict.fromkeys(calls), "return"]) for m, calls in methods.items()])) for c, methods in classes.items()]
    return pa.table({"path": [group.column("path")[0].as_py()], "content": pa.array([class_bytes.archive(members)], pa.binary())})


def java_semantic(spark, d):
    """Request data through the bytecode of small archives, a kind of flow for each document."""
    kinds = {v: class_bytes.archive(class_bytes.flow_classes(v)) for v in class_bytes.FLOWS}
    content = F.get(F.array(*(F.lit(bytearray(kinds[v])) for v in sorted(kinds))), (F.col("doc_id") % len(kinds)).cast("int"))
    files = table(spark, d, "documents").select(F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit(".war")).alias("path"), content.alias("content"))
    return bytecode.semantic(files).select("path", "class", "sink", "rule", "family", "score")


def _pairs_of_classes(spark, d):
    """Classes in memory and on disk: the same in another order, with another constant, without a disk copy, no class at all."""
    say = lambda text: [("text", text), "pop", "return"]
    here, there = [("a", "()V", say("x")), ("b", "()V", say("y"))], [("b", "()V", say("y")), ("a", "()V", say("x"))]
    kinds = [(class_bytes.class_file("C", here), class_bytes.class_file("C", there)), (class_bytes.class_file("C", here), class_bytes.class_file("C", [("a", "()V", say("x")), ("b", "()V", say("z"))])), (class_bytes.class_file("C", here), None), (b"no class", class_bytes.class_file("C", here))]
    both = F.get(F.array(*(F.struct(F.lit(m and bytearray(m)).cast("binary").alias("m"), F.lit(s and bytearray(s)).cast("binary").alias("s")) for m, s in kinds)), (F.col("event_id") % len(kinds)).cast("int"))
    return table(spark, d, "events").withColumn("k", both).select(F.col("event_id").cast("string").alias("path"), F.col("k.m").alias("memory"), F.col("k.s").alias("source"))


def class_compare(spark, d):
    return classcode.compare(_pairs_of_classes(spark, d)).groupBy("result").agg(F.count(F.lit(1)).alias("classes"))


def class_clones(spark, d):
    f = _pairs_of_classes(spark, d).select("path", F.coalesce("source", "memory").alias("content"))
    return classcode.clone_groups(f).select("first_path", "files")


#: Links of each host's file system.
_LINKS = [("/var/www", "/srv/web"), ("/srv/web/current", "releases/2"), ("/srv/web/up", "../../etc"), ("/loop/a", "b"), ("/loop/b", "/loop/a"), ("/out", "../../..")]
_PATHS = [("/var/www/current/x.php", "/srv/web/releases/2/x.php", None), ("/srv//web/./y", "/srv/web/y", None), ("/var/www/up/passwd", "/etc/passwd", None), ("/loop/a/z", None, "too many links"), ("/out/z", None, "escapes the root"), ("/a/../b/../../c", None, "escapes the root"), ("/plain/../file", "/file", None)]


def resolved_links(spark, d):
    hosts = table(spark, d, "nation").select(F.col("n_name").alias("host"))
    links = hosts.withColumn("l", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("target")) for p, t in _LINKS)))).select("host", "l.path", "l.target")
    paths = table(spark, d, "customer").select((F.col("c_custkey") % len(_PATHS)).cast("int").alias("k"), "c_nationkey").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("host"), F.get(F.array(*(F.lit(p) for p, _, _ in _PATHS)), F.col("k")).alias("path"))
    return discovery.resolve_links(paths, links).groupBy("host", "path", "resolved", "problem").agg(F.count(F.lit(1)).alias("n"))


def java_structural(spark, d):
    apis = sorted(classfile.APIS)
    pair = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(n).alias("n")) for o, n in apis))
    rows = table(spark, d, "lineitem").withColumn("a", F.get(pair, (F.col("l_partkey") % len(apis)).cast("int")))
    made = rows.select((F.col("l_orderkey") % 300).cast("string").alias("path"), F.concat(F.lit("C"), (F.col("l_orderkey") % 5).cast("string")).alias("class"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit("_"), (F.col("l_orderkey") % 77).cast("string")).alias("method"), F.col("a.o").alias("owner"), F.col("a.n").alias("name")).distinct()
    files = made.groupBy("path").applyInArrow(_archives, "path string, content binary")
    return classfile.structural(classfile.calls(files)[0]).select("path", "class", "rule", "family", "method", "score")


def discovery_merge(spark, d):
    return discovery.merge(view(spark, d, "v_root")).select("host", "path", "provenance", F.array_join("mechanisms", ",").alias("mechanisms"))


def discovery_subsume(spark, d):
    return discovery.subsume(discovery.merge(view(spark, d, "v_root"))).select("host", "path", "covered_by")


def mechanism_credit(spark, d):
    return discovery.credit(discovery.subsume(discovery.merge(view(spark, d, "v_root"))))


def discovery_gate(spark, d):
    hosts = table(spark, d, "customer").select((F.col("c_custkey") % 40).cast("string").alias("host")).distinct()
    return discovery.gate(hosts, discovery.merge(view(spark, d, "v_root")))


def _diagnostics(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(F.concat(F.lit("/a/"), (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "!/x.class").otherwise("")).alias("artifact"), F.concat(F.lit("code-"), (F.col("l_suppkey") % 6).cast("string")).alias("code"), F.concat(F.lit("d"), (F.col("l_linenumber") % 2).cast("string")).alias("detail"), (F.col("l_quantity").cast("long") - 3).alias("count"))


def diagnostic_summary(spark, d):
    return discovery.diagnostic_summary(_diagnostics(spark, d))


def artifact_status(spark, d):
    a = table(spark, d, "part").select(F.concat(F.lit("/a/"), (F.col("p_partkey") % 9).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".class")).alias("path"), (F.col("p_partkey") % 31 != 0).alias("read_ok"))
    x = a.where("path like '%5.class'").select(F.col("path").alias("artifact"), F.lit("java-artifact-read-failed").alias("code"), F.lit(1).cast("long").alias("count"))
    x = x.unionByName(spark.createDataFrame([("/a/3", "slow", 1)], "artifact string, code string, count long"))
    return discovery.artifact_status(a, x).select("path", "status", F.array_join("codes", ",").alias("codes"))


def exact_duplicate_documents(spark, d):
    t = table(spark, d, "documents")
    g = t.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1")


QUERIES = {
    f.__name__: f
    for f in (
        rot13, hex_runs, base64_runs, chr_runs, escape_normalise, fold_expressions, decoded_layers, ssi_taint, script_taint, own_pack_findings, pass_admission, pass_skips, java_structural, java_semantic, class_compare, class_clones, resolved_links, discovery_merge, discovery_subsume, mechanism_credit, discovery_gate,
        diagnostic_summary, artifact_status, exact_duplicate_documents,
    )
}


def _apis() -> str:
    return ", ".join(f"({i}, '{f}')" for i, (_, f) in enumerate(sorted(classfile.APIS.items())))


_RULES = " UNION ALL ".join("SELECT path, class, '" + r + "' AS rule, '" + f + "' AS family, method FROM m WHERE " + " AND ".join(f"list_contains(f, '{x}')" for x in need) for r, f, need in classfile.RULES)
_ROT = "translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"
_MERGED = "merged AS (SELECT host, path, CASE max(CASE provenance WHEN 'explicit' THEN 3 WHEN 'config' THEN 2 WHEN 'convention' THEN 1 ELSE 0 END) WHEN 3 THEN 'explicit' WHEN 2 THEN 'config' ELSE 'convention' END AS provenance, string_agg(DISTINCT mechanism, ',' ORDER BY mechanism) AS mechanisms FROM v_root GROUP BY host, path)"
_SUBSUMED = f"{_MERGED}, subsumed AS (SELECT m.host, m.path, m.mechanisms, arg_min(a.path, length(a.path)) AS covered_by FROM merged m LEFT JOIN merged a ON a.host = m.host AND a.path <> m.path AND starts_with(m.path, a.path || '/') GROUP BY ALL)"


def _expressions(column: int) -> str:
    arms = " ".join(f"WHEN {i} THEN '" + e[column].replace("'", "''") + "'" for i, e in enumerate(EXPRESSIONS))
    return f"CASE doc_id % {len(EXPRESSIONS)} {arms} END"


def _script_rows() -> str:
    rows = [(i, e, *f) for i, ((e, _), f) in enumerate(zip([(e, t) for e, texts in SCRIPTS.items() for t in texts], FOUND, strict=True)) if f]
    return ", ".join(f"({i}, '{e}', '{ref}', '{family}', {score}, '{basis}', '{'confirmed' if score >= 85 else 'likely-malicious'}')" for i, e, ref, family, score, basis in rows)


_BINARY_OK = "(NOT contains(substr(content, 1, 8000), chr(0)))"
_PASSES = {"php": ("php",), "asp": ("asp", "aspx"), "ssi": ("shtml",)}


def _pass(name: str) -> str:
    langs = ", ".join(f"'{x}'" for x in _PASSES[name])
    shown = " OR ".join(SHOWN[x] for x in _PASSES[name])
    return f"(lang IN ({langs}) OR (lang = 'unknown' AND ({shown}) AND {_BINARY_OK}))"


_CGI = f"(lang IN ('perl', 'python', 'cgi') OR (lang = 'unknown' AND {SHOWN['cgi']} AND {_BINARY_OK}))"
_JAVA = f"(ends_with(lower(path), '.java') OR lang = 'jsp' OR (lang = 'unknown' AND {SHOWN['jsp']} AND {_BINARY_OK}))"
_ADMITS = {"php": _pass("php"), "cgi": _CGI, "asp": _pass("asp"), "ssi": _pass("ssi"), "java": _JAVA}


ORACLES = {
    "rot13": with_views(("v_snippet",), f"SELECT doc_id, sha256({_ROT}) AS digest FROM v_snippet"),
    "hex_runs": with_views(("v_snippet",), "SELECT doc_id, array_to_string([upper(replace(r, '\\x', '')) FOR r IN regexp_extract_all(content, '(?:\\\\x[0-9A-Fa-f]{2}){6,}')], ',') AS runs FROM v_snippet"),
    "base64_runs": with_views(("v_snippet",), "SELECT doc_id, array_to_string([hex(from_base64(r)) FOR r IN regexp_extract_all(content, '[A-Za-z0-9+/]{24,}={0,2}') IF length(r) % 4 = 0 AND regexp_full_match(r, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)')], ',') AS runs FROM v_snippet"),
    "chr_runs": with_views(("v_snippet",), "SELECT doc_id, array_to_string([array_to_string([lpad(to_hex(CAST(c AS INT)), 2, '0') FOR c IN regexp_extract_all(r, '[0-9]+')], '') FOR r IN regexp_extract_all(content, '(?i)(?:chr\\s*\\(\\s*(?:0x[0-9a-f]{1,2}|[0-9]{1,3})\\s*\\)\\s*(?:\\.\\s*)?){4,}')], ',') AS runs FROM v_snippet"),
    "escape_normalise": "SELECT doc_id, sha256('ABCDEFG' || translate(coalesce(text, ''), '%&\\', '') || 'ABCDEFG') AS digest FROM documents",
    "fold_expressions": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{3,12}}') AS w FROM documents), x AS (SELECT doc_id, coalesce(w[1], 'one') AS w1, coalesce(w[2], 'two') AS w2 FROM w)
        SELECT doc_id, replace(replace({_expressions(1)}, '<w>', w1), '<v>', w2) AS content FROM x""",
    "script_taint": f"""WITH f(i, e, knowledge_ref, family, score, basis, tier) AS (VALUES {_script_rows()})
        SELECT '/srv/' || doc_id || e AS path, knowledge_ref, family, score, basis, tier FROM documents JOIN f ON i = doc_id % {sum(map(len, SCRIPTS.values()))}""",
    "own_pack_findings": f"""WITH f(i, rule, family, score) AS (VALUES {", ".join(map(str, OWN_FOUND))}), e(i, ext) AS (VALUES {", ".join(str((i, e)) for i, e in enumerate(e for e, texts in SCRIPTS.items() for _ in texts))})
        SELECT '/srv/' || doc_id || ext AS path, rule, family, score, 'likely-malicious' AS tier, 'declared' AS admission FROM documents JOIN f ON f.i = doc_id % {sum(map(len, SCRIPTS.values()))} JOIN e ON e.i = f.i""",
    "pass_admission": with_views(("v_file",), f"WITH {SIGNED} " + " UNION ALL ".join(f"SELECT '{n}' AS pass, count(*) AS files FROM signed WHERE {c}" for n, c in _ADMITS.items())),
    "pass_skips": with_views(("v_file",), f"WITH {SIGNED} " + " UNION ALL ".join(f"SELECT path, '{n}' AS pass, strlen(content) AS bytes FROM signed WHERE strlen(content) > 4000 AND {c}" for n, c in _ADMITS.items())),
    "class_compare": "SELECT CASE event_id % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MISMATCH' ELSE 'NO_SOURCE' END AS result, count(*) AS classes FROM events GROUP BY 1",
    "class_clones": "SELECT min(CAST(event_id AS VARCHAR)) AS first_path, count(*) AS files FROM events GROUP BY event_id % 4 = 1 HAVING count(*) > 1",
    "resolved_links": "WITH p(k, path, resolved, problem) AS (VALUES " + ", ".join(f"({k}, '{p}', " + (f"'{r}'" if r else "NULL") + ", " + (f"'{x}'" if x else "NULL") + ")" for k, (p, r, x) in enumerate(_PATHS)) + f") SELECT n_name AS host, path, resolved, problem, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN p ON k = c_custkey % {len(_PATHS)} GROUP BY ALL",
    "java_semantic": f"SELECT '/lib/' || doc_id || '.war' AS path, 'app/Serve' AS class, 'exec' AS sink, 'javadisk:class-request-exec' AS rule, 'GenericJSP' AS family, 85 AS score FROM documents WHERE doc_id % {len(class_bytes.FLOWS)} IN ({', '.join(str(v) for v, flows in class_bytes.FLOWS.items() if flows)})",
    "ssi_taint": "SELECT '/srv/' || doc_id || '.shtml' AS path, CASE doc_id % 5 WHEN 0 THEN 'SSIExec' ELSE 'SSIInclude' END AS family, CASE doc_id % 5 WHEN 0 THEN 'ssitaint:exec-cmd-on-request' ELSE 'ssitaint:include-virtual-on-request' END AS rule, CASE doc_id % 5 WHEN 0 THEN 'a' ELSE 'HTTP_HOST' END AS via, 85 AS score FROM documents WHERE doc_id % 5 IN (0, 1)",
    "java_structural": f"WITH apis(i, feature) AS (VALUES {_apis()}), c AS (SELECT CAST(l_orderkey % 300 AS VARCHAR) AS path, 'C' || (l_orderkey % 5) AS class, 'm' || l_linenumber || '_' || (l_orderkey % 77) AS method, feature FROM lineitem JOIN apis ON i = l_partkey % {len(classfile.APIS)}), m AS (SELECT path, class, method, list(DISTINCT feature) AS f FROM c GROUP BY ALL), hits AS ({_RULES}) SELECT path, class, rule, family, min(method || '()V') AS method, 60 AS score FROM hits GROUP BY path, class, rule, family",
    "discovery_merge": with_views(("v_root",), f"WITH {_MERGED} SELECT host, path, provenance, mechanisms FROM merged"),
    "discovery_subsume": with_views(("v_root",), f"WITH {_SUBSUMED} SELECT host, path, covered_by FROM subsumed"),
    "mechanism_credit": with_views(("v_root",), f"WITH {_SUBSUMED} SELECT host, mechanism, count(DISTINCT root) AS roots FROM (SELECT host, coalesce(covered_by, path) AS root, unnest(string_split(mechanisms, ',')) AS mechanism FROM subsumed) GROUP BY 1, 2"),
    "discovery_gate": with_views(("v_root",), "SELECT DISTINCT CAST(c_custkey % 40 AS VARCHAR) AS host, CASE WHEN CAST(c_custkey % 40 AS VARCHAR) IN (SELECT host FROM v_root) THEN 'ran' ELSE 'failed' END AS status FROM customer"),
    "diagnostic_summary": "WITH e AS (SELECT l_partkey % 50 AS a, l_linenumber % 3 = 0 AS m, l_suppkey % 6 AS c, l_linenumber % 2 AS d, max(greatest(CAST(l_quantity AS BIGINT) - 3, 1)) AS n FROM lineitem GROUP BY ALL) SELECT 'code-' || c AS code, CAST(sum(n) AS BIGINT) AS count FROM e GROUP BY 1",
    "artifact_status": "WITH a AS (SELECT p_partkey AS k, '/a/' || (p_partkey % 9) || '/' || p_partkey || '.class' AS path FROM part) SELECT path, CASE WHEN k % 31 = 0 OR k % 10 = 5 THEN 'failed' WHEN k % 9 = 3 THEN 'degraded' ELSE 'complete' END AS status, concat_ws(',', CASE WHEN k % 10 = 5 THEN 'java-artifact-read-failed' END, CASE WHEN k % 9 = 3 THEN 'slow' END) AS codes FROM a",
    "exact_duplicate_documents": "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
}
