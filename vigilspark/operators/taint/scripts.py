"""Script passes: JSP and Java source; and all of them together, with PHP, ASP, Perl and Python CGI and server-side includes.

Each reads one file: it splits it into statements, lists which names take which values, spreads taint, and reports the sinks
that request data reaches. Fixed values: request sources, sinks, rules, families and scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.classify import admits
from vigilspark.operators.taint import asp, cgi, php, ssi
from vigilspark.operators.taint.flow import Found, Step, over_limit, pattern, run_pass, spread

I, M, S = re.I, re.M, re.S
MAX_TEXT, MAX_PHP = 2 << 20, 1 << 20

NAME = pattern(r"\b([A-Za-z_]\w*)\b")


def names(text: str) -> frozenset[str]:
    return frozenset(NAME.findall(text))


def asp_findings(files: DataFrame) -> DataFrame:
    return run_pass(asp_files(files), lambda text, _: asp.analyse(text), hint=r"(?i)request")


def asp_files(files: DataFrame) -> DataFrame:
    return files.where(admits(F.col("path"), F.col("text"), ("asp", "aspx")))


# -- JSP and Java source ------------------------------------------------------------------------

JAVA_SOURCE = pattern(r"\brequest\s*\.\s*(?:getparameter\w*|getheader\w*|getinputstream|getreader|getquerystring|getcookies|getpart\w*|getrequesturi|getpathinfo)\s*\(|pagecontext\s*\.\s*getrequest\s*\(|\$\{\s*(?:param|header|cookie)", I)
JAVA_ASSIGN = pattern(r"(?:^|[\s(])(?:final\s+)?(?:[a-z_$][\w$.<>\[\],? ]*\s+)?([a-z_$][\w$]*)\s*(?:\[[^\]]*\]\s*)?\+?=(?!=)(.*)$", I | S)
JAVA_EXEC = pattern(r"\.\s*exec\s*\((.*)|new\s+(?:[\w.]+\.)?processbuilder\s*\((.*)|\.\s*command\s*\((.*)", I | S)
JAVA_SINKS = (
    ("javadisk:dynamic-classload", "DynamicClassload", 85, pattern(r"\.?\s*defineclass\s*\((.*)", I | S)),
    ("javadisk:scriptengine-eval", "ScriptEngine", 75, pattern(r"(?:engine\w*|script\w*|shell|parser\w*|ognl\w*)\s*\.\s*(?:eval|evaluate|parseexpression|getvalue)\s*\((.*)", I | S)),
    ("javadisk:reflection-invoke", "Reflection", 75, pattern(r"\.\s*invoke\s*\((.*)", I | S)),
)
JAVA_WRITE = pattern(r"(?:new\s+(?:[\w.]+\.)?(?:fileoutputstream|filewriter|printwriter|randomaccessfile)\s*\(|files\s*\.\s*write\s*\(|\.\s*write\s*\()(.*)", I | S)
JAVA_DESERIAL = pattern(r"\.\s*readobject\s*\(|new\s+(?:[\w.]+\.)?initialcontext\s*\([^)]*\)\s*\.\s*lookup\s*\(|\blookup\s*\(\s*\"(?:rmi|ldap|ldaps|iiop)://", I)
JAVA_HOOK = pattern(r"\.\s*(?:addfilter|addservlet|addlistener|addfilterdef|addfiltermapbefore|addapplicationeventlistener|registermapping|addinterceptor|addvalve)\s*\(", I)
REVERSE_SHELL = pattern(r"/dev/tcp/|bash\s+-i|nc\s+-e|powershell\s+-(?:nop|enc)", I)
WEB_TARGET = pattern(r"\.(?:jsp|jspx|jspf|class|jar|war)\b|getrealpath|webapps|web-inf", I)


def java_text(text: str, path: str) -> str:
    """Code of a page or source file: comments out, escapes undone, markup dropped."""
    text = re.sub(r"\\u+([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    if re.search(r"(?i)\.jspx?f?$|\.jsp\b", path):
        text = re.sub(r"(?s)<%--.*?--%>", "", text)
        blocks = re.findall(r"(?s)<%(?![@-])[!=]?(.*?)(?:%>|\Z)", text) + re.findall(r"(?is)<jsp:(?:scriptlet|declaration|expression)\s*>(.*?)</jsp:", text)
        text = ";\n".join(re.sub(r"(?s)<!\[CDATA\[(.*?)\]\]>", r"\1", b) for b in blocks) if blocks else text
    return re.sub(r"(?s)(\"(?:[^\"\\\n]|\\.)*\")|/\*.*?\*/|//[^\n]*", lambda m: m[1] or " ", text)


def analyse_java(text: str, row: dict) -> Found:
    jsp = language_name(row["path"]) == "jsp"
    statements = [s.strip() for s in re.findall(r'(?:"(?:[^"\\\n]|\\.)*"|[^;{}"]|")+', java_text(text, row["path"])) if s.strip()]
    bare = lambda t: names(re.sub(r'"(?:[^"\\\n]|\\.)*"', "", t))
    steps = [Step((m[1],), bare(m[2]), bool(JAVA_SOURCE.search(m[2]))) for s in statements if (m := JAVA_ASSIGN.search(s))]
    tainted = spread(steps)
    reached = lambda t: bool(JAVA_SOURCE.search(t)) or bool(bare(t) & tainted)
    argument = lambda m: next((g for g in m.groups() if g is not None), "")
    execs = [argument(m) for s in statements if (m := JAVA_EXEC.search(s))]
    if any(map(reached, execs)):
        yield "javadisk:request-exec", "GenericJSP", 85, "request data reaches a process start"
    elif any(REVERSE_SHELL.search(a) for a in execs):
        yield "javadisk:reverse-shell-literal", "GenericJSP", 40, "a process start holds a reverse-shell command"
    whole = "\n".join(statements)
    if any(reached(m[1]) for s in statements if (m := JAVA_WRITE.search(s))) and WEB_TARGET.search(whole):
        yield "javadisk:file-drop-on-request", "FileDrop", 85, "request data is written to an executable path"
    for rule, family, score, shape in JAVA_SINKS:
        hits = [m[1] for s in statements if (m := shape.search(s))]
        if any(map(reached, hits)):
            yield rule, family, score, "request data reaches it"
        elif hits and rule == "javadisk:dynamic-classload" and re.search(r"(?i)base64|cafebabe|yv66vg", whole):
            yield rule, family, 75, "encoded class bytes are defined"
    if JAVA_DESERIAL.search(whole) and (jsp or JAVA_SOURCE.search(whole)):
        yield "javadisk:deserialization-jndi", "DeserializationJNDI", 60, "deserialisation or a remote lookup"
    if jsp and JAVA_HOOK.search(whole):
        yield "javadisk:servlet-hook-registration", "MemshellDropper", 60, "a page registers server components"


def language_name(path: str) -> str:
    """The language of a file name on the Python side, from the same table as the column function."""
    from vigilspark.functions.tables import LANGUAGE_OF, WEB_SOURCE

    suffixes = path.rstrip("/").rsplit("/", 1)[-1].lower().lstrip(".").split(".")[1:][::-1]
    known = [LANGUAGE_OF.get(s) for s in suffixes]
    return next((lang for i, lang in enumerate(known) if lang and (i == 0 or lang in WEB_SOURCE)), "unknown")


def java_findings(files: DataFrame) -> DataFrame:
    return run_pass(java_files(files), analyse_java, hint=r"(?i)exec|processbuilder|command|defineclass|eval|invoke|write|outputstream|readobject|lookup|add[a-z]+\s*\(|register|parseexpression|getvalue|\\u")


def java_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").endswith(".java") | admits(F.col("path"), F.col("text"), ("jsp",)))


# -- PHP ----------------------------------------------------------------------------------------


def php_findings(files: DataFrame) -> DataFrame:
    return run_pass(php_files(files), lambda text, _: php.analyse(text), most=MAX_PHP, hint=r"\$|`")


def php_files(files: DataFrame) -> DataFrame:
    return files.where(admits(F.col("path"), F.col("text"), ("php",)))


#: The files that each pass examines, and the size beyond which it doesn't.
ADMITTED = {"php": php_files, "cgi": cgi.admitted, "asp": asp_files, "ssi": ssi.admitted, "java": java_files}
LIMITS = {"php": MAX_PHP, "cgi": MAX_TEXT, "asp": MAX_TEXT, "ssi": ssi.MAX_TEXT, "java": MAX_TEXT}


def skipped(files: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """path, pass, bytes, reason: files that a pass admits but does not read, as they are over its limit. A scan with any of
    these is not complete."""
    out = None
    for name, most in limits.items():
        rows = over_limit(ADMITTED[name](files), name, most)
        out = rows if out is None else out.unionByName(rows)
    return out


def all_findings(files: DataFrame) -> DataFrame:
    """All script passes over files (path, text) as findings of the fusion stage's shape; source_ord is the passes' order."""
    from vigilspark.functions.classify import tier_of_score

    parts = [(php_findings(files), "heuristic", 2), (cgi.findings(files), "taint", 3), (asp_findings(files), "taint", 4), (ssi.findings(ssi.admitted(files)).withColumn("evidence", F.concat(F.lit("carried by "), "via")), "taint", 5), (java_findings(files), "heuristic", 6)]
    out = None
    for part, basis, order in parts:
        rows = part.select("path", F.col("rule").alias("knowledge_ref"), "family", "score", "evidence", F.lit(basis).alias("basis"), F.lit(order).alias("source_ord"), tier_of_score(F.col("score")).alias("tier"))
        out = rows if out is None else out.unionByName(rows)
    return out
