"""Server-side includes, as expressions: directives, their attributes, and a fixpoint over #set.

Fixed values: request variables, sinks, their families and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.classify import admits

MAX_TEXT, SCORE = 2 << 20, 85
SOURCES = ("QUERY_STRING_UNESCAPED", "DOCUMENT_ARGS", "DOCUMENT_PATH_INFO", "QUERY_STRING", "REQUEST_URI", "PATH_INFO", "PATH_TRANSLATED", "CONTENT_TYPE", "CONTENT_LENGTH")
SINKS = (
    ("exec", "cmd", "SSIExec", "ssitaint:exec-cmd-on-request"),
    ("exec", "cgi", "SSIExec", "ssitaint:exec-cgi-on-request"),
    ("include", "virtual", "SSIInclude", "ssitaint:include-virtual-on-request"),
    ("include", "file", "SSIInclude", "ssitaint:include-file-on-request"),
)
_S = r"[\t\n\f\r ]"
_DIRECTIVE = rf"(?is)<!--{_S}*#{_S}*([a-z]+)(.*?)-->"
_ATTRIBUTE = rf"(?is)([a-z_]+){_S}*={_S}*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r ]+))"
_REFERENCE = r"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def directives(text: Column) -> Column:
    """array<struct<name, attrs: map<string,string>>> in order; the first of repeated attributes counts."""

    def attributes(body: Column) -> Column:
        names = F.transform(_all(body, _ATTRIBUTE, 1), lambda n: F.lower(n))
        values = F.zip_with(F.zip_with(_all(body, _ATTRIBUTE, 2), _all(body, _ATTRIBUTE, 3), lambda a, b: F.when(a != "", a).otherwise(b)), _all(body, _ATTRIBUTE, 4), lambda a, b: F.when(a != "", a).otherwise(b))
        pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("key"), v.alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["key"]) == i + 1))

    return F.zip_with(_all(text, _DIRECTIVE, 1), _all(text, _DIRECTIVE, 2), lambda n, b: F.struct(F.lower(n).alias("name"), attributes(b).alias("attrs")))


def _reaches(value: Column, tainted: Column) -> Column:
    """The first reference in a value that carries request data; null without one."""
    hit = F.filter(_all(F.coalesce(value, F.lit("")), _REFERENCE, 1), lambda r: r.isin(*SOURCES) | r.startswith("HTTP_") | F.array_contains(tainted, r))
    return F.get(hit, 0)


def admitted(files: DataFrame) -> DataFrame:
    return files.where(admits(F.col("path"), F.col("text"), ("shtml",)))


def findings(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, family, rule, via, score: per file and family the first sink that request data reaches."""
    out = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where((F.octet_length("text") <= MAX_TEXT) & F.contains("text", F.lit("<!--")))
    out = out.withColumn("d", directives(F.col("text"))).where(F.size("d") > 0).drop("text")
    sets = F.filter("d", lambda d: (d["name"] == "set") & (F.coalesce(d["attrs"]["var"], F.lit("")) != ""))
    out = out.withColumn("sets", sets)
    empty = F.array().cast("array<string>")

    def grow(known: Column, d: Column) -> Column:
        name = d["attrs"]["var"]
        new = ~F.array_contains(known, name) & _reaches(d["attrs"]["value"], known).isNotNull()
        return F.when(new, F.concat(known, F.array(name))).otherwise(known)

    rounds = F.sequence(F.lit(0), F.size("sets"))
    out = out.withColumn("tainted", F.aggregate(rounds, empty, lambda known, _: F.aggregate("sets", known, grow)))

    def hits(d: Column) -> Column:
        arms = []
        for directive, attribute, family, rule in SINKS:
            via = _reaches(d["attrs"][attribute], F.col("tainted"))
            arms.append(F.when((d["name"] == directive) & d["attrs"][attribute].isNotNull() & via.isNotNull(), F.struct(F.lit(family).alias("family"), F.lit(rule).alias("rule"), via.alias("via"))))
        return F.array_compact(F.array(*arms))

    out = out.withColumn("hits", F.flatten(F.transform("d", hits)))
    of = lambda family: F.filter("hits", lambda h: h["family"] == family)
    first = [F.get(of(f), 0) for f in sorted({s[2] for s in SINKS})]
    return out.select("path", F.explode(F.array_compact(F.array(*first))).alias("h")).select("path", "h.*", F.lit(SCORE).alias("score"))
