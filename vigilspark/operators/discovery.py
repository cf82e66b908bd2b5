"""Webroots from configuration text, process tables and conventions; merging, nesting and credit; Java diagnostics.

Fixed values: directives, properties and directories that name roots, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.checkpoints import checkpointed
from vigilspark.functions.tables import PROVENANCE_RANK, STATUS_RANK, rank

MAX_LISTED = 100
#: Diagnostic codes are a fixed vocabulary; a table with more is refused, as their set travels with every task.
MOST_CODES = 1000
_S = r"[\t\n\f\r ]"
IIS_PATH = r"physicalPath=\"([^\"]+)\""
APACHE_ROOT = r"(?im)^[ \t]*DocumentRoot[ \t]+\"?([^\"#\n\r]+?)\"?[ \t]*(?:#.*)?$"
NGINX_ROOT = r"(?im)^[ \t]*root[ \t]+\"?([^\";#\n\r]+?)\"?[ \t]*;"
APACHE_DUMP = r"(?m)^[\t\n\f\r ]*Main DocumentRoot:[\t\n\f\r ]*\"?([^\"\r\n]+?)\"?[\t\n\f\r ]*$"
TOMCAT_HOST = r"(?i)<Host\b[^>]*\bappBase[ \t]*=[ \t]*\"([^\"]+)\""
TOMCAT_CONTEXT = r"(?i)<Context\b[^>]*\bdocBase[ \t]*=[ \t]*\"([^\"]+)\""
TOMCAT_PROPERTY = r"(?:^|\s)-Dcatalina\.(?:base|home)=(\S+)"
TOMCAT_VARIABLE = r"(?m)^CATALINA_(?:BASE|HOME)=(.+)$"
SERVER_PROPERTY = r"(?:^|\s)-D(?:jboss\.home\.dir|jboss\.server\.base\.dir|jboss\.server\.home\.dir|weblogic\.RootDirectory|domain\.home|weblogic\.home|server\.root|was\.install\.root|user\.install\.root)=(\S+)"
#: Folders below an application server's base that deployments stand in.
DEPLOYMENTS = ("standalone/deployments", "deployments", "domain/servers/*/data/content", "server/*/deploy", "autodeploy", "servers/*/stage", "servers/*/tmp/_WL_user", "applications", "installedApps", "installableApps", "apps", "dropins")
SERVER_BASES = ("/usr/local/tomcat", "/var/lib/tomcat[0-9]*", "/opt/bitnami/tomcat", "/opt/jboss/wildfly", "/u01/oracle/user_projects/domains/*", "/opt/ibm/wlp/usr/servers/*", "/opt/ol/wlp/usr/servers/*", "/opt/IBM/WebSphere/AppServer/profiles/*")
CONVENTIONS = ("/var/www/html", "/var/www", "/srv/www", "/srv/http", "/usr/share/nginx/html")
MECHANISMS = {
    "iis-config": IIS_PATH, "apache-config": APACHE_ROOT, "nginx-config": NGINX_ROOT, "apache-dump": APACHE_DUMP, "nginx-dump": NGINX_ROOT, "tomcat-env": TOMCAT_VARIABLE,
    "tomcat-process": TOMCAT_PROPERTY, "tomcat-server-xml": TOMCAT_HOST, "tomcat-context": TOMCAT_CONTEXT, "appserver-process": SERVER_PROPERTY,
}
BY_CONVENTION = ("convention", "iis-default", "tomcat-convention", "appserver-convention")


def provenance_of(mechanism: Column) -> Column:
    """What an operator names beats what a configuration says, which beats a guess."""
    return F.when(mechanism == "explicit", "explicit").when(mechanism.isin(*BY_CONVENTION), "convention").when(mechanism != "", "config").otherwise("")


def clean_path(path: Column) -> Column:
    """Slashes doubled or at the end and single dots out."""
    out = F.regexp_replace(path, r"/(?:\./)+", "/")
    out = F.regexp_replace(out, "/{2,}", "/")
    return F.when(out == "/", out).otherwise(F.regexp_replace(out, "/+$", ""))


def proposals(configs: DataFrame) -> DataFrame:
    """host, mechanism, provenance, path from texts (host, mechanism, text); mechanisms without a pattern propose nothing.
    Of IIS's variables the system drive is expanded."""
    found = F.lit(None).cast("array<string>")
    for name, pattern in MECHANISMS.items():
        text = F.regexp_replace("text", r"(?i)%SystemDrive%", "C:") if name == "iis-config" else F.col("text")
        found = F.when(F.col("mechanism") == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(found)
    rows = configs.withColumn("path", F.explode(found))
    return rows.select("host", "mechanism", provenance_of(F.col("mechanism")).alias("provenance"), clean_path(F.trim("path")).alias("path")).where("path <> ''")


def deployments(bases: DataFrame, listing: DataFrame) -> DataFrame:
    """host, mechanism, provenance, path: folders of a listing (host, path) that stand below an application server's base
    (host, path, mechanism) where deployments do; a star is any one name."""
    up = F.explode(F.transform(F.array(*map(F.lit, DEPLOYMENTS)), lambda x: F.struct(x.alias("tail"), F.size(F.split(x, "/")).alias("n"))))
    split = listing.select("host", F.col("path").alias("found"), F.split("path", "/").alias("_p")).withColumn("_t", up)
    split = split.where("size(_p) > _t.n").withColumn("path", F.expr("array_join(slice(_p, 1, size(_p) - _t.n), '/')")).withColumn("_end", F.expr("array_join(slice(_p, size(_p) - _t.n + 1, _t.n), '/')"))
    fits = split.where(F.regexp(F.col("_end"), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("_t.tail", r"\.", "[.]"), r"\*", "[^/]+"), F.lit("$"))))
    hit = bases.join(fits.select("host", "path", "found"), ["host", "path"])
    return hit.select("host", "mechanism", provenance_of(F.col("mechanism")).alias("provenance"), F.col("found").alias("path")).distinct()


def conventional(hosts: DataFrame) -> DataFrame:
    return hosts.select("host", F.lit("convention").alias("mechanism"), F.lit("convention").alias("provenance"), F.explode(F.array(*map(F.lit, CONVENTIONS))).alias("path"))


def refuse(proposed: DataFrame, mechanisms: list[str]) -> DataFrame:
    return proposed.where(~F.col("mechanism").isin(*mechanisms)) if mechanisms else proposed


def with_explicit(proposed: DataFrame, explicit: DataFrame) -> DataFrame:
    """Where an operator names roots for a host, those alone count."""
    return proposed.join(explicit.select("host").distinct(), "host", "left_anti").unionByName(explicit.select("host", F.lit("explicit").alias("mechanism"), F.lit("explicit").alias("provenance"), "path"))


def merge(proposed: DataFrame) -> DataFrame:
    """One row per host and path: the most specific provenance and all mechanisms."""
    r = rank("provenance", PROVENANCE_RANK)
    return proposed.groupBy("host", "path").agg(F.max_by("provenance", r).alias("provenance"), F.array_sort(F.collect_set("mechanism")).alias("mechanisms"))


def subsume(merged: DataFrame) -> DataFrame:
    """Roots with covered_by: the outermost other root of the host that holds them, else null. Each root meets its ancestors
    by equality on their paths, so no pair of unrelated roots is formed."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    up = merged.select("host", "path", F.explode(F.filter(ancestors, lambda a: a != F.col("path"))).alias("above"))
    held = up.join(merged.select("host", F.col("path").alias("above")), ["host", "above"], "left_semi")
    outer = held.groupBy("host", "path").agg(F.min_by("above", F.length("above")).alias("covered_by"))
    return merged.join(outer, ["host", "path"], "left")


def credit(subsumed: DataFrame) -> DataFrame:
    """host, mechanism, roots: surviving roots that each mechanism named, itself or below them."""
    survivor = F.coalesce("covered_by", "path")
    return subsumed.select("host", survivor.alias("root"), F.explode("mechanisms").alias("mechanism")).groupBy("host", "mechanism").agg(F.count_distinct("root").alias("roots"))


def listed(rows: DataFrame, most: int = MAX_LISTED) -> DataFrame:
    """Per host a bounded list of roots and how many there are."""
    g = rows.where("covered_by is null").groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("all"))
    return g.select("host", F.slice("all", 1, most).alias("roots"), F.size("all").alias("total"))


def gate(hosts: DataFrame, roots: DataFrame) -> DataFrame:
    """A host without any root is a failed disk view, never a clean one."""
    n = roots.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return hosts.join(n, "host", "left").select("host", F.when(F.coalesce("n", F.lit(0)) == 0, "failed").otherwise("ran").alias("status"))


MAX_HOPS = 40


def resolve_links(paths: DataFrame, links: DataFrame) -> DataFrame:
    """paths (host, path) with resolved and problem, as the scanned file system would resolve them, its root being the
    host's: links (host, path, target) are followed from the left, relative targets from their directory, absolute ones from
    the root. A path that leaves the root or goes through more than MAX_HOPS links has no resolved path but a problem.

    Every round follows one link of every path that still has one, by a join on the path's beginnings; there are as many
    rounds as the longest chain has links. A path that comes back to what it was before goes round for ever."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    targets = links.select(F.col("host").alias("_h"), F.concat(F.lit("/"), F.array_join(parts("path"), "/")).alias("_link"), F.col("target").alias("_target")).groupBy("_h", "_link").agg(F.min("_target").alias("_target"))

    def cleaned(done: Column, todo: Column) -> Column:
        """Takes components over to the done ones; a step above the root leaves null."""
        step = lambda kept, p: F.when(p != "..", F.array_append(kept, p)).when(F.size(kept) > 0, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        return F.aggregate(todo, done, step)

    empty = F.array().cast("array<string>")
    rows = checkpointed(paths.select("host", "path", parts("path").alias("todo"), F.lit(None).cast("string").alias("problem"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("seen"), F.monotonically_increasing_id().alias("_row")))
    for hop in range(MAX_HOPS + 1):
        open_ = rows.where("not done")
        # what stands before the first link: beginnings whose components are all plain
        at = open_.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.size("todo"), F.lit(1)))))
        at = at.withColumn("_begin", cleaned(empty, F.slice("todo", 1, F.col("_n")))).withColumn("_named", F.concat(F.lit("/"), F.array_join("_begin", "/")))
        hit = at.where((F.col("_begin").isNotNull()) & (F.get("todo", F.col("_n") - 1) != "..")).join(targets, (F.col("host") == F.col("_h")) & (F.col("_named") == F.col("_link")))
        first = hit.groupBy("_row").agg(F.min(F.struct("_n", "_target", "_begin")).alias("f"))
        joined = open_.join(first, "_row", "left")
        escaped = F.exists(F.sequence(F.lit(1), F.greatest(F.coalesce("f._n", F.size("todo")), F.lit(1))), lambda n: cleaned(empty, F.slice("todo", 1, n)).isNull())
        parent = F.slice(F.col("f._begin"), 1, F.greatest(F.size("f._begin") - 1, F.lit(0)))
        base = F.when(F.col("f._target").startswith("/"), empty).otherwise(parent)
        rest = F.slice("todo", F.coalesce("f._n", F.lit(0)) + 1, F.size("todo") + 1)
        now = F.array_join("todo", "/")
        again = F.array_contains("seen", now) | F.lit(hop == MAX_HOPS)
        problem = F.when(escaped, "escapes the root").when(F.col("f").isNotNull() & again, "too many links")
        todo = F.when(F.col("f").isNull(), cleaned(empty, F.col("todo"))).otherwise(F.concat(base, parts("f._target"), rest))
        after = joined.select("host", "path", todo.alias("todo"), problem.alias("problem"), (problem.isNotNull() | F.col("f").isNull()).alias("done"), F.array_append("seen", now).alias("seen"), "_row")
        rows = checkpointed(rows.where("done").unionByName(after))
        if rows.where("not done").isEmpty():
            break
    resolved = F.when(F.col("problem").isNull(), F.concat(F.lit("/"), F.array_join("todo", "/")))
    return rows.select("host", "path", resolved.alias("resolved"), "problem")


# -- Java diagnostics -------------------------------------------------------------------------------


def diagnostic_summary(diagnostics: DataFrame) -> DataFrame:
    """code, count: repeats of a diagnostic count by their largest count, then codes add up (and stop at the largest long)."""
    each = diagnostics.groupBy("artifact", "code", "detail").agg(F.max(F.greatest(F.col("count"), F.lit(1)).cast("decimal(38,0)")).alias("n"))
    total = each.groupBy("code").agg(F.sum("n").alias("n"))
    return total.select("code", F.least(F.col("n"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("count"))


def artifact_status(artifacts: DataFrame, diagnostics: DataFrame, failing: tuple[str, ...] = ("java-artifact-read-failed",)) -> DataFrame:
    """path, status, codes for artifacts (path, read_ok) under diagnostics (artifact, code, count).

    A diagnostic concerns the artifact it names; one about a directory all artifacts below; one that names neither, or counts
    several occurrences, all of them. Artifacts that it doesn't name are softened to degraded."""
    implied = F.when(F.col("code").isin(*failing), "failed").otherwise("degraded")
    d = diagnostics.select(F.substring_index("artifact", "!/", 1).alias("named"), F.contains("artifact", F.lit("!/")).alias("member"), "code", F.greatest("count", F.lit(1)).alias("n"), implied.alias("implied"))
    own = artifacts.select("path").distinct()
    archive = F.lower("named").rlike(r"\.(?:jar|war)$")
    known = d.join(own.withColumn("_known", F.lit(True)), F.col("named") == F.col("path"), "left").drop("path").withColumn("_known", F.coalesce("_known", F.lit(False)))
    exact = known.where(F.col("_known") & ((F.col("n") == 1) | F.col("member") | archive)).select(F.col("named").alias("path"), "code", "implied")
    rest = known.where(~(F.col("_known") & ((F.col("n") == 1) | F.col("member") | archive)))
    below = artifacts.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("named")).where("named <> path and named <> ''").distinct()
    directories = below.select("named").distinct().withColumn("_dir", F.lit(True))
    rest = rest.join(directories, "named", "left").withColumn("_dir", F.coalesce("_dir", F.lit(False)) & ~F.col("_known") & (F.col("n") == 1) & (F.col("named") != ""))
    under = rest.where("_dir").join(below, "named").select("path", "code", F.lit("degraded").alias("implied"))
    # what concerns every artifact: a few codes, joined as one small list
    everywhere = rest.where("not _dir").agg(F.collect_set("code").alias("_codes"))
    few = F.size("_codes") <= MOST_CODES
    everywhere = everywhere.select(F.when(few, F.col("_codes")).otherwise(F.raise_error(F.lit(f"more than {MOST_CODES} diagnostic codes"))).alias("_codes"))
    named_rest = rest.where("not _dir and _known").select(F.col("named").alias("path"), "code", "implied")
    hits = exact.unionByName(under).unionByName(named_rest).groupBy("path").agg(F.max(rank("implied", STATUS_RANK)).alias("_r"), F.collect_set("code").alias("_own"))
    out = artifacts.join(hits, "path", "left").join(F.broadcast(everywhere), F.lit(True))
    codes = F.array_sort(F.array_union(F.coalesce("_own", F.array().cast("array<string>")), F.col("_codes")))
    r = F.greatest(F.coalesce("_r", F.lit(0)), F.when(F.size("_codes") > 0, 1).otherwise(0), F.when(~F.col("read_ok"), 2).otherwise(0))
    return out.select("path", F.when(r == 2, "failed").when(r == 1, "degraded").otherwise("complete").alias("status"), codes.alias("codes"))
