"""The rule library: revisions, selections, exclusions, diffs, closures, facets and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.checkpoints import checkpointed

#: Sets of a block and rules of a task, about, when sets of like layers meet rules.
BLOCK, CHUNK = 256, 4096


def latest_revision(revisions: DataFrame) -> DataFrame:
    """Each rule's highest revision; combined before the shuffle."""
    others = [c for c in revisions.columns if c not in ("rule_id", "revision")]
    return revisions.groupBy("rule_id").agg(F.max("revision").alias("revision"), F.max_by(F.struct(*others), "revision").alias("b")).select("rule_id", "revision", "b.*")


def next_revision(rules: DataFrame, revisions: DataFrame) -> DataFrame:
    last = revisions.groupBy("rule_id").agg(F.max("revision").alias("last"))
    return rules.select("rule_id").join(last, "rule_id", "left").select("rule_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_revision"))


def rule_index(rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """Live rules with their latest revision's number and scores, without texts."""
    return rules.where(~F.col("deleted")).join(latest_revision(revisions).select("rule_id", "revision", "meta_score"), "rule_id").select("rule_id", "identifier", "layer", "source_pack", "score", "revision", "meta_score")


def resolve(selected_layers: DataFrame, selected_rules: DataFrame, exclusions: DataFrame, rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """set_id, rule_id, revision: live rules of a set's layers or names, less its exclusions, at their latest revision.
    selected_layers: set_id, layer; selected_rules: set_id, rule_id."""
    return _dealt(selected_layers, selected_rules, exclusions, checkpointed(_offered(rules, revisions))).select("set_id", "rule_id", "revision")


def resolved_members(selected_layers: DataFrame, selected_rules: DataFrame, exclusions: DataFrame, rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """`frozen_members` of `resolve`: rules get their names and texts once, before they are dealt to sets."""
    offered = checkpointed(frozen_members(_offered(rules, revisions), rules, revisions))
    return _dealt(selected_layers, selected_rules, exclusions, offered).drop("within")


def resolved_counts(selected_layers: DataFrame, selected_rules: DataFrame, exclusions: DataFrame, rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """set_id, rules: the number of rows of `resolve` for each set that has any, without making them: the rules of its layers,
    less exclusions among these, and named rules beyond them."""
    offered = checkpointed(_offered(rules, revisions))
    takers = _takers(selected_layers)
    kinds = offered.groupBy("within").agg(F.count(F.lit(1)).alias("n"))
    met = takers.select("wanted").distinct().join(kinds, F.arrays_overlap("wanted", "within")).groupBy("wanted").agg(F.sum("n").alias("n"))
    by_layer = takers.join(met, "wanted").select("set_id", "n")
    gone = exclusions.select("set_id", "rule_id").distinct().join(offered, "rule_id").join(takers, "set_id").where(F.arrays_overlap("wanted", "within"))
    by_name = _named(selected_rules, exclusions, offered, takers)
    return by_layer.unionAll(gone.select("set_id", F.lit(-1).cast("long"))).unionAll(by_name.select("set_id", F.lit(1).cast("long"))).groupBy("set_id").agg(F.sum("n").alias("rules")).where("rules > 0")


def _offered(rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """rule_id, revision, within: live rules at their latest revision, with their layers as an array."""
    live = rules.where(~F.col("deleted")).groupBy("rule_id").agg(F.sort_array(F.collect_set("layer")).alias("within"))
    return live.join(revisions.groupBy("rule_id").agg(F.max("revision").alias("revision")), "rule_id")


def _takers(selected_layers: DataFrame) -> DataFrame:
    """set_id, wanted: the layers of each set that takes any."""
    return selected_layers.where("layer is not null").groupBy("set_id").agg(F.sort_array(F.collect_set("layer")).alias("wanted"))


def _named(selected_rules: DataFrame, exclusions: DataFrame, offered: DataFrame, takers: DataFrame) -> DataFrame:
    """offered, with set_id: rules that a set names, doesn't exclude and doesn't take by a layer."""
    left = selected_rules.select("set_id", "rule_id").distinct().join(exclusions, ["set_id", "rule_id"], "left_anti").join(offered, "rule_id")
    same = F.col("set_id").eqNullSafe(F.col("taker"))
    return left.join(takers.withColumnRenamed("set_id", "taker"), same & F.arrays_overlap("wanted", "within"), "left_anti")


def _dealt(selected_layers: DataFrame, selected_rules: DataFrame, exclusions: DataFrame, offered: DataFrame) -> DataFrame:
    """offered, with set_id, a row for each set that takes the rule. Chunks of like rules meet blocks of like sets, and a pair is a
    row only when it is final: pairs, by far the most rows, are never shuffled. Within a chunk a block's sets come in one order for
    rule after rule, and a task has few rules, so that what is written of the pairs repeats itself and takes little disk."""
    takers = checkpointed(_takers(selected_layers))
    n = max(1, -(-takers.count() // BLOCK))
    parts = max(offered.sparkSession.sparkContext.defaultParallelism, -(-offered.count() // CHUNK))
    block = lambda s: F.pmod(F.xxhash64(s), F.lit(n)).cast("int")
    sets = F.transform(F.sort_array(F.collect_list(F.struct("set_id"))), lambda x: x["set_id"])
    blocks = takers.groupBy("wanted", block("set_id").alias("block")).agg(sets.alias("sets"))
    blocks = blocks.select("wanted", "block", "sets", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    barred = exclusions.where("set_id is not null").groupBy("rule_id").agg(F.collect_set("set_id").alias("barred"))
    rules = offered.join(barred, "rule_id", "left").withColumn("part", F.pmod(F.xxhash64("rule_id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    met = F.array_distinct(F.transform("barred", block))
    rules = rules.withColumn("barred", F.map_from_arrays(met, F.transform(met, lambda b: F.filter("barred", lambda s: block(s) == b))))
    pairs = blocks.hint("merge").join(rules, (blocks["part"] == rules["part"]) & F.arrays_overlap("wanted", "within"))
    gone = F.col("barred")[F.col("block")]
    by_layer = pairs.select(F.explode(F.when(gone.isNull(), F.col("sets")).otherwise(F.array_except("sets", gone))).alias("set_id"), *offered.columns)
    return by_layer.unionByName(_named(selected_rules, exclusions, offered, takers).select("set_id", *offered.columns))


def frozen_members(frozen: DataFrame, rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """Members of frozen sets (set_id, rule_id, revision) with names and texts; deleted rules stay members."""
    return frozen.join(rules.select("rule_id", "identifier", "layer"), "rule_id").join(revisions, ["rule_id", "revision"])


def rule_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule_id, change: added, removed, changed (another revision) or unchanged."""
    both = before.select("rule_id", F.col("revision").alias("was")).join(after.select("rule_id", F.col("revision").alias("now")), "rule_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return both.select("rule_id", "was", "now", change.alias("change"))


def exclusion_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    key = ["rule_id"]
    return after.join(before, key, "left_anti").select("rule_id", F.lit("added").alias("change")).union(before.join(after, key, "left_anti").select("rule_id", F.lit("removed").alias("change")))


def dependency_closure(references: DataFrame, depth: int = 1 << 20) -> DataFrame:
    """rule_id, depends_on for all rules reachable along references (rule_id, depends_on); a cycle reaches its own members.

    Pairs double their reach in each round until none is new, so rounds grow with the logarithm of the longest chain (at most
    `depth`)."""
    known = checkpointed(references.select("rule_id", "depends_on").distinct())
    n = known.count()
    for _ in range(max(1, (depth - 1).bit_length())):
        further = known.alias("x").join(known.alias("y"), F.col("x.depends_on") == F.col("y.rule_id")).select("x.rule_id", "y.depends_on")
        known = checkpointed(known.union(further).distinct())
        now = known.count()
        if now == n:
            break
        n = now
    return known


def orphaned_by_exclusion(exclusions: DataFrame, references: DataFrame) -> DataFrame:
    """set_id, rule_id of rules that aren't excluded though they need an excluded rule; excluding must then be refused."""
    needed = exclusions.select("set_id", F.col("rule_id").alias("depends_on")).join(references, "depends_on").select("set_id", "rule_id").distinct()
    return needed.join(exclusions, ["set_id", "rule_id"], "left_anti")


def facet_counts(rules: DataFrame, column: str) -> DataFrame:
    return rules.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("(none)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rule_filter(rules: DataFrame, identifier: str = "", description: str = "", layers: tuple = (), packs: tuple = (), least_score: int | None = None) -> DataFrame:
    """All conditions hold; an empty one holds always. A rule without score fails any least score."""
    out = rules
    for column, needle in (("identifier", identifier), ("description", description)):
        if needle.strip():
            out = out.where(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.strip().lower())))
    if layers:
        out = out.where(F.col("layer").isin(*layers))
    if packs:
        out = out.where(F.coalesce("source_pack", F.lit("(none)")).isin(*packs))
    if least_score is not None:
        out = out.where(F.col("score") >= least_score)
    return out


def unjudged_by_score(rules: DataFrame) -> DataFrame:
    """How many rules a least score leaves out for want of one."""
    return rules.agg(F.count_if(F.col("score").isNull()).alias("unjudged"))


def page(rows: DataFrame, size: int, number: int, order: list[Column]) -> DataFrame:
    """A page of rows with their position; the number is moved into the pages there are. One sort, no rank over all rows."""
    total = rows.count()
    last = max(1, -(-total // size))
    at = min(max(1, number), last)
    taken = rows.orderBy(*order).offset((at - 1) * size).limit(size)
    w = Window.orderBy(*order)  # over one page
    return taken.withColumn("position", F.row_number().over(w) + (at - 1) * size)


def meta_coverage(revisions: DataFrame) -> DataFrame:
    """Over the latest revisions: how many there are, lack meta, have a description, have a score."""
    r = latest_revision(revisions)
    return r.agg(F.count(F.lit(1)).alias("revisions"), F.count_if(~F.col("has_meta")).alias("no_meta"), F.count_if("has_description").alias("with_description"), F.count("meta_score").alias("with_score"))


def upsert_exclusions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest wins per set and rule; an exclusion needs a reason."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.where(F.trim("reason") != "").withColumn("_new", F.lit(1)))
    return rows.groupBy("set_id", "rule_id").agg(F.max_by("reason", "_new").alias("reason"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows that conflict: the key is there with another digest)."""
    have = existing.select(key, F.col(digest).alias("_have"))
    joined = incoming.join(have, key, "left")
    return joined.where("_have is null").drop("_have"), joined.where(F.col("_have") != F.col(digest)).drop("_have")


def split_pack(lines: DataFrame) -> DataFrame:
    """pack, rule_no, identifier, body from rule texts with one row per line (pack, pos, line). A rule begins at its head;
    lines before the first one are imports, which every rule of the pack carries."""
    head = r"^\s*(?:(?:private|global)\s+)*rule\s+([A-Za-z_][A-Za-z0-9_]*)"
    w = Window.partitionBy("pack").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = lines.withColumn("rule_no", F.sum(F.col("line").rlike(head).cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    rules = n.where("rule_no > 0").groupBy("pack", "rule_no").agg(F.first(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1)), ignorenulls=True).alias("identifier"), text.alias("body"))
    imports = n.where("rule_no = 0").where(F.col("line").rlike(r"^\s*import\s")).groupBy("pack").agg(text.alias("imports"))
    return rules.join(imports, "pack", "left").select("pack", "rule_no", "identifier", F.concat_ws("\n", "imports", "body").alias("body"))


def rule_meta(rules: DataFrame, body: str = "body") -> DataFrame:
    """rules with meta: map<string,string> of the first meta section, and meta_score where it is a whole number."""
    section = F.regexp_extract(body, r"(?ms)^[ \t]*meta[ \t]*:[ \t]*\n(.*?)(?=^[ \t]*(?:strings|condition|variables)[ \t]*:|\z)", 1)
    entry = r"^[ \t]*([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*(.*?)[ \t]*$"
    lines = F.filter(F.split(section, "\n"), lambda x: x.rlike(entry))
    value = lambda x: F.regexp_replace(F.regexp_extract(x, entry, 2), '^"(.*)"$', "$1")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, entry, 1).alias("key"), value(x).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)  # repeated keys: the first
    out = rules.withColumn("meta", F.map_from_entries(first))
    return out.withColumn("meta_score", F.when(F.col("meta")["score"].rlike(r"^[+-]?[0-9]+$"), F.col("meta")["score"].try_cast("int")))


RULE_HEAD = r"(?m)^[ \t]*(?:(?:private|global)[ \t]+)*rule[ \t]+([A-Za-z_][A-Za-z0-9_]*)"


def rule_identifier(text: Column) -> Column:
    """The name of the one rule that a text declares; null where it declares none or several."""
    names = F.regexp_extract_all(text, F.lit(RULE_HEAD), F.lit(1))
    return F.when(F.size(names) == 1, F.get(names, 0))


def freeze(sets: DataFrame, resolved: DataFrame, frozen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members to add, sets refused) when sets (set_id) are frozen at their resolved revisions. A set that is frozen already,
    or resolves to nothing, is refused; members keep the revision they had, whatever the rules become."""
    done = frozen.select("set_id").distinct()
    some = resolved.select("set_id").distinct()
    ready = sets.select("set_id").distinct().join(done, "set_id", "left_anti").join(some, "set_id", "left_semi")
    refused = sets.select("set_id").distinct().join(ready, "set_id", "left_anti")
    return resolved.join(ready, "set_id", "left_semi").select("set_id", "rule_id", "revision"), refused
