"""Class files by what they do: instruction streams with their constants resolved, whatever the order of pool and members and
whatever debug data stands beside them. Two such streams say whether a class in memory is the one on disk; a digest of one
finds clones.

Fixed values: members that generators leave behind."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.operators.taint import classfile
from vigilspark.operators.taint.classfile import Malformed

# Name markers of generated classes and the member prefix that must stand beside them; superclasses, interfaces
# and the member that the generator writes.
GENERATED_NAMES = (("$$EnhancerBySpringCGLIB$$", "CGLIB$", True), ("$$FastClassBySpringCGLIB$$", "CGLIB$", True), ("$$FastClassByGuice$$", "GUICE$", False), ("$$EnhancerByGuice$$", "GUICE$", False))
GENERATED_PARENTS = (("superclasses", "org.apache.jasper.runtime.HttpJspBase", "_jspService"), ("interfaces", "groovy.lang.GroovyObject", "$getStaticMetaClass"))
_POOLED = {18: 1, 19: 2, 20: 2, **dict.fromkeys((*range(178, 186), 187, 189, 192, 193, 197), 2)}


def _constant(pool: dict, k: int) -> str:
    """A constant as text, with all that it refers to."""
    entry = pool.get(k)
    if entry is None:
        raise Malformed("java-class-malformed: constant")
    tag = entry[0]
    if tag == 1:
        return entry[1]
    if tag in (7, 8, 16, 19, 20):
        return f"{tag}:{_constant(pool, entry[1])}"
    if tag in (9, 10, 11, 12):
        return f"{tag}:{_constant(pool, entry[1])}.{_constant(pool, entry[2])}"
    if tag == 15:
        return f"15:{entry[3][0]}:{_constant(pool, int.from_bytes(entry[3][1:3], 'big'))}"
    if tag in (17, 18):  # the bootstrap method's number is a matter of order
        return f"{tag}:{_constant(pool, entry[2])}"
    return f"{tag}:{entry[3].hex()}"


def method_tokens(code: bytes, pool: dict) -> Iterator[str]:
    """An opcode with its operands for each instruction; jumps by how many instructions they go."""
    steps = list(classfile._instructions(code))
    place = {at: k for k, (at, *_) in enumerate(steps)}
    for k, (at, op, end, targets, _) in enumerate(steps):
        if op == 18:  # one-byte and two-byte loads of a constant differ in the pool's order alone
            yield f"19 {_constant(pool, code[at + 1])}"
        elif op in _POOLED:
            rest = code[at + 3 : end].hex()
            yield f"{op} {_constant(pool, int.from_bytes(code[at + 1 : at + 3], 'big'))} {rest}"
        elif targets:
            yield f"{op} " + " ".join(str(place.get(t, -1) - k) for t in targets)
        else:
            yield f"{op} {code[at + 1 : end].hex()}"


def normal_form(data: bytes) -> list[str]:
    """The class's name and, in the order of their names, its methods with their tokens. Raises Malformed."""
    try:
        pool, this, members = classfile.parse(data)
        out = []
        for flags, name, descriptor, raw in members:
            tokens = list(method_tokens(classfile.body(raw)[0], pool)) if raw is not None else []
            handlers = len(classfile.body(raw)[1]) if raw is not None else 0
            out.append(f"{flags} {name}{descriptor} {handlers}\n" + "\n".join(tokens))
        return [this, *sorted(out)]
    except (struct.error, IndexError, KeyError, TypeError, UnicodeError) as e:
        raise Malformed(f"java-class-malformed: {e}") from e


def digest(data: bytes | None) -> str | None:
    """A digest of the normal form; null for what is no class file."""
    try:
        return None if data is None else hashlib.sha256("\0".join(normal_form(data)).encode("utf-8", "surrogatepass")).hexdigest()
    except Malformed:
        return None


def _digests(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows without the columns of class bytes, and a digest for each of them."""
    kept = [f for f in rows.schema.fields if f.name not in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{name}` string" for name in columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array([digest(v) for v in batch.column(c).to_pylist()], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=[*(f.name for f in kept), *columns.values()])

    return rows.mapInArrow(run, schema)


def compare(pairs: DataFrame, memory: str = "memory", source: str = "source") -> DataFrame:
    """pairs with result: MATCH, MISMATCH, or NO_SOURCE where one side is missing or can't be read, in place of the bytes."""
    rows = _digests(pairs, {memory: "_memory", source: "_source"})
    both = F.col("_memory").isNotNull() & F.col("_source").isNotNull()
    return rows.withColumn("result", F.when(~both, "NO_SOURCE").when(F.col("_memory") == F.col("_source"), "MATCH").otherwise("MISMATCH")).drop("_memory", "_source")


def clone_groups(files: DataFrame, content: str = "content") -> DataFrame:
    """structure, first_path, files: class files that do the same; groups of one and unreadable files are left out."""
    rows = _digests(files.select("path", content), {content: "structure"}).where("structure is not null")
    return rows.groupBy("structure").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("files")).where("files > 1")


def _begins(prefix: str):
    return lambda m: m.startswith(prefix)


def verified_generated(name: Column, members: Column, superclasses: Column, interfaces: Column, proxy: Column, hidden: Column) -> Column:
    """Whether a class is generated by something that can't be forged by its name: the JVM says so, or the generator's own
    members stand beside its name, superclass or interface."""
    out = proxy | hidden
    for marker, prefix, enhanced in GENERATED_NAMES:
        real = F.exists(superclasses, lambda s: s != "java.lang.Object") if enhanced else F.lit(True)
        out = out | (F.contains(name, F.lit(marker)) & real & F.exists(members, _begins(prefix)))
    for where, what, member in GENERATED_PARENTS:
        held = superclasses if where == "superclasses" else interfaces
        out = out | (F.array_contains(held, what) & F.array_contains(members, member))
    return F.coalesce(out, F.lit(False))
