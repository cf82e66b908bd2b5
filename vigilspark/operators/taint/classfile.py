"""Java class files: constant pool, methods and their calls as rows; structural rules as a join with an API table.

Fixed values: constant-pool tags, instruction widths, API names, rules and score."""

from __future__ import annotations

import io
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.tables import literal_map
from vigilspark.operators.taint import archive

SCORE = 60
MAX_CLASS, MAX_DEPTH, MAX_RATIO, MAX_MEMBERS, MAX_TOTAL = 8 << 20, 2, 200, 20_000, 256 << 20
RATIO_FLOOR = 1 << 20
CALLS = "path string, artifact string, class string, method string, owner string, name string, descriptor string"
_FIXED = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
#: Operand bytes of instructions; the others have none. Switches and wide are read apart.
_OPERANDS = {**dict.fromkeys((16, 18, *range(21, 26), *range(54, 59), 169, 188), 1), **dict.fromkeys((17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199), 2), 197: 3, **dict.fromkeys((185, 186, 200, 201), 4)}

#: (owner, name) → feature; an owner of * is any.
APIS = {
    ("javax/servlet/ServletRequest", "getParameter"): "request", ("javax/servlet/http/HttpServletRequest", "getParameter"): "request", ("javax/servlet/http/HttpServletRequest", "getHeader"): "request",
    ("javax/servlet/http/HttpServletRequest", "getInputStream"): "request", ("javax/servlet/http/HttpServletRequest", "getReader"): "request", ("jakarta/servlet/http/HttpServletRequest", "getParameter"): "request",
    ("jakarta/servlet/ServletRequest", "getParameter"): "request", ("jakarta/servlet/http/HttpServletRequest", "getHeader"): "request",
    ("java/lang/Runtime", "exec"): "exec", ("java/lang/ProcessBuilder", "start"): "exec", ("java/lang/ProcessBuilder", "<init>"): "exec",
    ("java/lang/ClassLoader", "defineClass"): "dynamic_load", ("java/lang/invoke/MethodHandles$Lookup", "defineClass"): "dynamic_load", ("java/net/URLClassLoader", "<init>"): "dynamic_load",
    ("java/util/Base64$Decoder", "decode"): "decode", ("sun/misc/BASE64Decoder", "decodeBuffer"): "decode", ("javax/crypto/Cipher", "doFinal"): "decode", ("java/util/zip/GZIPInputStream", "<init>"): "decode",
    ("javax/script/ScriptEngine", "eval"): "script_eval", ("groovy/lang/GroovyShell", "evaluate"): "script_eval", ("ognl/Ognl", "getValue"): "script_eval",
    ("javax/servlet/ServletContext", "addFilter"): "hook", ("javax/servlet/ServletContext", "addServlet"): "hook", ("javax/servlet/ServletContext", "addListener"): "hook", ("jakarta/servlet/ServletContext", "addFilter"): "hook",
    ("org/apache/catalina/core/StandardContext", "addFilterDef"): "hook", ("org/apache/catalina/core/StandardContext", "addApplicationEventListener"): "hook", ("org/apache/catalina/Pipeline", "addValve"): "hook",
}
#: rule, family, features that one method must show.
RULES = (
    ("javadisk:class-request-exec-structure", "GenericJSP", ("request", "exec")),
    ("javadisk:class-dynamic-load-structure", "DynamicClassload", ("dynamic_load", "decode")),
    ("javadisk:class-script-eval-structure", "ScriptEngine", ("request", "script_eval")),
    ("javadisk:class-hook-registration-structure", "MemshellDropper", ("hook",)),
)


class Malformed(ValueError):
    """A class file or archive that can't be read; carries the diagnostic's code."""


def modified_utf8(raw: bytes) -> str:
    """The pool's string form: NUL as two bytes, supplementary characters as surrogate pairs."""
    return raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse(data: bytes) -> tuple[dict[int, tuple], str, list[tuple[int, str, str, bytes | None]]]:
    """(constant pool, class name, [(flags, method, descriptor, Code attribute or None)]) of a class file."""
    s = io.BytesIO(data)

    def u(n: int) -> int:
        raw = s.read(n)
        if len(raw) < n:
            raise struct.error("it ends early")
        return int.from_bytes(raw, "big")

    if u(4) != 0xCAFEBABE:
        raise Malformed("java-class-malformed: magic")
    u(4)
    pool: dict[int, tuple] = {}
    i, n = 1, u(2)
    while i < n:
        tag = u(1)
        if tag == 1:
            pool[i] = (1, modified_utf8(s.read(u(2))))
        elif tag in _FIXED:
            raw = s.read(_FIXED[tag])
            pool[i] = (tag, int.from_bytes(raw[:2], "big"), int.from_bytes(raw[2:4], "big"), raw)
        else:
            raise Malformed(f"java-class-malformed: tag {tag}")
        i += 2 if tag in (5, 6) else 1
    u(2)
    this = pool[pool[u(2)][1]][1]
    u(2)
    for _ in range(u(2)):
        u(2)
    members = []
    for kind in ("fields", "methods"):
        for _ in range(u(2)):
            flags, name, descriptor, code = u(2), pool[u(2)][1], pool[u(2)][1], None
            for _ in range(u(2)):
                attribute, size = pool[u(2)][1], u(4)
                raw = s.read(size)
                if len(raw) < size:
                    raise struct.error("an attribute ends early")
                code = raw if attribute == "Code" else code
            if kind == "methods":
                members.append((flags, name, descriptor, code))
    return pool, this, members


def body(raw: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    """(instructions, exception handlers) of a Code attribute."""
    size = struct.unpack(">I", raw[4:8])[0]
    table = raw[8 + size :]
    rows = struct.unpack(">H", table[:2])[0]
    return raw[8 : 8 + size], [struct.unpack(">HHH", table[2 + 8 * k : 8 + 8 * k]) for k in range(rows)]


def read_class(data: bytes) -> tuple[str, list[tuple[str, str, str, str]]]:
    """(class name, [(method, owner, name, descriptor) of every call that control can reach])."""
    try:
        pool, this, members = parse(data)
        text = lambda k: pool[k][1]
        class_name = lambda k: text(pool[k][1])
        return this, [(name + descriptor, *call) for _, name, descriptor, raw in members if raw is not None for call in _invoked(*body(raw), pool, text, class_name)]
    except (struct.error, IndexError, KeyError, TypeError, UnicodeError) as e:
        raise Malformed(f"java-class-malformed: {e}") from e


def _instructions(code: bytes) -> Iterator[tuple[int, int, int, list[int], bool]]:
    """(offset, opcode, end, branch targets, whether the next instruction follows) of a method's code."""
    at = 0
    short = lambda k: struct.unpack(">h", code[k : k + 2])[0]
    long = lambda k: struct.unpack(">i", code[k : k + 4])[0]
    while at < len(code):
        op, targets = code[at], []
        if op in (170, 171):
            base = at + 4 - at % 4
            n = long(base + 8) - long(base + 4) + 1 if op == 170 else long(base + 4)
            if not 0 <= n <= len(code):
                raise Malformed("java-class-malformed: switch")
            first, width = (base + 12, 4) if op == 170 else (base + 12, 8)
            targets = [at + long(base), *(at + long(first + width * k) for k in range(n))]
            end = base + (12 + 4 * n if op == 170 else 8 + 8 * n)
        elif op == 196:
            end = at + (6 if code[at + 1] == 132 else 4)
        else:
            end = at + 1 + _OPERANDS.get(op, 0)
            if 153 <= op <= 168 or op in (198, 199):
                targets = [at + short(at + 1)]
            elif op in (200, 201):
                targets = [at + long(at + 1)]
        yield at, op, end, targets, op not in (167, 169, 170, 171, 172, 173, 174, 175, 176, 177, 191, 200)
        at = end


def reachable(code: bytes, handlers: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(offset, opcode) of the instructions that control can reach from the method's start; handlers (from, to, at) are
    reached from within their range."""
    flow = {at: (op, [*targets, *([end] if falls else [])]) for at, op, end, targets, falls in _instructions(code)}
    seen: set[int] = set()
    waiting = [0] if flow else []
    while waiting:
        at = waiting.pop()
        if at in seen or at not in flow:
            continue
        seen.add(at)
        waiting += flow[at][1]
        waiting += [h for a, b, h in handlers if a <= at < b]
    return [(at, flow[at][0]) for at in sorted(seen)]


def _invoked(code: bytes, handlers: list[tuple[int, int, int]], pool: dict, text, class_name) -> Iterator[tuple[str, str, str]]:
    for at, op in reachable(code, handlers):
        if op in (182, 183, 184, 185):
            ref = pool[int.from_bytes(code[at + 1 : at + 3], "big")]
            name_type = pool[ref[2]]
            yield class_name(ref[1]), text(name_type[1]), text(name_type[2])


def safe_member(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and "\x00" not in name and ":" not in parts[0]


def exploded(size: int, packed: int) -> bool:
    """Whether a member unpacks beyond the ratio; small members may."""
    return size > RATIO_FLOOR and size > MAX_RATIO * max(packed, 1)


def classes_in(data: bytes, artifact: str, depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(artifact, class bytes, diagnostic) of a class file or of an archive and those nested in it. Unsafe and repeated names
    and members beyond the bounds are diagnostics, never data."""
    if data[:4] == b"\xca\xfe\xba\xbe":
        yield artifact, data, None
        return
    try:
        found = archive.members(data, lambda name: not name.endswith(".class"))
    except (archive.BadArchive, struct.error, OverflowError):
        yield artifact, None, "java-artifact-read-failed"
        return
    names = Counter(m.name.replace("\\", "/").lower() for m in found)
    told: set[str] = set()
    total = 0
    for m in found[:MAX_MEMBERS]:
        low = m.name.replace("\\", "/").lower()
        inner = f"{artifact}!/{m.name}"
        nested = low.endswith((".jar", ".war", ".ear", ".zip"))
        if m.is_dir or not (low.endswith(".class") or nested):
            continue
        if names[low] > 1:  # names that collide are one entry, and none of them is read
            if low not in told:
                told.add(low)
                yield inner, None, "java-artifact-read-failed"
        elif not safe_member(m.name) or m.error:
            yield inner, None, "java-artifact-read-failed"
        elif m.flags & archive.ENCRYPTED or m.method not in (archive.STORED, archive.DEFLATED):
            yield inner, None, "java-class-version-unsupported"
        elif exploded(m.size, m.packed) or m.size > (MAX_TOTAL if nested else MAX_CLASS) or total + m.size > MAX_TOTAL:
            yield inner, None, "java-archive-budget-exhausted"
        elif nested and depth >= MAX_DEPTH:
            yield inner, None, "java-archive-budget-exhausted"
        else:
            total += m.size
            try:
                raw = archive.read(data, m)
            except ValueError:
                yield inner, None, "java-artifact-read-failed"
                continue
            yield from classes_in(raw, inner, depth + 1)
    if len(found) > MAX_MEMBERS:
        yield artifact, None, "java-archive-budget-exhausted"


def calls(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, diagnostics) of class files and archives (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for artifact, raw, problem in classes_in(data or b"", path):
                    if problem:
                        rows.append((path, artifact, None, problem, None, None, None))
                        continue
                    try:
                        name, found = read_class(raw)
                        rows += [(path, artifact, name, *c) for c in found]
                    except Malformed:
                        rows.append((path, artifact, None, "java-class-malformed", None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=["path", "artifact", "class", "method", "owner", "name", "descriptor"])

    rows = files.select("path", "content").mapInArrow(run, CALLS)
    diagnostics = rows.where("class is null").select("path", "artifact", F.col("method").alias("code"))
    return rows.where("class is not null"), diagnostics


def structural(found: DataFrame) -> DataFrame:
    """Findings from calls: per method the features of its calls, per class and rule the first method that shows them all."""
    feature = literal_map({f"{o}.{n}": f for (o, n), f in APIS.items()})[F.concat("owner", F.lit("."), "name")]
    inherited = (F.col("owner") == F.col("class")) & (F.col("name") == "defineClass")
    known = found.withColumn("feature", F.coalesce(feature, F.when(inherited, "dynamic_load"))).where("feature is not null")
    methods = known.groupBy("path", "artifact", "class", "method").agg(F.collect_set("feature").alias("f"), F.array_sort(F.collect_set(F.concat("owner", F.lit("."), "name"))).alias("apis"))
    hits = F.array_compact(F.array(*(F.when(F.forall(F.array(*map(F.lit, need)), lambda x: F.array_contains("f", x)), F.struct(F.lit(rule).alias("rule"), F.lit(family).alias("family"))) for rule, family, need in RULES)))
    rows = methods.withColumn("h", F.explode(hits))
    best = rows.groupBy("path", "artifact", "class", "h.rule", "h.family").agg(F.min("method").alias("method"), F.min_by("apis", "method").alias("apis"))
    return best.withColumn("score", F.lit(SCORE)).withColumn("evidence", F.array_join("apis", ", "))


def api_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, n, f) for (o, n), f in APIS.items()], "owner string, name string, feature string")
