"""Rule text to rules: the public YARA syntax, by a lexer and recursive descent.

A parsed rule is plain data (tuples and strings), so it can be kept, compared and sent to tasks. What the engine does not
support is an error that names it; nothing is dropped."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class RuleError(ValueError):
    """What is wrong with a rule's text, and in which line."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(message if line is None else f"line {line}: {message}")


@dataclass(frozen=True)
class String:
    """kind: text, regex or hex. value: bytes of a text, source of a regex, tokens of a hex string."""

    name: str
    kind: str
    value: Any
    flags: frozenset[str] = frozenset()
    xor: tuple[int, int] | None = None


@dataclass(frozen=True)
class ParsedRule:
    name: str
    strings: tuple[String, ...]
    condition: tuple
    meta: dict[str, str] = field(default_factory=dict)
    tags: tuple[str, ...] = ()
    private: bool = False
    is_global: bool = False
    imports: tuple[str, ...] = ()

    @property
    def references(self) -> frozenset[str]:
        """Names of other rules in the condition; a trailing star stands for all that begin so."""
        return frozenset(_references(self.condition, frozenset()))


MODIFIERS = {"text": {"nocase", "wide", "ascii", "fullword", "private", "xor", "base64", "base64wide"}, "regex": {"nocase", "wide", "ascii", "fullword", "private"}, "hex": {"private"}}
READERS = {f"{sign}int{bits}{order}": (bits // 8, order == "be", sign == "") for sign in ("", "u") for bits in (8, 16, 32) for order in ("", "be")}
#: Members of modules that the engine computes; others are errors.
MODULES = {
    "hash": {"md5", "sha1", "sha256", "crc32"},
    "math": {"entropy", "min", "max", "abs", "in_range"},
    "pe": {"is_pe", "machine", "number_of_sections", "timestamp"},
}
KEYWORDS = {
    "all", "and", "any", "ascii", "at", "base64", "base64wide", "condition", "contains", "defined", "endswith", "entrypoint", "false", "filesize", "for", "fullword", "global", "icontains", "iendswith", "iequals",
    "import", "in", "include", "istartswith", "matches", "meta", "nocase", "none", "not", "of", "or", "private", "rule", "startswith", "strings", "them", "true", "wide", "xor", *READERS,
}

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n\f]+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<size>(?:0x[0-9A-Fa-f]+|0o[0-7]+|\d+)(?:KB|MB)?(?!\w|\.\d)|\d+\.\d+)"""
    r"""|(?P<ident>[$\#@!][A-Za-z0-9_]*\*?|[A-Za-z_]\w*\*?)|(?P<sign>\.\.|==|!=|<=|>=|<<|>>|[-+*\\%&|^~<>=(){}\[\],:.])""",
    re.ASCII,
)
_REGEX = re.compile(r"/((?:[^/\\\n]|\\.)+)/([is]*)")
_ESCAPE = re.compile(r'\\(x[0-9A-Fa-f]{2}|[\s\S])')
_ESCAPED = {"n": b"\n", "t": b"\t", "r": b"\r", '"': b'"', "\\": b"\\"}


class _Reader:
    """Tokens one at a time; regexes and hex strings are read where the grammar expects them, as only it can tell."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.kind, self.token = "", ""
        self.begin = 0
        self.next()

    def fail(self, message: str, at: int | None = None) -> RuleError:
        return RuleError(message, self.text.count("\n", 0, self.begin if at is None else at) + 1)

    def next(self) -> str:
        was = self.token
        while True:
            self.begin = self.at
            if self.at >= len(self.text):
                self.kind, self.token = "end", ""
                return was
            if self.text[self.at] == "/" and not self.text.startswith(("//", "/*"), self.at):
                self.kind, self.token = "slash", "/"
                return was
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise self.fail(f"unexpected {self.text[self.at]!r}")
            self.at = m.end()
            if m.lastgroup != "space":
                self.kind, self.token = m.lastgroup, m[0]
                return was

    def take(self, token: str) -> bool:
        if self.token == token and self.kind in ("ident", "sign"):
            self.next()
            return True
        return False

    def want(self, token: str) -> None:
        if not self.take(token):
            raise self.fail(f"expected {token!r}, found {self.token or 'the end'!r}")

    def name(self) -> str:
        if self.kind != "ident" or not re.fullmatch(r"[A-Za-z_]\w*", self.token) or self.token in KEYWORDS:
            raise self.fail(f"expected a name, found {self.token or 'the end'!r}")
        return self.next()

    def regex(self) -> tuple[str, str]:
        m = _REGEX.match(self.text, self.begin)
        if not m:
            raise self.fail("regex without end")
        self.at = m.end()
        self.next()
        return m[1], m[2]

    def block(self) -> str:
        """The source of a hex string whose opening brace is the present token."""
        end = self.text.find("}", self.begin)
        if end < 0:
            raise self.fail("hex string without end")
        inner = self.text[self.begin + 1 : end]
        self.at = end + 1
        self.next()
        return inner


def text_value(token: str) -> bytes:
    def one(m):
        if m[1][0] == "x" and len(m[1]) == 3:
            return chr(int(m[1][1:], 16))
        if m[1] not in _ESCAPED:
            raise RuleError(f"unknown escape \\{m[1]}")
        return _ESCAPED[m[1]].decode()

    return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode() for c in _ESCAPE.sub(one, token[1:-1])) if "\\x" in token else _ESCAPE.sub(one, token[1:-1]).encode()


def hex_value(source: str) -> tuple:
    """Tokens of a hex string: (value, mask, negated) for a byte, ("jump", least, most or None), ("or", (tokens, ...))."""
    pieces = re.findall(r"~?[0-9A-Fa-f?]{2}|\[[^\]]*\]|[()|]|\S", re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", " ", source))
    at = 0

    def sequence(depth: int) -> tuple:
        nonlocal at
        out: list = []
        while at < len(pieces):
            p = pieces[at]
            if p in "|)":
                if depth == 0:
                    raise RuleError(f"unexpected {p} in a hex string")
                break
            at += 1
            if p == "(":
                arms = [sequence(depth + 1)]
                while at < len(pieces) and pieces[at] == "|":
                    at += 1
                    arms.append(sequence(depth + 1))
                if at >= len(pieces):
                    raise RuleError("hex alternatives without end")
                at += 1
                out.append(("or", tuple(arms)))
            elif p[0] == "[":
                m = re.fullmatch(r"\[\s*(\d+)?\s*(-)?\s*(\d+)?\s*\]", p)
                if not m or (not m[1] and not m[2]):
                    raise RuleError(f"bad jump {p}")
                least = int(m[1] or 0)
                most = least if not m[2] else int(m[3]) if m[3] else None
                if most is not None and most < least:
                    raise RuleError(f"bad jump {p}")
                out.append(("jump", least, most))
            elif re.fullmatch(r"~?[0-9A-Fa-f?]{2}", p):
                digits = p[-2:]
                mask = sum(0xF << (4 * (1 - i)) for i, c in enumerate(digits) if c != "?")
                out.append((int(digits.replace("?", "0"), 16), mask, p[0] == "~"))
            else:
                raise RuleError(f"unexpected {p} in a hex string")
        return tuple(out)

    found = sequence(0)
    if not found or found[0][0] == "jump" or found[-1][0] == "jump":
        raise RuleError("a hex string begins and ends with bytes")
    return found


class _Parser:
    def __init__(self, text: str):
        self.r = _Reader(text)
        self.strings: tuple[String, ...] = ()
        self.loops: list[frozenset[str]] = []

    def rules(self) -> list[ParsedRule]:
        r, out, imports = self.r, [], []
        while r.kind != "end":
            if r.take("import"):
                imports.append(r.next()[1:-1])
                if imports[-1] not in MODULES:
                    raise r.fail(f"module {imports[-1]!r} is not supported")
            elif r.token == "include":
                raise r.fail("include is not supported")
            else:
                out.append(self.rule(tuple(imports)))
        return out

    def rule(self, imports: tuple[str, ...]) -> ParsedRule:
        r, marks = self.r, set()
        while r.token in ("private", "global"):
            marks.add(r.next())
        r.want("rule")
        name = r.name()
        tags = []
        if r.take(":"):
            while r.kind == "ident" and r.token not in KEYWORDS:
                tags.append(r.next())
        r.want("{")
        meta = self.meta() if r.take("meta") else {}
        self.strings = self.declared() if r.take("strings") else ()
        self.imports = imports
        r.want("condition")
        r.want(":")
        condition = self.boolean()
        r.want("}")
        used = _mentioned(condition)
        names = {s.name for s in self.strings}
        idle = [s.name for s in self.strings if s.name and s.name not in used and not any(u.endswith("*") and s.name.startswith(u[:-1]) for u in used) and not s.name.startswith("_")]
        if idle:
            raise RuleError(f"rule {name}: string ${idle[0]} is not used")
        missing = sorted(u for u in used if not (u in names or (u.endswith("*") and any(n.startswith(u[:-1]) for n in names))))
        if missing:
            raise RuleError(f"rule {name}: no string ${missing[0]}")
        return ParsedRule(name, self.strings, condition, meta, tuple(tags), "private" in marks, "global" in marks, imports)

    def meta(self) -> dict[str, str]:
        r, out = self.r, {}
        r.want(":")
        while r.token not in ("strings", "condition"):
            if r.kind != "ident":
                raise r.fail(f"expected a name, found {r.token or 'the end'!r}")
            name = r.next()
            r.want("=")
            sign = "-" if r.take("-") else ""
            if r.kind == "string":
                value = text_value(r.token).decode("utf-8", "replace")
            elif r.kind == "size" or r.token in ("true", "false"):
                value = sign + r.token
            else:
                raise r.fail(f"bad value of {name}")
            r.next()
            out.setdefault(name, value)
        return out

    def declared(self) -> tuple[String, ...]:
        r, out = self.r, []
        r.want(":")
        while r.kind == "ident" and r.token.startswith("$"):
            at = r.begin
            name = r.next()[1:]
            if name.endswith("*"):
                raise r.fail("a string's name holds no star")
            if name and any(s.name == name for s in out):
                raise r.fail(f"string ${name} is declared twice")
            r.want("=")
            flags: set[str] = set()
            if r.kind == "string":
                kind, value = "text", text_value(r.next())
                if not value:
                    raise r.fail(f"string ${name} is empty", at)
            elif r.kind == "slash":
                kind, (value, marks) = "regex", r.regex()
                flags |= {"i": {"nocase"}, "s": {"dotall"}, "": set()}["i" if "i" in marks else ""] | ({"dotall"} if "s" in marks else set())
            elif r.token == "{":
                kind, value = "hex", hex_value(r.block())
            else:
                raise r.fail(f"bad value of ${name}")
            xor = None
            while r.kind == "ident" and r.token in MODIFIERS["text"]:
                flag = r.next()
                if flag not in MODIFIERS[kind]:
                    raise r.fail(f"{flag} does not go with ${name}")
                flags.add(flag)
                if flag == "xor":
                    xor = (0, 255)
                    if r.take("("):
                        low = self.number()
                        xor = (low, self.number() if r.take("-") else low)
                        r.want(")")
                elif r.token == "(" and flag in ("base64", "base64wide"):
                    raise r.fail("base64 with an alphabet of its own is not supported")
            if kind == "regex":
                compiled = regex_source(value, flags)
                try:
                    re.compile(compiled)
                except re.error as e:
                    raise r.fail(f"regex of ${name}: {e}", at) from None
            out.append(String(name or f"_{len(out)}", kind, value, frozenset(flags), xor))
        if not out:
            raise r.fail("strings: declares none")
        return tuple(out)

    def number(self) -> int:
        if self.r.kind != "size":
            raise self.r.fail("expected a number")
        return number_value(self.r.next())

    # conditions: nested tuples, the first element names the kind

    def boolean(self) -> tuple:
        parts = [self.conjunction()]
        while self.r.take("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def conjunction(self) -> tuple:
        parts = [self.negation()]
        while self.r.take("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def negation(self) -> tuple:
        if self.r.take("not"):
            return ("not", self.negation())
        if self.r.take("defined"):
            return ("defined", self.negation())
        return self.comparison()

    def comparison(self) -> tuple:
        r = self.r
        if r.token == "for":
            return self.loop()
        if r.token in ("any", "all", "none"):
            return self.quantified(("word", r.next()))
        if r.kind == "ident" and r.token.startswith("$"):
            return self.string_term()
        left = self.bits()
        if r.token in ("==", "!=", "<", ">", "<=", ">="):
            return (r.next(), left, self.bits())
        if r.token in ("of", "%"):
            return self.quantified(left)
        if r.token in ("contains", "icontains", "startswith", "istartswith", "endswith", "iendswith", "iequals", "matches"):
            raise r.fail(f"{r.token} is not supported")
        return left

    def quantified(self, how: tuple) -> tuple:
        r = self.r
        percent = r.take("%") if how[0] != "word" else False
        r.want("of")
        kind, members = self.members()
        how = ("percent", how) if percent else how
        out = ("of", how, kind, members)
        if r.take("at"):
            return (*out, ("at", self.bits()))
        if r.take("in"):
            return (*out, ("in", *self.range()))
        return out

    def members(self) -> tuple[str, tuple[str, ...]]:
        """("strings", names) or ("rules", names); no names: them."""
        r = self.r
        if r.take("them"):
            return "strings", ()
        r.want("(")
        names = [r.next()]
        while r.take(","):
            names.append(r.next())
        r.want(")")
        if all(n.startswith("$") for n in names):
            return "strings", tuple(n[1:] for n in names)
        if any(n.startswith("$") for n in names) or not all(re.fullmatch(r"[A-Za-z_]\w*\*?", n) for n in names):
            raise r.fail("a set is of strings or of rules")
        return "rules", tuple(names)

    def range(self) -> tuple[tuple, tuple]:
        self.r.want("(")
        low = self.bits()
        self.r.want("..")
        high = self.bits()
        self.r.want(")")
        return low, high

    def string_term(self) -> tuple:
        r = self.r
        name = r.next()[1:]
        if r.take("at"):
            return ("string", name, ("at", self.bits()))
        if r.take("in"):
            return ("string", name, ("in", *self.range()))
        return ("string", name)

    def loop(self) -> tuple:
        r = self.r
        r.want("for")
        how = ("word", r.next()) if r.token in ("any", "all", "none") else self.bits()
        if r.take("of"):
            kind, members = self.members()
            if kind != "strings":
                raise r.fail("for ... of is over strings")
            r.want(":")
            r.want("(")
            body = self.boolean()
            r.want(")")
            return ("for_of", how, members, body)
        name = r.name()
        r.want("in")
        if r.token != "(":
            raise r.fail("for ... in is over numbers")
        r.want("(")
        low = self.bits()
        if r.take(".."):
            over: tuple = ("range", low, self.bits())
        else:
            values = [low]
            while r.take(","):
                values.append(self.bits())
            over = ("list", *values)
        r.want(")")
        r.want(":")
        r.want("(")
        self.loops.append(frozenset({name}))
        body = self.boolean()
        self.loops.pop()
        r.want(")")
        return ("for_in", how, name, over, body)

    _LEVELS = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "\\", "%"))

    def bits(self, level: int = 0) -> tuple:
        if level == len(self._LEVELS):
            return self.primary()
        left = self.bits(level + 1)
        while self.r.kind == "sign" and self.r.token in self._LEVELS[level] and not (self.r.token == "%" and re.match(r"\s*of\b", self.r.text[self.r.at :])):
            left = (self.r.next(), left, self.bits(level + 1))
        return left

    def primary(self) -> tuple:
        r = self.r
        if r.take("("):
            inner = self.boolean()
            r.want(")")
            return inner
        if r.take("-"):
            return ("-", ("number", 0), self.primary())
        if r.take("~"):
            return ("~", self.primary())
        if r.kind == "size":
            return ("number", number_value(r.next()))
        if r.kind == "string":
            return ("text", text_value(r.next()).decode("latin-1"))
        if r.kind != "ident":
            raise r.fail(f"unexpected {r.token or 'the end'!r}")
        token = r.next()
        if token in ("true", "false"):
            return ("bool", token == "true")
        if token == "filesize":
            return ("filesize",)
        if token in READERS:
            r.want("(")
            at = self.bits()
            r.want(")")
            return ("read", token, at)
        if token[0] == "#":
            return ("count", token[1:], *(self.range() if r.take("in") else ()))
        if token[0] in "@!":
            index = ("number", 1)
            if r.take("["):
                index = self.bits()
                r.want("]")
            return ("offset" if token[0] == "@" else "length", token[1:], index)
        if token in MODULES and r.token == ".":
            return self.module(token)
        if any(token in names for names in self.loops):
            return ("variable", token)
        if token in KEYWORDS or token[0] == "$":
            raise r.fail(f"unexpected {token!r}" + (" (entrypoint is not supported)" if token == "entrypoint" else ""))
        return ("rule", token)

    def module(self, name: str) -> tuple:
        r = self.r
        if name not in self.imports:
            raise r.fail(f"module {name} is not imported")
        r.want(".")
        member = r.next()
        if member not in MODULES[name]:
            raise r.fail(f"{name}.{member} is not supported")
        arguments: list[tuple] = []
        if r.take("("):
            while r.token != ")":
                arguments.append(self.bits())
                if not r.take(","):
                    break
            r.want(")")
        return ("module", name, member, tuple(arguments))


def number_value(token: str) -> Any:
    unit = {"KB": 1024, "MB": 1 << 20}.get(token[-2:], 1)
    digits = token[:-2] if unit > 1 else token
    return float(digits) if "." in digits else int(digits, 0 if digits[:2].lower() in ("0x", "0o") else 10) * unit


def regex_source(source: str, flags) -> bytes:
    """The pattern for Python's engine over bytes: $ is the end alone, white space and words are ASCII either way."""
    out, at, bracket = [], 0, False
    while at < len(source):
        c = source[at]
        if c == "\\" and at + 1 < len(source):
            out.append("/" if source[at + 1] == "/" else source[at : at + 2])
            at += 2
            continue
        if bracket:
            if c == "]":
                bracket = False
            elif c == "[":
                c = "\\["
        elif c == "[":
            bracket = True
            ahead = re.match(r"\[\^?\]?", source[at:])[0]
            out.append(ahead.replace("]", "\\]"))
            at += len(ahead)
            continue
        elif c == "$":
            c = "\\Z"
        elif c in "*+?}" and at + 1 < len(source) and source[at + 1] == "+":
            raise RuleError("regex: a repetition of a repetition")
        out.append(c)
        at += 1
    mark = "s" if "dotall" in flags else ""
    return (f"(?{mark})" if mark else "").encode() + "".join(out).encode()


def _walk(node: Any):
    if isinstance(node, tuple):
        yield node
        for part in node:
            yield from _walk(part)


def _mentioned(condition: tuple) -> set[str]:
    """Names of strings in a condition, sets with a star; `them` is the star alone."""
    out: set[str] = set()
    for node in _walk(condition):
        if node[:1] in (("string",), ("count",), ("offset",), ("length",)) and len(node) > 1 and isinstance(node[1], str):
            out |= {node[1]} if node[1] else set()
        elif node[:1] == ("of",) and node[2] == "strings":
            out |= set(node[3]) or {"*"}
        elif node[:1] == ("for_of",):
            out |= set(node[2]) or {"*"}
    return out


def _references(node: Any, bound: frozenset[str]):
    for part in _walk(node):
        if part[:1] == ("rule",):
            yield part[1]
        elif part[:1] == ("of",) and part[2] == "rules":
            yield from part[3]


def parse(text: str) -> list[ParsedRule]:
    """All rules of a text, in order. Raises RuleError."""
    try:
        return _Parser(text).rules()
    except RecursionError:
        raise RuleError("a condition is nested too deeply") from None
