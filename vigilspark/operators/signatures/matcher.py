"""Whole packs over files: atoms of all strings are found in one pass, full patterns run for strings whose atom is there, and
conditions for rules that those strings can make true.

A pack is compiled once in each Python worker from its parsed rules, which travel with the task. Compiling checks what parsing
can't: that referred rules exist, stand before and don't repeat. A rule that can hold without any of its strings (a condition
on size or numbers, a negation, a rule it refers to) is tried on every file; which ones these are is read off the condition."""

from __future__ import annotations

import hashlib
import math
import operator
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np

from vigilspark.operators.signatures.parser import READERS, ParsedRule, RuleError, String, regex_source

try:
    import ahocorasick
except ImportError:  # atoms are then looked for one by one
    ahocorasick = None

LEAST_ATOM, MOST_ATOM, MOST_ARMS = 2, 24, 64
#: Matches of one string that a file's evaluation keeps, as the counts of the public engine do.
MOST_MATCHES = 1_000_000
#: Rules of one condition, at least, that are tried on a file all at once.
ALIKE = 16
_ALNUM = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Undefined(Exception):
    """A number that a file doesn't have, as a read beyond its end; the term that needs it is false."""


def _wide(data: bytes) -> bytes:
    return bytes(x for c in data for x in (c, 0))


def _base64_forms(data: bytes) -> list[bytes]:
    """What stays the same of data's base64 form, at each of three alignments."""
    import base64

    out = []
    for k in range(3):
        form = base64.b64encode(b"\0" * k + data).rstrip(b"=")
        end = len(form) - (1 if (k + len(data)) % 3 else 0)
        out.append(form[(0, 2, 3)[k] : end])
    return [o for o in out if o]


class Pattern:
    """One string, ready to search: variants of (compiled pattern, wide), and atoms of which one must occur (None: no atom)."""

    def __init__(self, s: String):
        self.name, self.fullword = s.name, "fullword" in s.flags
        self.atoms: list[bytes] | None = []
        self.variants: list[tuple[re.Pattern[bytes], bool]] = []
        self.literals: list[tuple[bytes, bool, bool]] = []
        self.plain: list[re.Pattern[bytes]] = []
        flags = re.I if "nocase" in s.flags else 0
        plain = "ascii" in s.flags or "wide" not in s.flags
        if s.kind == "text":
            forms = [(s.value, False)] * plain + [(_wide(s.value), True)] * ("wide" in s.flags)
            if s.xor:
                forms = [(bytes(c ^ k for c in f), w) for f, w in forms for k in range(s.xor[0], s.xor[1] + 1)]
            if s.flags & {"base64", "base64wide"}:
                coded = _base64_forms(s.value)
                forms = [(f, False) for f in coded] * ("base64" in s.flags) + [(_wide(f), True) for f in coded] * ("base64wide" in s.flags)
            for form, wide in forms:
                self.literals.append((form.lower() if flags else form, bool(flags), wide))
                self._atom([form])
        elif s.kind == "regex":
            source = regex_source(s.value, s.flags)
            atoms = regex_atoms(source, flags)
            if plain:
                self._add(source, flags, False, atoms)
            if "wide" in s.flags:
                self._add(_wide_regex(source), flags, True, [_wide(a) for a in atoms])
        else:
            self._add(_hex_regex(s.value), re.S, False, [a for a in (_hex_atom(s.value),) if a])

    def _atom(self, atoms: list[bytes]) -> None:
        if not atoms or min(map(len, atoms)) < LEAST_ATOM:
            self.atoms = None
        elif self.atoms is not None:
            self.atoms += [a[:MOST_ATOM].lower() for a in atoms]

    def _add(self, source: bytes, flags: int, wide: bool, atoms: list[bytes]) -> None:
        if source.startswith(b"(?s)"):
            source, flags = source[4:], flags | re.S
        self.plain.append(re.compile(source, flags))
        self.variants.append((re.compile(b"(?=(" + source + b"))", flags), wide))
        self._atom(atoms)

    def exists(self, data: bytes, low: Callable[[], bytes]) -> bool:
        if self.literals:
            return next(self._literal_matches(data, low), None) is not None
        if not self.fullword:
            return any((m := p.search(data)) is not None and (m.end() > m.start() or any(n.end() > n.start() for n in p.finditer(data))) for p in self.plain)
        return bool(self.matches(data, low))

    def _literal_matches(self, data: bytes, low: Callable[[], bytes]) -> Iterator[tuple[int, int]]:
        for form, folded, wide in self.literals:
            where = low() if folded else data
            at = where.find(form)
            while at >= 0:
                if not self.fullword or _alone(data, at, at + len(form), wide):
                    yield at, len(form)
                at = where.find(form, at + 1)

    def matches(self, data: bytes, low: Callable[[], bytes]) -> list[tuple[int, int]]:
        """(offset, length) of all matches, overlapping ones too, in order; one for each offset."""
        found: dict[int, int] = {}
        for start, length in self._literal_matches(data, low):
            found[start] = max(found.get(start, 0), length)
            if len(found) >= MOST_MATCHES:
                break
        for pattern, wide in self.variants:
            for m in pattern.finditer(data):
                start, end = m.span(1)
                if end == start or (self.fullword and not _alone(data, start, end, wide)):
                    continue
                found[start] = max(found.get(start, 0), end - start)
                if len(found) >= MOST_MATCHES:
                    break
        return sorted(found.items())


def _alone(data: bytes, start: int, end: int, wide: bool) -> bool:
    """No letter or digit beside a match; in wide text, none that is followed by a NUL."""
    if wide:
        return not (start >= 2 and data[start - 1] == 0 and data[start - 2] in _ALNUM) and not (end + 1 < len(data) and data[end + 1] == 0 and data[end] in _ALNUM)
    return not (start > 0 and data[start - 1] in _ALNUM) and not (end < len(data) and data[end] in _ALNUM)


def _parsed(source: bytes, flags: int):
    from re import _parser

    return _parser.parse(source, flags)


def regex_atoms(source: bytes, flags: int = 0) -> list[bytes]:
    """Literal runs of which every match of a regex holds one; none where no such run is found. Of the stretches that a match
    must hold, the one whose shortest run is longest."""

    def best_of(sequence) -> list[bytes]:
        best: list[bytes] = []
        run = b""

        def offer(atoms: list[bytes]) -> None:
            nonlocal best
            if atoms and len(atoms) <= MOST_ARMS and min(map(len, atoms)) > (min(map(len, best)) if best else 0):
                best = atoms

        def walk(part) -> None:
            nonlocal run
            for op, argument in part:
                kind = str(op)
                if kind == "LITERAL" and argument < 256:
                    run += bytes([argument])
                    offer([run])
                elif kind == "SUBPATTERN":
                    walk(argument[3])
                elif kind == "BRANCH":
                    arms = [best_of(arm) for arm in argument[1]]
                    if all(arms):
                        offer([a for arm in arms for a in arm])
                    run = b""
                elif kind in ("MAX_REPEAT", "MIN_REPEAT") and argument[0] >= 1:
                    for _ in range(min(argument[0], 4)):
                        walk(argument[2])
                    if argument[0] != argument[1]:
                        run = b""
                elif kind != "AT":
                    run = b""

        walk(sequence)
        return best

    return best_of(_parsed(source, flags))


def _wide_regex(source: bytes) -> bytes:
    """A regex over text with a NUL after each byte: each single-byte item takes its NUL."""

    def built(sequence) -> bytes:
        out = []
        for op, argument in sequence:
            kind = str(op)
            if kind == "LITERAL":
                out.append(re.escape(bytes([argument])) + b"\\x00")
            elif kind == "NOT_LITERAL":
                out.append(b"[^" + re.escape(bytes([argument])) + b"]\\x00")
            elif kind == "ANY":
                out.append(b".\\x00")
            elif kind == "IN":
                out.append(_class(argument) + b"\\x00")
            elif kind == "SUBPATTERN":
                out.append(b"(?:" + built(argument[3]) + b")")
            elif kind == "BRANCH":
                out.append(b"(?:" + b"|".join(built(a) for a in argument[1]) + b")")
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                most = b"" if str(argument[1]) == "MAXREPEAT" else str(int(argument[1])).encode()
                out.append(b"(?:" + built(argument[2]) + b"){" + str(argument[0]).encode() + b"," + most + b"}" + (b"?" if kind == "MIN_REPEAT" else b""))
            elif kind == "AT":
                out.append({"AT_BEGINNING": b"\\A", "AT_BEGINNING_STRING": b"\\A", "AT_END": b"\\Z", "AT_END_STRING": b"\\Z"}.get(str(argument), b""))
            else:
                raise RuleError(f"wide regex: {kind.lower()} is not supported")
        return b"".join(out)

    return built(_parsed(source, 0))


_CATEGORIES = {"CATEGORY_DIGIT": rb"\d", "CATEGORY_NOT_DIGIT": rb"\D", "CATEGORY_SPACE": rb"\s", "CATEGORY_NOT_SPACE": rb"\S", "CATEGORY_WORD": rb"\w", "CATEGORY_NOT_WORD": rb"\W"}


def _class(items) -> bytes:
    out = b""
    for op, argument in items:
        kind = str(op)
        if kind == "NEGATE":
            out += b"^"
        elif kind == "LITERAL":
            out += b"\\x%02x" % argument
        elif kind == "RANGE":
            out += b"\\x%02x-\\x%02x" % argument
        else:
            out += _CATEGORIES[str(argument)]
    return b"[" + out + b"]"


def _hex_regex(tokens: tuple) -> bytes:
    out = []
    for t in tokens:
        if t[0] == "jump":
            out.append(b".{%d,%s}?" % (t[1], b"" if t[2] is None else b"%d" % t[2]))
        elif t[0] == "or":
            out.append(b"(?:" + b"|".join(_hex_regex(arm) for arm in t[1]) + b")")
        else:
            value, mask, negated = t
            if mask == 0xFF:
                out.append(b"[^\\x%02x]" % value if negated else b"\\x%02x" % value)
            elif mask == 0:
                out.append(b".")
            else:
                fits = b"".join(b"\\x%02x" % c for c in range(256) if c & mask == value)
                out.append(b"[" + (b"^" if negated else b"") + fits + b"]")
    return b"".join(out)


def _hex_atom(tokens: tuple) -> bytes | None:
    best = run = b""
    for t in tokens:
        run = run + bytes([t[0]]) if isinstance(t[0], int) and t[1] == 0xFF and not t[2] else b""
        best = max(best, run, key=len)
    return best or None


class File:
    """A file under evaluation: what was found of each string, and values that conditions read, each computed once."""

    def __init__(self, data: bytes, pack: Pack, seen: set[int]):
        self.data, self.pack, self.seen = data, pack, seen
        self.found: dict[int, list[tuple[int, int]]] = {}
        self.there: dict[int, bool] = {}
        self.values: dict[tuple, Any] = {}

    def matches(self, k: int) -> list[tuple[int, int]]:
        if k not in self.found:
            pattern = self.pack.patterns[k]
            self.found[k] = [] if pattern.atoms is not None and k not in self.seen else pattern.matches(self.data, self.low)
        return self.found[k]

    def exists(self, k: int) -> bool:
        if k in self.found:
            return bool(self.found[k])
        if k not in self.there:
            pattern = self.pack.patterns[k]
            self.there[k] = (pattern.atoms is None or k in self.seen) and pattern.exists(self.data, self.low)
        return self.there[k]

    def low(self) -> bytes:
        return self.value(("low",), self.data.lower)

    def value(self, key: tuple, make: Callable[[], Any]) -> Any:
        if key not in self.values:
            self.values[key] = make()
        return self.values[key]


def _entropy(data: bytes) -> float:
    counts = [data.count(bytes([c])) for c in set(data)]
    return -sum(n / len(data) * math.log2(n / len(data)) for n in counts)


def _by_columns(c: tuple) -> bool:
    """Whether a condition is made of its strings' presence and counts, the file's size, numbers and logic alone."""
    kind = c[0]
    if kind in ("and", "or", "not"):
        return all(map(_by_columns, c[1:]))
    if kind == "string":
        return len(c) == 2 and bool(c[1])
    if kind in _SIGNS:
        return all(x[0] in ("number", "filesize") or (x[0] == "count" and len(x) == 2 and bool(x[1])) for x in c[1:])
    return kind == "bool"


class Alike:
    """Rules that differ in their strings and not in their condition, tried on a file together: a column of patterns for each
    string, and a condition over columns. What a pattern has in the file is looked up once, whatever rules share it."""

    def __init__(self, rules: list[int], condition: tuple, own: list[dict[str, int]]):
        self.rules, self.condition = np.array(rules, np.int64), condition
        self.columns = {n: np.array([o[n] for o in own], np.int64) for n in own[0]}
        self.distinct = {n: np.unique(c) for n, c in self.columns.items()}

    def holds(self, file: File, possible: np.ndarray) -> np.ndarray:
        """For each rule whether it holds. possible: for each pattern whether it may occur in the file."""
        return self._value(self.condition, file, possible)

    def _each(self, name: str, kind: type, possible: np.ndarray, look: Callable[[int], Any]) -> np.ndarray:
        found, distinct = np.zeros(len(possible), kind), self.distinct[name]
        for p in distinct[possible[distinct]].tolist():
            found[p] = look(p)
        return found[self.columns[name]]

    def _value(self, c: tuple, file: File, possible: np.ndarray) -> np.ndarray:
        kind = c[0]
        if kind in ("and", "or"):
            out = self._value(c[1], file, possible)
            for part in c[2:]:
                if (out.all() if kind == "or" else not out.any()):
                    break
                more = self._value(part, file, possible)
                out = out | more if kind == "or" else out & more
            return out
        if kind == "not":
            return ~self._value(c[1], file, possible)
        if kind == "string":
            return self._each(c[1], bool, possible, file.exists)
        if kind == "bool":
            return np.full(len(self.rules), c[1], bool)
        x, y = (self._number(v, file, possible) for v in c[1:])
        return np.broadcast_to(_SIGNS[kind](x, y), len(self.rules))

    def _number(self, c: tuple, file: File, possible: np.ndarray) -> Any:
        if c[0] == "count":
            return self._each(c[1], np.int64, possible, lambda p: len(file.matches(p)))
        return c[1] if c[0] == "number" else len(file.data)


class Pack:
    """Rules compiled together. Raises RuleError where a name repeats or a reference leads nowhere before."""

    def __init__(self, rules: Iterable[ParsedRule]):
        self.rules = list(rules)
        self.at: dict[str, int] = {}
        for k, r in enumerate(self.rules):
            for name in r.references:
                known = any(n.startswith(name[:-1]) for n in self.at) if name.endswith("*") else name in self.at
                if not known:
                    raise RuleError(f"rule {r.name}: no rule {name} before it")
            if r.name in self.at:
                raise RuleError(f"rule {r.name} is declared twice")
            self.at[r.name] = k
        self.patterns: list[Pattern] = []
        self.own: list[dict[str, int]] = []
        shared: dict[tuple, int] = {}
        users: dict[int, set[int]] = {}
        for k, r in enumerate(self.rules):
            own = {}
            for s in r.strings:
                key = (s.kind, s.value, s.flags - {"private"}, s.xor)
                if key not in shared:
                    shared[key] = len(self.patterns)
                    self.patterns.append(Pattern(s))
                own[s.name] = shared[key]
                users.setdefault(shared[key], set()).add(k)
            self.own.append(own)
        self.globals = [k for k, r in enumerate(self.rules) if r.is_global]
        kinds: dict[tuple, list[int]] = {}
        for k, r in enumerate(self.rules):
            if not r.private and _by_columns(r.condition):
                kinds.setdefault((repr(r.condition), *self.own[k]), []).append(k)
        self.alike = [Alike(ks, self.rules[ks[0]].condition, [self.own[k] for k in ks]) for ks in kinds.values() if len(ks) >= ALIKE]
        single = set(range(len(self.rules))).difference(*(a.rules.tolist() for a in self.alike))
        self.users = {p: found for p, ks in users.items() if (found := ks & single)}
        self.always = [k for k in sorted(single) if self._open(self.rules[k].condition, self.own[k])]
        self.atomless = [p for p, pattern in enumerate(self.patterns) if pattern.atoms is None]
        self._atoms()

    def _atoms(self) -> None:
        by_atom: dict[bytes, list[int]] = {}
        for p, pattern in enumerate(self.patterns):
            for atom in pattern.atoms or ():
                by_atom.setdefault(atom, []).append(p)
        self.by_atom = by_atom
        self.machine = None
        if by_atom and ahocorasick is not None:
            self.machine = ahocorasick.Automaton()
            for atom, patterns in by_atom.items():
                self.machine.add_word(atom.decode("latin-1"), tuple(patterns))
            self.machine.make_automaton()

    def _seen(self, data: bytes) -> set[int]:
        low = data.lower()
        if self.machine is not None:
            out: set[int] = set()
            for _, patterns in self.machine.iter(low.decode("latin-1")):
                out.update(patterns)
            return out
        return {p for atom, patterns in self.by_atom.items() if atom in low for p in patterns}

    def _open(self, c: tuple, own: dict[str, int]) -> bool:
        """Whether a condition may hold where no atom of the rule's strings occurs; in doubt it may."""
        kind = c[0]
        loose = lambda name: not name or self.patterns[own[name]].atoms is None
        if kind == "and":
            return all(self._open(x, own) for x in c[1:])
        if kind == "or":
            return any(self._open(x, own) for x in c[1:])
        if kind == "string":
            return loose(c[1])
        if kind == "of" and c[2] == "strings":
            chosen = [n for want in c[3] for n in own if (n.startswith(want[:-1]) if want.endswith("*") else n == want)] if c[3] else list(own)
            n, how = sum(map(loose, chosen)), c[1]
            if how in (("word", "any"), ("word", "all")):
                return n > 0 if how[1] == "any" else n == len(chosen)
            return how[0] != "number" or n >= how[1]
        if kind in (">", ">=", "==") and c[1][0] == "count" and c[1][1] and c[2][0] == "number":
            return loose(c[1][1]) or not (c[2][1] > 0 or (kind == ">" and c[2][1] == 0))
        return True

    # evaluation

    def holding(self, data: bytes) -> tuple[File, np.ndarray]:
        """The file under evaluation and the places of all public rules that hold, in order."""
        seen = self._seen(data)
        file = File(data, self, seen)
        if not all(self._holds(k, file) for k in self.globals):
            return file, np.zeros(0, np.int64)
        candidates = {k for p in seen if p in self.users for k in self.users[p]}
        candidates.update(self.always)
        parts = [np.array([k for k in candidates if not self.rules[k].private and self._holds(k, file)], np.int64)]
        if self.alike:
            possible = np.zeros(len(self.patterns), bool)
            possible[[*seen, *self.atomless]] = True
            parts += [a.rules[a.holds(file, possible)] for a in self.alike]
        return file, np.sort(np.concatenate(parts))

    def scan(self, data: bytes) -> Iterator[tuple[int, list[str]]]:
        """(place of the rule, names of its strings that occur) of all public rules that hold."""
        file, held = self.holding(data)
        for k in held.tolist():
            private = {s.name for s in self.rules[k].strings if "private" in s.flags}
            yield k, sorted(n for n, p in self.own[k].items() if n not in private and file.exists(p))

    def holds(self, data: bytes) -> list[bool]:
        """For every rule whether it holds, private ones too; globals don't gate it."""
        file = File(data, self, self._seen(data))
        return [self._holds(k, file) for k in range(len(self.rules))]

    def _holds(self, k: int, file: File) -> bool:
        def make() -> bool:
            try:
                return bool(Evaluation(self, k, file).value(self.rules[k].condition))
            except Undefined:
                return False

        return file.value(("rule", k), make)


class Evaluation:
    def __init__(self, pack: Pack, k: int, file: File):
        self.pack, self.own, self.file = pack, pack.own[k], file
        self.variables: dict[str, int] = {}
        self.current: str | None = None

    def matches(self, name: str) -> list[tuple[int, int]]:
        return self.file.matches(self.own[name or self.current])

    def chosen(self, names: tuple[str, ...]) -> list[str]:
        if not names:
            return list(self.own)
        return [n for want in names for n in self.own if (n.startswith(want[:-1]) if want.endswith("*") else n == want)]

    def truth(self, c: tuple) -> bool:
        """A part of a condition; what needs a value that is not there is false."""
        try:
            return bool(self.value(c))
        except Undefined:
            return False

    def value(self, c: tuple) -> Any:
        return getattr(self, "_" + _NAMES.get(c[0], c[0]))(*c[1:])

    def _or(self, *parts):
        return any(self.truth(p) for p in parts)

    def _and(self, *parts):
        return all(self.truth(p) for p in parts)

    def _not(self, part):
        return not self.value(part)

    def _defined(self, part):
        try:
            self.value(part)
        except Undefined:
            return False
        return True

    def _compare(self, sign, a, b):
        x, y = self.value(a), self.value(b)
        if isinstance(x, str) != isinstance(y, str):
            raise Undefined
        return {"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign]

    def _calculate(self, sign, a, b):
        x, y = self.value(a), self.value(b)
        if sign in "\\%" and y == 0:
            raise Undefined
        if sign in ("<<", ">>") and not 0 <= y < 64:
            raise Undefined
        if sign == "\\":
            return x / y if isinstance(x, float) or isinstance(y, float) else int(x / y) if abs(x) < 1 << 52 else x // y
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: math.fmod(x, y) if isinstance(x, float) else x - y * int(x / y), "|": lambda: x | y, "^": lambda: x ^ y, "&": lambda: x & y, "<<": lambda: x << y, ">>": lambda: x >> y}[sign]()

    def _inverse(self, part):
        return ~self.value(part)

    def _number(self, n):
        return n

    def _text(self, t):
        return t

    def _bool(self, b):
        return b

    def _filesize(self):
        return len(self.file.data)

    def _variable(self, name):
        return self.variables[name]

    def _rule(self, name):
        return self.pack._holds(self.pack.at[name], self.file)

    def _read(self, reader, at):
        size, big, unsigned = READERS[reader][0], READERS[reader][1], reader.startswith("u")
        start = self.value(at)
        if not 0 <= start <= len(self.file.data) - size:
            raise Undefined
        code = {1: "b", 2: "h", 4: "i"}[size]
        return struct.unpack_from((">" if big else "<") + (code.upper() if unsigned else code), self.file.data, start)[0]

    def _within(self, place, matches):
        if place[0] == "at":
            at = self.value(place[1])
            return [m for m in matches if m[0] == at]
        low, high = self.value(place[1]), self.value(place[2])
        return [m for m in matches if low <= m[0] <= high]

    def _string(self, name, place=None):
        if place is None:
            return self.file.exists(self.own[name or self.current])
        return bool(self._within(place, self.matches(name)))

    def _count(self, name, low=None, high=None):
        found = self.matches(name)
        return len(found) if low is None else len(self._within(("in", low, high), found))

    def _nth(self, name, index):
        found, n = self.matches(name), self.value(index)
        if not 1 <= n <= len(found):
            raise Undefined
        return found[n - 1]

    def _offset(self, name, index):
        return self._nth(name, index)[0]

    def _length(self, name, index):
        return self._nth(name, index)[1]

    def _enough(self, how, total: int, true: Callable[[int], int]) -> bool:
        """true(n): how many hold, counted up to n at least."""
        if how == ("word", "any"):
            return true(1) >= 1
        if how == ("word", "all"):
            return total > 0 and true(total) == total
        if how == ("word", "none"):
            return true(1) == 0
        need = math.ceil(total * self.value(how[1]) / 100) if how[0] == "percent" else self.value(how)
        return true(need) >= need if need > 0 else true(1) == 0

    def _of(self, how, kind, members, place=None):
        if kind == "rules":
            names = [n for want in members for n in self.pack.at if (n.startswith(want[:-1]) if want.endswith("*") else n == want)]
            tests = [lambda n=n: self._rule(n) for n in names]
        else:
            tests = [lambda n=n: self._string(n, place) for n in self.chosen(members)]
        return self._enough(how, len(tests), lambda need: _up_to(need, (t() for t in tests)))

    def _for_of(self, how, members, body):
        def tests():
            before = self.current
            for name in names:
                self.current = name
                yield self.truth(body)
            self.current = before

        names = self.chosen(members)
        return self._enough(how, len(names), lambda need: sum(list(tests())))

    def _for_in(self, how, name, over, body):
        if over[0] == "range":
            values: Any = range(self.value(over[1]), self.value(over[2]) + 1)
        else:
            values = [self.value(v) for v in over[1:]]

        def tests():
            for v in values:
                self.variables[name] = v
                yield self.truth(body)

        return self._enough(how, len(values), lambda need: _up_to(need, tests()))

    def _module(self, module, member, arguments):
        values = [self.value(a) for a in arguments]
        return self.file.value(("module", module, member, *values), lambda: _MODULES[module, member](self.file.data, *values))


def _up_to(need: int, tests: Iterator[bool]) -> int:
    n = 0
    for t in tests:
        n += bool(t)
        if n >= need:
            break
    return n


_SIGNS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_NAMES = {"~": "inverse", "for_in": "for_in"}
for _sign in ("==", "!=", "<", ">", "<=", ">="):
    setattr(Evaluation, f"_compare{_sign}", lambda self, a, b, sign=_sign: self._compare(sign, a, b))
    _NAMES[_sign] = f"compare{_sign}"
for _sign in ("+", "-", "*", "\\", "%", "|", "^", "&", "<<", ">>"):
    setattr(Evaluation, f"_calculate{_sign}", lambda self, a, b, sign=_sign: self._calculate(sign, a, b))
    _NAMES[_sign] = f"calculate{_sign}"


def _part(data: bytes, *span) -> bytes:
    if len(span) == 1:
        return span[0].encode("latin-1")
    start, size = span
    if start < 0 or size < 0 or start > len(data):
        raise Undefined
    return data[start : start + size]


def _pe(data: bytes) -> int:
    """Where the COFF header of a PE file begins."""
    if data[:2] != b"MZ" or len(data) < 0x40:
        raise Undefined
    at = struct.unpack_from("<I", data, 0x3C)[0]
    if data[at : at + 4] != b"PE\0\0" or len(data) < at + 24:
        raise Undefined
    return at + 4


def _is_pe(data: bytes) -> int:
    try:
        _pe(data)
    except Undefined:
        return 0
    return 1


_MODULES: dict[tuple[str, str], Callable] = {
    **{("hash", name): lambda data, *span, name=name: hashlib.new(name, _part(data, *span)).hexdigest() for name in ("md5", "sha1", "sha256")},
    ("hash", "crc32"): lambda data, *span: zlib.crc32(_part(data, *span)),
    ("math", "entropy"): lambda data, *span: _entropy(_part(data, *span)) if _part(data, *span) else 0.0,
    ("math", "min"): lambda data, a, b: min(a, b),
    ("math", "max"): lambda data, a, b: max(a, b),
    ("math", "abs"): lambda data, a: abs(a),
    ("math", "in_range"): lambda data, x, low, high: int(low <= x <= high),
    ("pe", "is_pe"): _is_pe,
    ("pe", "machine"): lambda data: struct.unpack_from("<H", data, _pe(data))[0],
    ("pe", "number_of_sections"): lambda data: struct.unpack_from("<H", data, _pe(data) + 2)[0],
    ("pe", "timestamp"): lambda data: struct.unpack_from("<I", data, _pe(data) + 4)[0],
}
