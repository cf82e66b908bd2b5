"""Folding of literal expressions in script source: a small lexer, and reductions over its tokens to a fixpoint.

The lexer takes bytes of any script language. A quote begins a string only where what stands before or after the string lets
it be an operand; other quotes (an apostrophe in a comment or in markup) are signs of their own, so the lexer falls into step
again by itself. The reducer shifts tokens onto a list and, after each, reduces the list's end: joined strings, runs of
character codes, reversals, decoders of literals, attributes looked up by name. Names that are assigned once, to a literal,
stand for it where they are called.

Fixed values: sizes, passes and the names of the functions that are folded."""

from __future__ import annotations

import base64
import binascii
import re
from typing import NamedTuple

FOLD_BYTES, FOLD_PASSES, CONSTANT_LENGTHS = 2 << 20, 8, range(3, 129)
REVERSE, CHR, PACK, GETATTR, IMPORT, BASE64_MODULE = b"reverse", b"chr", b"pack", b"getattr", b"__import__", b"base64"
DECODE_BASE64, DECODE_HEX = (b"b64decode", b"decode_base64"), (b"fromhex",)
DECLARING = (b"my", b"our", b"local")

BLANK = b" \t\r\n\f"


class Token(NamedTuple):
    """kind: s (string), n (name), d (number), c (character code), o (any other sign). value: what a string or code stands for."""

    kind: str
    text: bytes
    value: bytes
    start: int
    end: int


_STRING = {quote: re.compile(rb"(?s)" + q + rb"((?:[^" + q + rb"\\]|\\.)*)" + q) for quote, q in ((0x22, b'"'), (0x27, b"'"))}
_PIECE = re.compile(rb"[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+|[0-9]+|[^\s\w]|[0-9]\w*", re.S)
#: Signs that an operand may follow, and signs that may follow an operand.
_BEFORE, _AFTER = (b"(", b".", b"+", b"=", b",", b"["), b").+[;,\n"


def literal(raw: bytes) -> bytes:
    """A string's value: a backslash before a quote or a backslash goes."""
    return re.sub(rb"\\([\\'\"])", rb"\1", raw)


def quoted(value: bytes) -> bytes:
    return b"'" + re.sub(rb"(['\\])", rb"\\\1", value) + b"'"


def tokens(data: bytes) -> list[Token]:
    out: list[Token] = []
    at, n = 0, len(data)
    while at < n:
        c = data[at]
        if c in BLANK or c == 0x0B:
            at += 1
            continue
        if c in _STRING and (m := _STRING[c].match(data, at)):
            after = m.end()
            while after < n and data[after] in b" \t\r\f":
                after += 1
            if (out and out[-1].text in _BEFORE) or after == n or data[after] in _AFTER:
                out.append(Token("s", m[0], literal(m[1]), at, m.end()))
                at = m.end()
                continue
        m = _PIECE.match(data, at)
        end = m.end() if m else at + 1
        text = data[at:end]
        kind = "n" if text[:1].isalpha() or text[:1] == b"_" else "d" if text[:1].isdigit() else "o"
        out.append(Token(kind, text, text, at, end))
        at = end
    return out


def _printable(value: bytes | None) -> bool:
    return bool(value) and all(0x20 <= c <= 0x7E for c in value)


def strict_base64(run: bytes) -> bytes | None:
    try:
        return base64.b64decode(run, validate=True) if len(run) % 4 == 0 else None
    except binascii.Error:
        return None


def _hex(text: bytes) -> bytes | None:
    return bytes.fromhex(text.decode()) if text and len(text) % 2 == 0 and re.fullmatch(rb"[0-9A-Fa-f]+", text) else None


class Reducer:
    """held: tokens shifted so far, reduced ones in place of those they stand for. decoded: strings that a decoder gave."""

    def __init__(self):
        self.held: list[Token] = []
        self.decoded: list[Token] = []

    def _ends(self, shape: str) -> bool:
        """Whether the list ends in tokens of these kinds, a sign standing for itself."""
        if len(shape) > len(self.held):
            return False
        return all(t.kind == k if k in "sndc" else t.kind == "o" and t.text == k.encode() for k, t in zip(shape, self.held[-len(shape) :], strict=True))

    def _replace(self, count: int, kind: str, value: bytes, text: bytes | None = None) -> bool:
        first, last = self.held[-count], self.held[-1]
        del self.held[-count:]
        self.held.append(Token(kind, quoted(value) if text is None else text, value, first.start, last.end))
        return True

    def _name(self, back: int, *names: bytes) -> bool:
        return len(self.held) >= back and self.held[-back].kind == "n" and self.held[-back].text.lower() in names

    def shift(self, token: Token) -> None:
        self.held.append(token)
        while self.reduce():
            pass

    def reduce(self) -> bool:
        if self._ends("n(d)") and self._name(4, CHR):
            text = self.held[-2].text
            hexadecimal = text[:2].lower() == b"0x"
            if len(text) <= (4 if hexadecimal else 3) and (code := int(text, 16 if hexadecimal else 10)) < 256:
                source = b"".join(t.text for t in self.held[-4:])
                return self._replace(4, "c", bytes([code]), source)
        for join in (".", "+"):
            if self._ends(f"c{join}c") or self._ends(f"s{join}s"):
                return self._replace(3, "s", self.held[-3].value + self.held[-1].value)
        if self._ends("s[::-d]") and self.held[-2].text == b"1":
            return self._replace(7, "s", self.held[-7].value[::-1])
        if self._ends("n(s)"):
            return self._called(self.held[-2].value)
        if self._ends("n(s,s)") and self._name(6, PACK) and self.held[-4].value == b"H*":
            return self._decoded(6, _hex(self.held[-2].value))
        if self._ends("n(n,s)") and self._name(6, GETATTR):
            name = self.held[-4].text + b"." + self.held[-2].value
            return self._replace(6, "n", name, name)
        if self._ends("n(n(s),s)") and self._name(9, GETATTR) and self._name(7, IMPORT):
            name = self.held[-5].value + b"." + self.held[-2].value
            return self._replace(9, "n", name, name)
        if self._ends("s.n()") and self._name(3, b"decode") and self.decoded and self.held[-5] is self.decoded[-1]:
            return self._replace(5, "s", self.held[-5].value)
        return False

    def _decoded(self, count: int, value: bytes | None) -> bool:
        if not _printable(value):
            return False
        self._replace(count, "s", value)
        self.decoded.append(self.held[-1])
        return True

    def _called(self, value: bytes) -> bool:
        """name ( string ) at the end of the list."""
        if self._name(4, REVERSE):
            return self._replace(5 if self._name(5, b"scalar") else 4, "s", value[::-1])
        if self._name(4, *DECODE_BASE64):
            front = 0
            if self.held[-4].text.lower() == DECODE_BASE64[0]:
                own = self.held[:-4]
                if len(own) >= 2 and own[-1].text == b"." and own[-2].text.lower() == BASE64_MODULE:
                    front = 2
                elif len(own) >= 5 and own[-1].text == b"." and own[-2].text == b")" and own[-3].value == BASE64_MODULE and own[-5].text == IMPORT:
                    front = 5
                else:
                    return False
            return self._decoded(4 + front, strict_base64(value))
        if self._name(4, *DECODE_HEX) and len(self.held) >= 6 and self.held[-5].text == b"." and self.held[-6].text.lower() == b"bytes":
            return self._decoded(6, _hex(value))
        return False


def _joined(data: bytes, kept: list[Token]) -> bytes:
    out, at = [], 0
    for t in kept:
        out += [data[at : t.start], t.text]
        at = t.end
    return b"".join([*out, data[at:]])


def reduced(data: bytes) -> bytes:
    machine = Reducer()
    for t in tokens(data):
        machine.shift(t)
    return _joined(data, machine.held)


def _assignments(data: bytes, all_: list[Token]) -> list[tuple[bytes, bytes | None]]:
    """Names that lines assign to, in order: with the literal, if that is all the line assigns."""
    out = []
    first = True
    for k, t in enumerate(all_):
        first = k == 0 or b"\n" in data[all_[k - 1].end : t.start]
        if not first:
            continue
        at = k + 1 if t.text in DECLARING else k
        at += at < len(all_) and all_[at].text == b"$"
        if at + 2 >= len(all_) or all_[at].kind != "n" or all_[at + 1].text != b"=" or all_[at + 2].text == b"=":
            continue
        value, end = all_[at + 2], at + 3
        end += end < len(all_) and all_[end].text == b";" and b"\n" not in data[value.end : all_[end].start]
        alone = value.kind == "s" and b"\n" not in data[all_[at].start : value.start] and (end == len(all_) or b"\n" in data[all_[end - 1].end : all_[end].start])
        out.append((all_[at].text, value.value if alone else None))
    return out


def constants(data: bytes, all_: list[Token] | None = None) -> dict[bytes, bytes]:
    """Names that are assigned once, to a literal of fit length; in order of names."""
    assigned = _assignments(data, tokens(data) if all_ is None else all_)
    times: dict[bytes, int] = {}
    for name, _ in assigned:
        times[name] = times.get(name, 0) + 1
    return {n: v for n, v in sorted((n, v) for n, v in assigned if v is not None and times[n] == 1) if len(v) in CONSTANT_LENGTHS}


def propagated(data: bytes) -> bytes:
    """Constants put in where they are called, and where getattr looks them up."""
    all_ = tokens(data)
    known = constants(data, all_)
    if not known:
        return data
    out = []
    for k, t in enumerate(all_):
        follows = all_[k + 1].text if k + 1 < len(all_) else b""
        if t.kind == "n" and t.text in known and follows == b"(":
            start = t.start
            if out and out[-1].text == b"$" and out[-1].end == t.start:
                start = out.pop().start
            t = Token("n", known[t.text], known[t.text], start, t.end)
        elif t.kind == "n" and t.text in known and follows == b")" and k and all_[k - 1].text == b"," and _in_getattr(all_, k - 1):
            t = Token("s", quoted(known[t.text]), known[t.text], t.start, t.end)
        out.append(t)
    return _joined(data, out)


def _in_getattr(all_: list[Token], comma: int) -> bool:
    """Whether the comma parts the two arguments of getattr."""
    depth = 0
    for k in range(comma - 1, max(-1, comma - 40), -1):
        text = all_[k].text
        if text == b")":
            depth += 1
        elif text == b"(" and depth:
            depth -= 1
        elif text == b"(":
            return k > 0 and all_[k - 1].text == GETATTR
        elif text == b"," and not depth:
            return False
    return False


_WORDS = (REVERSE, CHR, PACK, GETATTR, *DECODE_BASE64, *DECODE_HEX)
_BESIDE = re.compile(rb"['\"][" + BLANK + rb"]*[.+\[]|=[" + BLANK + rb"]*['\"]")


def may_fold(data: bytes) -> bool:
    """A quick test that no source that folding changes fails."""
    low = data.lower()
    return any(w in low for w in _WORDS) or bool(_BESIDE.search(data))


def folded(data: bytes) -> bytes:
    if not 0 < len(data) <= FOLD_BYTES or not may_fold(data):
        return data
    for _ in range(FOLD_PASSES):
        now = propagated(reduced(data))
        if now == data:
            break
        data = now
    return data
