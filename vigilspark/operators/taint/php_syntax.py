"""PHP source to trees: a lexer and a precedence-climbing parser that goes on after what it can't read.

Expressions are tuples: ("text", value) ("number", value) ("name", word) ("var", name) ("varvar", e) ("index", base, key or
None) ("member", base, e) ("static", class, e) ("call", callee, arguments) ("method", base, e, arguments) ("new", class,
arguments) ("binary", sign, a, b) ("unary", sign, e) ("assign", sign, target, value) ("choose", c, a, b) ("list", items)
("joined", parts) ("shell", parts) ("include", e) ("eval", e) ("cast", kind, e) ("function", parameters, uses, body).
Statements: ("do", e) ("block", kind, expressions, statements) ("bind", targets) ("function", name, parameters, body)
("foreach", e, targets, statements) ("return", e)."""

from __future__ import annotations

import re
from typing import Any

_OPEN = re.compile(r"<\?(php\b|=)?", re.I)
_TOKEN = re.compile(
    r"""(?P<space>\s+|//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*[\s\S]*?(?:\*/|\Z))|(?P<close>\?>)|(?P<here><<<[ \t]*(?P<mark>["']?)(?P<tag>[A-Za-z_]\w*)(?P=mark)\r?\n)"""
    r"""|(?P<var>\$[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<name>\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[A-Za-z_\x80-\xff][\w\x80-\xff]*)*)|(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)"""
    r"""|(?P<single>'(?:[^'\\]|\\[\s\S])*')|(?P<double>"(?:[^"\\]|\\[\s\S])*")|(?P<shell>`(?:[^`\\]|\\[\s\S])*`)"""
    r"""|(?P<cast>\(\s*(?:int|integer|float|double|real|string|binary|bool|boolean|array|object|unset)\s*\))"""
    r"""|(?P<sign><=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|=>|->|::|\+\+|--|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!.,;:?()\[\]{}&|^~@$\#\\])""",
    re.I,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "f": "\f", "e": "\x1b", "\\": "\\", "$": "$", '"': '"', "`": "`"}
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{1,2}|u\{[0-9A-Fa-f]{1,6}\}|[0-7]{1,3}|[\s\S])")
_INSIDE = re.compile(r"\{\$|\$\{|\$([A-Za-z_]\w*)(\[[^\]\n]{1,80}\]|->[A-Za-z_]\w*)?")
#: Strengths of binary signs; the right-associative ones bind to the right at their own strength.
_STRENGTH = {"or": 1, "xor": 2, "and": 3, "??": 8, "||": 9, "&&": 10, "|": 11, "^": 12, "&": 13, "==": 14, "!=": 14, "<>": 14, "===": 14, "!==": 14, "<=>": 14, "<": 15, ">": 15, "<=": 15, ">=": 15, ".": 16, "<<": 17, ">>": 17, "+": 18, "-": 18, "*": 19, "/": 19, "%": 19, "instanceof": 21, "**": 22}
_ASSIGNS = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??="}
_MODIFIERS = {"abstract", "final", "public", "private", "protected", "static", "readonly", "var"}
MOST_DEPTH = 120


class Broken(ValueError):
    pass


def unescaped(text: str, quote: str = '"') -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] == "x" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c[0] == "u" and len(c) > 1:
            n = int(c[2:-1], 16)
            return chr(n) if n < 0x110000 else m[0]
        if c[0] in "01234567":
            return chr(int(c, 8) & 0xFF)
        return _ESCAPES.get(c, m[0])

    return _ESCAPE.sub(one, text)


def lexed(text: str) -> list[tuple[str, str]]:
    """(kind, text) of all tokens within PHP stretches; markup between them ends a statement."""
    out: list[tuple[str, str]] = []
    at = 0
    while m := _OPEN.search(text, at):
        at = m.end()
        if m[1] == "=":
            out.append(("name", "echo"))
        while at < len(text):
            t = _TOKEN.match(text, at)
            if not t:
                at += 1
                continue
            at = t.end()
            if t["close"]:
                break
            if t["here"]:
                end = re.compile(rf"\n?[ \t]*{t['tag']}\b").search(text, at - 1)
                body = text[at : end.start() if end else len(text)]
                out.append(("single", "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'") if t["mark"] == "'" else ("double", '"' + re.sub(r'(?<!\\)"', '\\"', body) + '"'))
                at = end.end() if end else len(text)
            elif not t["space"]:
                out.append((t.lastgroup if t.lastgroup not in ("mark", "tag") else "here", t[0]))
        else:
            at = len(text)
        out.append(("sign", ";"))
        if at >= len(text):
            break
    return out


class Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = [*tokens, ("end", "")], 0, 0

    # tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def peek(self, n: int = 1) -> str:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)][1]

    def next(self) -> str:
        text = self.text
        if self.kind != "end":
            self.at += 1
        return text

    def sign(self, text: str) -> bool:
        if self.kind == "sign" and self.text == text:
            self.at += 1
            return True
        return False

    def word(self, *texts: str) -> str | None:
        if self.kind == "name" and self.text.lower() in texts:
            return self.next().lower()
        return None

    def want(self, text: str) -> None:
        if not self.sign(text):
            raise Broken(f"expected {text}, found {self.text}")

    # statements

    def program(self) -> list[tuple]:
        out = []
        while self.kind != "end":
            out += self.guarded()
        return out

    def guarded(self) -> list[tuple]:
        """A statement; where it can't be read, what follows the next semicolon or brace is tried."""
        start = self.at
        try:
            return self.statement()
        except (Broken, RecursionError):
            self.depth = 0
            # a short piece is skipped from its start, a long one from where it broke, so no piece is read many times
            self.at = min(start + 1 if self.at - start < 400 else self.at, len(self.tokens) - 1)
            while self.kind != "end" and self.text not in (";", "}", "{"):
                self.at += 1
            if self.kind != "end":
                self.at += 1
            return []

    def body(self, *ends: str) -> list[tuple]:
        """A statement or a block, or the statements up to a word of the alternative syntax."""
        if self.sign("{"):
            out = []
            while self.kind != "end" and not self.sign("}"):
                out += self.guarded()
            return out
        if ends and self.sign(":"):
            out = []
            while self.kind != "end" and not (self.kind == "name" and self.text.lower() in ends):
                out += self.guarded()
            if self.text.lower().startswith("end"):
                self.next()
                self.sign(";")
            return out
        return self.guarded()

    def statement(self) -> list[tuple]:
        if self.sign(";"):
            return []
        if self.kind == "sign" and self.text == "{":
            return [("block", "plain", [], self.body())]
        if self.kind == "sign" and self.text == "#":  # an attribute
            self.next()
            if self.sign("["):
                self.skip("[", "]")
            return []
        if self.kind == "name":
            word = self.text.lower()
            handler = getattr(self, f"_{word}", None) if word in _STATEMENTS else None
            if handler and not (word in ("static", "fn", "function") and self._is_expression(word)):
                self.next()
                return handler()
            if word in ("abstract", "final", "readonly") and self.peek().lower() in ("class", "abstract", "final", "readonly"):
                self.next()
                return self.statement()
            if self.peek() == ":" and self.peek(2) != ":" and word not in ("default", "parent", "self", "static"):
                self.at += 2
                return []
        e = self.expression()
        self.end()
        return [("do", e)]

    def _is_expression(self, word: str) -> bool:
        if word == "static":
            return not self.peek().startswith("$")
        return self.peek() == "(" or (self.peek() == "&" and self.peek(2) == "(")

    def end(self) -> None:
        if not self.sign(";") and self.kind != "end" and self.text != "}":
            raise Broken(f"expected ; found {self.text}")

    def skip(self, opening: str, closing: str) -> None:
        depth = 1
        while depth and self.kind != "end":
            t = self.next()
            depth += (t == opening) - (t == closing)

    def parenthesised(self) -> tuple:
        self.want("(")
        e = self.expression()
        self.want(")")
        return e

    def _if(self) -> list[tuple]:
        out = [("block", "if", [self.parenthesised()], self.body("elseif", "else", "endif"))]
        while True:
            if self.word("elseif") or (self.kind == "name" and self.text.lower() == "else" and self.peek().lower() == "if" and self.next() and self.next()):
                out.append(("block", "if", [self.parenthesised()], self.body("elseif", "else", "endif")))
            elif self.word("else"):
                out.append(("block", "if", [], self.body("endif")))
                return out
            else:
                return out

    def _while(self) -> list[tuple]:
        return [("block", "loop", [self.parenthesised()], self.body("endwhile"))]

    def _do(self) -> list[tuple]:
        inner = self.body()
        tests = [self.parenthesised()] if self.word("while") else []
        self.sign(";")
        return [("block", "loop", tests, inner)]

    def _for(self) -> list[tuple]:
        self.want("(")
        parts = []
        while self.kind != "end" and not self.sign(")"):
            if not (self.sign(";") or self.sign(",")):
                parts.append(self.expression())
        return [("block", "loop", parts, self.body("endfor"))]

    def _foreach(self) -> list[tuple]:
        self.want("(")
        over = self.expression()
        if not self.word("as"):
            raise Broken("expected as")
        targets = [self.reference()]
        if self.sign("=>"):
            targets.append(self.reference())
        self.want(")")
        return [("foreach", over, targets, self.body("endforeach"))]

    def reference(self) -> tuple:
        self.sign("&")
        return self.expression(4)

    def _switch(self) -> list[tuple]:
        test = self.parenthesised()
        if not self.sign("{"):
            self.want(":")
        inner: list[tuple] = []
        while self.kind != "end" and not self.sign("}") and not self.word("endswitch"):
            if self.word("case"):
                inner.append(("do", self.expression()))
                _ = self.sign(":") or self.sign(";")
            elif self.word("default"):
                _ = self.sign(":") or self.sign(";")
            else:
                inner += self.guarded()
        return [("block", "switch", [test], inner)]

    def _try(self) -> list[tuple]:
        out = [("block", "try", [], self.body())]
        while self.word("catch"):
            self.want("(")
            bound = []
            while self.kind != "end" and not self.sign(")"):
                if self.kind == "var":
                    bound.append(("var", self.text[1:]))
                self.next()
            out += [("bind", bound), ("block", "catch", [], self.body())]
        if self.word("finally"):
            out.append(("block", "finally", [], self.body()))
        return out

    def _function(self) -> list[tuple]:
        self.sign("&")
        name = self.next()
        parameters = self.parameters()
        self.result_type()
        return [("function", name, parameters, self.body())]

    def parameters(self) -> list[tuple]:
        self.want("(")
        out, depth = [], 1
        while depth and self.kind != "end":
            if self.kind == "var" and depth == 1:
                name = self.next()[1:]
                out.append((name, self.expression(4) if self.sign("=") else None))
                continue
            t = self.next()
            depth += (t in ("(", "[")) - (t in (")", "]"))
        return out

    def result_type(self) -> None:
        if self.sign(":"):
            while self.kind == "name" or self.text in ("?", "|", "&", "(", ")"):
                self.next()

    def _class(self) -> list[tuple]:
        while self.kind != "end" and self.text not in ("{", ";"):
            self.next()
        out: list[tuple] = []
        if not self.sign("{"):
            return out
        while self.kind != "end" and not self.sign("}"):
            if self.sign("#") and self.sign("["):
                self.skip("[", "]")
            elif self.kind == "name" and self.text.lower() in _MODIFIERS:
                self.next()
            elif self.word("function"):
                self.sign("&")
                name = self.next()
                parameters = self.parameters()
                self.result_type()
                inner = self.body() if self.text == "{" else []
                out.append(("function", f"->{name}", parameters, inner))
            elif self.kind == "var":
                name = self.next()[1:]
                if self.sign("="):
                    out.append(("do", ("assign", "=", ("member", ("var", "this"), ("text", name)), self.expression())))
            else:
                self.next()
        return out

    _interface = _trait = _enum = _class

    def _return(self) -> list[tuple]:
        e = None if self.text in (";", "}") or self.kind == "end" else self.expression()
        self.end()
        return [("return", e)]

    def _echo(self) -> list[tuple]:
        out = [("do", self.expression())]
        while self.sign(","):
            out.append(("do", self.expression()))
        self.end()
        return out

    def _global(self) -> list[tuple]:
        out = []
        while self.kind != "end" and not self.sign(";"):
            if self.kind == "var":
                out.append(("var", self.text[1:]))
            self.next()
        return [("bind", out)]

    def _static(self) -> list[tuple]:
        out: list[tuple] = []
        while self.kind == "var":
            name = ("var", self.next()[1:])
            out.append(("do", ("assign", "=", name, self.expression(4))) if self.sign("=") else ("bind", [name]))
            self.sign(",")
        self.end()
        return out

    def _skipped(self) -> list[tuple]:
        while self.kind != "end" and self.text not in (";", "{"):
            self.next()
        self.sign(";")
        return []

    _namespace = _use = _goto = _break = _continue = _declare = _skipped

    def _const(self) -> list[tuple]:
        out = []
        while self.kind == "name":
            name = self.next()
            if self.sign("="):
                out.append(("do", ("call", ("name", "define"), [("text", name), self.expression(4)])))
            self.sign(",")
        self.end()
        return out

    # expressions

    def expression(self, least: int = 0) -> tuple:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Broken("too deep")
        left = self.prefix()
        while True:
            sign = self.text.lower() if self.kind == "name" else self.text
            if self.kind == "sign" and sign in _ASSIGNS and least <= 5:
                self.next()
                self.sign("&")
                left = ("assign", sign, left, self.expression(4))
            elif self.kind == "sign" and sign == "?" and least <= 7:
                self.next()
                if self.sign(":"):
                    left = ("choose", left, left, self.expression(8))
                else:
                    yes = self.expression(4)
                    self.want(":")
                    left = ("choose", left, yes, self.expression(8))
            elif self.kind in ("sign", "name") and sign in _STRENGTH and _STRENGTH[sign] >= least and (self.kind == "name") == sign.isalpha():
                self.next()
                strength = _STRENGTH[sign]
                left = ("binary", sign, left, self.expression(strength if sign in ("??", "**") else strength + 1))
            else:
                break
        self.depth -= 1
        return left

    def prefix(self) -> tuple:
        kind, text = self.kind, self.text
        if kind == "cast":
            self.next()
            return ("cast", text.strip("() \t\r\n").lower(), self.expression(20))
        if kind == "sign" and text in ("!", "-", "+", "~", "@", "&", "++", "--"):
            self.next()
            inner = self.expression(14 if text == "!" and False else 20)
            return inner if text in ("@", "&") else ("unary", text, inner)
        if kind == "name":
            word = text.lower()
            if word in ("include", "require", "include_once", "require_once"):
                self.next()
                return ("include", self.expression(4))
            if word in ("print", "throw", "clone", "yield"):
                self.next()
                self.word("from")
                return ("unary", word, ("list", []) if self.text in (";", ")", ",", "]") else self.expression(4))
            if word == "new":
                return self.postfix(self.created())
        return self.postfix(self.primary())

    def created(self) -> tuple:
        self.next()
        if self.word("class"):
            arguments = self.arguments() if self.text == "(" else []
            return ("new", ("name", "class"), [*arguments, ("function", [], [], self._class())])
        if self.kind == "name":
            what: tuple = ("name", self.next())
        elif self.sign("("):
            what = self.expression()
            self.want(")")
        else:
            what = self.primary()
            while self.text in ("->", "::", "["):
                what = self.suffix(what)
        return ("new", what, self.arguments() if self.text == "(" and self.kind == "sign" else [])

    def primary(self) -> tuple:
        kind, text = self.kind, self.next()
        if kind == "var":
            return ("var", text[1:])
        if kind == "number":
            return ("number", text.replace("_", ""))
        if kind == "single":
            return ("text", re.sub(r"\\([\\'])", r"\1", text[1:-1]))
        if kind == "double":
            return self.interpolated(text[1:-1], "joined")
        if kind == "shell":
            return self.interpolated(text[1:-1], "shell")
        if kind == "name":
            word = text.lower()
            if word == "array" and self.text == "(":
                self.next()
                return ("list", self.items(")"))
            if word == "list" and self.text == "(":
                self.next()
                return ("list", self.items(")"))
            if word in ("function", "fn") or (word == "static" and self.text.lower() in ("function", "fn")):
                return self.closure(self.next().lower() if word == "static" else word)
            if word == "match" and self.text == "(":
                return self.matched()
            if word == "eval" and self.text == "(":
                return ("eval", self.parenthesised())
            if word in ("exit", "die") and self.text != "(":
                return ("call", ("name", word), [])
            return ("name", text)
        if text == "(":
            inner = self.expression()
            self.want(")")
            return inner
        if text == "[":
            return ("list", self.items("]"))
        if text == "$":
            if self.sign("{"):
                inner = self.expression()
                self.want("}")
                return ("varvar", inner)
            return ("varvar", self.primary())
        raise Broken(f"unexpected {text}")

    def closure(self, word: str) -> tuple:
        self.sign("&")
        parameters = self.parameters()
        uses: list[tuple] = []
        if self.word("use"):
            uses = [("var", n) for n, _ in self.parameters()]
        self.result_type()
        if word == "fn":
            self.want("=>")
            return ("function", parameters, uses, [("return", self.expression(4))])
        return ("function", parameters, uses, self.body())

    def matched(self) -> tuple:
        test = self.parenthesised()
        self.want("{")
        out = [test]
        while self.kind != "end" and not self.sign("}"):
            if self.sign(",") or self.sign("=>") or self.word("default"):
                continue
            out.append(self.expression(4))
        return ("list", out)

    def items(self, closing: str) -> list[tuple]:
        out = []
        while self.kind != "end" and not self.sign(closing):
            if self.sign(",") or self.sign("&") or self.sign("..."):
                continue
            e = self.expression(4)
            out.append(e)
            if self.sign("=>"):
                self.sign("&")
                out.append(self.expression(4))
        return out

    def arguments(self) -> list[tuple]:
        self.want("(")
        out = []
        while self.kind != "end" and not self.sign(")"):
            if self.sign(",") or self.sign("...") or self.sign("&"):
                continue
            if self.kind == "name" and self.peek() == ":" and self.peek(2) != ":":
                self.at += 2
            out.append(self.expression(4))
        return out

    def postfix(self, e: tuple) -> tuple:
        while self.kind == "sign" and self.text in ("(", "[", "{", "->", "?->", "::", "++", "--"):
            if self.text == "{" and e[0] not in ("var", "index", "varvar"):
                break
            if self.text == "{" and self.tokens[self.at - 1][1] == ")":
                break
            if self.text in ("++", "--"):
                e = ("unary", self.next(), e)
                continue
            if self.text == "(":
                e = ("call", e, self.arguments())
            else:
                e = self.suffix(e)
        return e

    def suffix(self, e: tuple) -> tuple:
        sign = self.next()
        if sign in ("[", "{"):
            closing = "]" if sign == "[" else "}"
            key = None if self.text == closing else self.expression()
            self.want(closing)
            return ("index", e, key)
        if self.sign("{"):
            member = self.expression()
            self.want("}")
        elif self.kind == "name":
            member = ("text", self.next())
        elif self.kind == "var" and sign == "::":
            member = ("var", self.next()[1:])
        else:
            member = self.primary()
        if self.kind == "sign" and self.text == "(":
            return ("method", e, member, self.arguments())
        return ("static" if sign == "::" else "member", e, member)

    def interpolated(self, raw: str, kind: str) -> tuple:
        parts: list[tuple] = []
        at = 0
        for m in _INSIDE.finditer(raw):
            if m.start() < at or (m.start() and raw[m.start() - 1] == "\\" and (m.start() < 2 or raw[m.start() - 2] != "\\")):
                continue
            if raw[at : m.start()]:
                parts.append(("text", unescaped(raw[at : m.start()])))
            if m[0] in ("{$", "${"):
                depth, end = 0, m.start()
                while end < len(raw):
                    depth += (raw[end] == "{") - (raw[end] == "}")
                    end += 1
                    if depth == 0 and raw[end - 1] == "}":
                        break
                inner = raw[m.start() + (1 if m[0] == "{$" else 2) : end - 1]
                source = inner if m[0] == "{$" else ("$" + inner if re.fullmatch(r"[A-Za-z_]\w*(\[.*\])?", inner) else "${" + inner + "}")
                parts.append(embedded(source))
                at = end
            else:
                e: tuple = ("var", m[1])
                if m[2] and m[2][0] == "[":
                    key = m[2][1:-1]
                    e = ("index", e, ("var", key[1:]) if key.startswith("$") else ("text", key.strip("'\"")))
                elif m[2]:
                    e = ("member", e, ("text", m[2][2:]))
                parts.append(e)
                at = m.end()
        if raw[at:]:
            parts.append(("text", unescaped(raw[at:])))
        if kind == "joined" and all(p[0] == "text" for p in parts):
            return ("text", "".join(p[1] for p in parts))
        return (kind, parts)


_STATEMENTS = {n[1:] for n in vars(Parser) if n.startswith("_") and not n.startswith("__") and n[1:] not in ("is_expression", "skipped")}


def embedded(source: str) -> tuple:
    """An expression within a string."""
    try:
        p = Parser(lexed("<?php " + source + ";"))
        return p.expression()
    except (Broken, RecursionError):
        return ("list", [("var", v) for v in re.findall(r"\$(\w+)", source)])


def parsed(text: str) -> list[tuple]:
    return Parser(lexed(text)).program()


def walk(node: Any):
    """All tuples of a tree that name a kind of node, outer ones first."""
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple) and n and isinstance(n[0], str):
            yield n
        if isinstance(n, tuple | list):
            stack.extend(reversed(n))
