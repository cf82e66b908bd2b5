"""Class files and archives made from rows, so that queries run the readers and analyses over real bytes.

A method is a list of steps: ("call", owner, name, descriptor, kind), ("load", slot), ("store", slot), ("text", value), ("new",
class), ("get", owner, field) and ("put", owner, field), or one of "null", "dup", "pop", "return", "areturn". Classes come
out the same for the same rows."""

from __future__ import annotations

import io
import struct
import zipfile

_CALLS = {"virtual": 0xB6, "special": 0xB7, "static": 0xB8, "interface": 0xB9}
_PLAIN = {"null": b"\x01", "dup": b"\x59", "pop": b"\x57", "return": b"\xb1", "areturn": b"\xb0"}


class Pool:
    """A constant pool that hands out places."""

    def __init__(self):
        self.entries: list[bytes] = []
        self.at: dict[bytes, int] = {}

    def place(self, entry: bytes) -> int:
        if entry not in self.at:
            self.entries.append(entry)
            self.at[entry] = len(self.entries)
        return self.at[entry]

    def utf8(self, text: str) -> int:
        raw = text.encode()
        return self.place(b"\x01" + struct.pack(">H", len(raw)) + raw)

    def name(self, text: str) -> int:
        return self.place(b"\x07" + struct.pack(">H", self.utf8(text)))

    def text(self, value: str) -> int:
        return self.place(b"\x08" + struct.pack(">H", self.utf8(value)))

    def member(self, tag: int, owner: str, name: str, descriptor: str) -> int:
        kind = self.place(b"\x0c" + struct.pack(">HH", self.utf8(name), self.utf8(descriptor)))
        return self.place(bytes([tag]) + struct.pack(">HH", self.name(owner), kind))


def _code(pool: Pool, steps: list) -> bytes:
    out = b""
    for step in steps:
        if isinstance(step, str):
            out += _PLAIN[step]
        elif step[0] == "call":
            _, owner, name, descriptor, kind = step
            at = pool.member(11 if kind == "interface" else 10, owner, name, descriptor)
            out += bytes([_CALLS[kind]]) + struct.pack(">H", at) + (b"\x02\x00" if kind == "interface" else b"")
        elif step[0] in ("load", "store"):
            out += bytes([0x19 if step[0] == "load" else 0x3A, step[1]])
        elif step[0] == "text":
            out += b"\x13" + struct.pack(">H", pool.text(step[1]))
        elif step[0] == "new":
            out += b"\xbb" + struct.pack(">H", pool.name(step[1]))
        else:
            out += bytes([0xB2 if step[0] == "get" else 0xB3]) + struct.pack(">H", pool.member(9, step[1], step[2], "Ljava/lang/String;"))
    return out


def class_file(own: str, methods: list[tuple[str, str, list]]) -> bytes:
    """A class of static methods (name, descriptor, steps)."""
    pool = Pool()
    this, parent, attribute = pool.name(own), pool.name("java/lang/Object"), pool.utf8("Code")
    out = []
    for name, descriptor, steps in methods:
        code = _code(pool, steps)
        body = struct.pack(">HHI", 16, 16, len(code)) + code + b"\0\0\0\0"
        out.append(struct.pack(">HHHHHI", 9, pool.utf8(name), pool.utf8(descriptor), 1, attribute, len(body)) + body)
    head = b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, len(pool.entries) + 1) + b"".join(pool.entries)
    return head + struct.pack(">HHHHHH", 9, this, parent, 0, 0, len(out)) + b"".join(out) + b"\0\0"


def archive(members: list[tuple[str, bytes]]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)
    return held.getvalue()


STRING = "Ljava/lang/String;"
_PARAMETER = ("call", "javax/servlet/http/HttpServletRequest", "getParameter", f"({STRING}){STRING}", "interface")
_EXEC = ("call", "java/lang/Runtime", "exec", f"({STRING})Ljava/lang/Process;", "virtual")
_RUNTIME = ("call", "java/lang/Runtime", "getRuntime", "()Ljava/lang/Runtime;", "static")


def flow_classes(variant: int) -> list[tuple[str, bytes]]:
    """Small applications: request data goes to a process start straight (0), through a method of another class (1), not at all
    (2), through a field (3), as the result of a method that reads the request (4), or only a constant does (5)."""
    ask = [("load", 0), ("text", "q"), _PARAMETER]
    start = [_RUNTIME, ("load", 1), _EXEC, "pop", "return"]
    serve = ("serve", "(Ljavax/servlet/http/HttpServletRequest;)V")
    helper = ("run", f"({STRING})V", [_RUNTIME, ("load", 0), _EXEC, "pop", "return"])
    reader = ("read", f"(Ljavax/servlet/http/HttpServletRequest;){STRING}", [*ask, "areturn"])
    to_helper = ("call", "app/Helper", "run", f"({STRING})V", "static")
    bodies = {
        0: [*ask, ("store", 1), *start],
        1: [*ask, to_helper, "return"],
        2: [*ask, "pop", "return"],
        3: [*ask, ("put", "app/Held", "value"), ("get", "app/Held", "value"), ("store", 1), *start],
        4: [("load", 0), ("call", "app/Helper", "read", reader[1], "static"), ("store", 1), *start],
        5: [("text", "date"), ("store", 1), *start],
    }
    return [("app/Serve.class", class_file("app/Serve", [(*serve, bodies[variant])])), ("app/Helper.class", class_file("app/Helper", [helper, reader]))]


FLOWS = {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
