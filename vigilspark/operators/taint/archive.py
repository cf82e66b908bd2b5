"""ZIP archives read strictly: what the central directory says of a member must be what stands at the member.

Only one end record may fit, every local header must agree with its central one, data descriptors must agree with both, and
no two members may share bytes. A member that fails is an entry with an error; a container that fails is an error."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

STORED, DEFLATED = 0, 8
END, END64, LOCATOR64, CENTRAL, LOCAL, DESCRIPTOR = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04", b"PK\x07\x08"
ENCRYPTED, DESCRIBED = 1, 8
_MOST16, _MOST32 = 0xFFFF, 0xFFFFFFFF


class BadArchive(ValueError):
    """The container itself can't be trusted."""


@dataclass
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int
    data: int = 0
    error: str | None = None

    @property
    def is_dir(self) -> bool:
        return self.name.endswith("/")


def _end(data: bytes) -> tuple[int, int, int, int]:
    """(entries, size and offset of the central directory, where it must end)."""
    fits = []
    at = data.rfind(END)
    least = max(0, len(data) - 22 - _MOST16)
    while at >= least:
        if at + 22 <= len(data) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] == len(data):
            fits.append(at)
        at = data.rfind(END, 0, at) if at > 0 else -1
    if len(fits) != 1:
        raise BadArchive("no end record" if not fits else "more than one end record")
    at = fits[0]
    disk, first, here, entries, size, offset = struct.unpack_from("<HHHHII", data, at + 4)
    if disk or first or here != entries:
        raise BadArchive("more than one disk")
    if at >= 20 and data[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack_from("<Q", data, at - 12)[0]
        if where + 56 > at - 20 or data[where : where + 4] != END64:
            raise BadArchive("64-bit end record")
        disk, first, here, total, size64, offset64 = struct.unpack_from("<IIQQQQ", data, where + 16)
        if disk or first or here != total:
            raise BadArchive("more than one disk")
        for small, most, large in ((entries, _MOST16, total), (size, _MOST32, size64), (offset, _MOST32, offset64)):
            if small not in (most, large):
                raise BadArchive("the end records disagree")
        return total, size64, offset64, where
    if entries == _MOST16 or size == _MOST32 or offset == _MOST32:
        raise BadArchive("64-bit end record missing")
    return entries, size, offset, at


def _extra64(extra: bytes, wanted: list[bool]) -> list[int] | None:
    """The 64-bit values that a header's extra field holds, for those marked as wanted."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            n = sum(wanted)
            return list(struct.unpack_from(f"<{n}Q", extra, at + 4)) if size >= 8 * n and at + 4 + 8 * n <= len(extra) else None
        at += 4 + size
    return None


def _name(raw: bytes, flags: int) -> str:
    return raw.decode("utf-8" if flags & 0x800 else "cp437")


def _central(data: bytes) -> list[Member]:
    entries, size, offset, end = _end(data)
    if offset + size != end or offset + size > len(data) or entries * 46 > size:
        raise BadArchive("central directory")
    out, at = [], offset
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL or at + 46 > end:
            raise BadArchive("central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, whole, n, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        header = struct.unpack_from("<I", data, at + 42)[0]
        if at + 46 + n + extra + comment > end:
            raise BadArchive("central directory")
        wanted = [whole == _MOST32, packed == _MOST32, header == _MOST32]
        if any(wanted):
            found = _extra64(data[at + 46 + n : at + 46 + n + extra], wanted)
            if found is None:
                raise BadArchive("64-bit sizes missing")
            values = iter(found)
            whole, packed, header = (next(values) if w else v for w, v in zip(wanted, (whole, packed, header), strict=True))
        try:
            name = _name(data[at + 46 : at + 46 + n], flags)
        except UnicodeDecodeError:
            raise BadArchive("a name is no text") from None
        out.append(Member(name, method, flags, crc, packed, whole, header))
        at += 46 + n + extra + comment
    if at != end:
        raise BadArchive("central directory")
    return out


def _locate(data: bytes, m: Member, limit: int) -> str | None:
    """Fills in where a member's data begins; what is wrong with it, if anything."""
    at = m.header
    if at + 30 > limit or data[at : at + 4] != LOCAL:
        return "no local header"
    flags, method = struct.unpack_from("<HH", data, at + 6)
    crc, packed, whole, n, extra = struct.unpack_from("<IIIHH", data, at + 14)
    m.data = at + 30 + n + extra
    end = m.data + m.packed
    if end > limit:
        return "data beyond the directory"
    try:
        name = _name(data[at + 30 : at + 30 + n], flags)
    except UnicodeDecodeError:
        return "names disagree"
    if name != m.name or method != m.method or flags != m.flags:
        return "headers disagree"
    if packed == _MOST32 or whole == _MOST32:
        found = _extra64(data[at + 30 + n : m.data], [True, True])
        if found is None:
            return "headers disagree"
        whole, packed = found
    if flags & DESCRIBED:
        if (crc, packed, whole) not in ((0, 0, 0), (m.crc, m.packed, m.size)):
            return "headers disagree"
        start = end + 4 if data[end : end + 4] == DESCRIPTOR else end
        short, long = data[start : start + 12], data[start : start + 20]
        if short != struct.pack("<III", m.crc, m.packed & _MOST32, m.size & _MOST32) and long != struct.pack("<IQQ", m.crc, m.packed, m.size):
            return "descriptor disagrees"
    elif (crc, packed, whole) != (m.crc, m.packed, m.size):
        return "headers disagree"
    if m.method == STORED and m.packed != m.size:
        return "headers disagree"
    return None


def members(data: bytes, priority: Callable[[str], int] = lambda name: 0) -> list[Member]:
    """All members by priority, then name; those with an error are not to be read. Raises BadArchive."""
    found = _central(data)
    limit = _end(data)[2]
    for m in found:
        m.error = _locate(data, m, limit)
    spans = sorted((m for m in found if not m.error), key=lambda m: m.header)
    for a, b in zip(spans, spans[1:], strict=False):
        if a.data + a.packed > b.header:
            a.error = b.error = "members overlap"
    return sorted(found, key=lambda m: (priority(m.name), m.name, m.header))


def read(data: bytes, m: Member) -> bytes:
    """A member's bytes, checked against its size and sum. Raises ValueError."""
    if m.error:
        raise ValueError(m.error)
    packed = data[m.data : m.data + m.packed]
    if m.method == STORED:
        out = packed
    else:
        machine = zlib.decompressobj(-15)
        try:
            out = machine.decompress(packed, m.size + 1)
        except zlib.error as e:
            raise ValueError(str(e)) from None
        if not machine.eof or machine.unused_data:
            raise ValueError("compressed data of another length")
    if len(out) != m.size or zlib.crc32(out) != m.crc:
        raise ValueError("another size or sum")
    return out
