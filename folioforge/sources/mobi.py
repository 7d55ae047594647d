"""MOBI books: the records of a Palm database, unpacked into their HTML."""

from __future__ import annotations

import struct
from typing import Any

from folioforge.sources.html import html_to_text


def unpack_palmdoc(data: bytes) -> bytes:
    """The text of one record in PalmDOC compression."""
    out = bytearray()
    i = 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        else:
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            distance, length = pair >> 3, (pair & 7) + 3
            for _ in range(length):
                out.append(out[-distance])
    return bytes(out)


def _trailing(data: bytes, flags: int) -> int:
    """Bytes at the end of a text record that are no text."""
    size = 0
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            value = 0
            for k, byte in enumerate(reversed(data[max(0, len(data) - size - 4) : len(data) - size])):
                value |= (byte & 0x7F) << (7 * k)
                if byte & 0x80:
                    break
            size += value
    if flags & 1 and size < len(data):
        size += (data[len(data) - size - 1] & 3) + 1
    return size


def read_mobi(content: bytes) -> tuple[list[tuple[str, dict[str, str]]], dict[str, Any]]:
    """The book's text as one element, if it isn't blank, and no metadata of the file."""
    if content[60:68] != b"BOOKMOBI":
        raise ValueError("not a MOBI book")
    (count,) = struct.unpack_from(">H", content, 76)
    starts = [struct.unpack_from(">I", content, 78 + 8 * k)[0] for k in range(count)] + [len(content)]
    records = [content[a:b] for a, b in zip(starts, starts[1:])]
    head = records[0]
    compression, _, _, n_text, _, encryption = struct.unpack_from(">HHIHHH", head)
    if encryption:
        raise ValueError("the book is encrypted")
    if compression not in (1, 2):
        raise ValueError(f"compression {compression} isn't read")
    encoding, flags = "cp1252", 0
    if head[16:20] == b"MOBI":
        length, _, code = struct.unpack_from(">III", head, 20)
        encoding = "utf-8" if code == 65001 else "cp1252"
        if length >= 0xE4 and len(head) >= 0xF4:
            (flags,) = struct.unpack_from(">H", head, 0xF2)
    html = b""
    for record in records[1 : n_text + 1]:
        body = record[: len(record) - _trailing(record, flags)]
        html += unpack_palmdoc(body) if compression == 2 else body
    text = html_to_text(html.decode(encoding, "replace")) or ""
    return ([(text, {"part": "book.html"})] if text.strip() else []), {}
