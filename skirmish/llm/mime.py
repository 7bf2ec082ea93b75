"""Mail messages into decoded text parts.

A small reader for damaged archives: folded headers, mbox lines, CRLF, nested
multiparts, boundaries that are never closed, cut-off base64, unknown charsets.
It never raises on input; what cannot be decoded is replaced.
"""

from __future__ import annotations

import binascii
import codecs
import html
import re
from dataclasses import dataclass

_HEADER = re.compile(r"^([!-9;-~]+)[ \t]*:[ \t]*(.*)$")
_PARAM = re.compile(r""";\s*([\w*-]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^;\s]*)""")
_NOT64 = re.compile(rb"[^A-Za-z0-9+/]")


@dataclass(slots=True)
class Part:
    """A leaf of a message."""

    kind: str
    attached: bool
    text: str


def _charset(name: str) -> str:
    try:
        found = codecs.lookup(name or "utf-8").name
    except (LookupError, ValueError):
        return "utf-8"
    if found == "iso8859-1":
        return "cp1252" if (name or "").lower().startswith(("windows", "cp")) else "latin-1"
    return found


def _bytes_of(body: str, charset: str) -> bytes:
    try:
        return body.encode("ascii")
    except UnicodeEncodeError:
        return body.encode(charset, "replace")


def decode_body(body: str, encoding: str, charset: str) -> str:
    """Undo a transfer encoding and charset; 7bit, 8bit, binary and unknown ones are the text itself."""
    cs = _charset(charset)
    if encoding == "base64":
        raw = body.encode("ascii", "ignore")
        end = raw.find(b"=")
        data = _NOT64.sub(b"", raw if end < 0 else raw[:end])
        if len(data) % 4 == 1:
            data = data[:-1]
        out = binascii.a2b_base64(data + b"=" * (-len(data) % 4))
    elif encoding == "quoted-printable":
        out = binascii.a2b_qp(_bytes_of(body, cs))
    else:
        return body
    return out.decode(cs, "replace")


def _headers(block: str) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in block.split("\n"):
        if line[:1] in (" ", "\t"):
            if name:
                out[name] += " " + line.strip()
            continue
        m = _HEADER.match(line)
        name = None
        if m:
            name = m[1].lower()
            if name in out:
                name = None
            else:
                out[name] = m[2].strip()
    return out


def _params(value: str) -> dict[str, str]:
    out = {}
    for k, v in _PARAM.findall(value):
        if v.startswith('"'):
            v = re.sub(r"\\(.)", r"\1", v[1:-1])
        out[k.lower().rstrip("*")] = v
    return out


def _split(text: str) -> tuple[dict[str, str], str]:
    """Headers and body of an entity; without a header line everything is body."""
    if text.startswith("\n"):
        return {}, text[1:]
    end = text.find("\n\n")
    head = text if end < 0 else text[:end]
    if not _HEADER.match(head.split("\n", 1)[0]):
        return {}, text
    return _headers(head), "" if end < 0 else text[end + 2 :]


def _leaves(entity: str) -> list[Part]:
    """Text leaves of an entity in order, however deep; those within an attached message count as attached."""
    out: list[Part] = []
    todo = [(entity, False)]
    while todo:
        text, within = todo.pop()
        head, body = _split(text)
        ctype = head.get("content-type", "text/plain")
        kind = ctype.split(";", 1)[0].strip().lower() or "text/plain"
        params = _params(ctype)
        encoding = head.get("content-transfer-encoding", "").split(";")[0].strip().lower()
        if kind.startswith("multipart/") and params.get("boundary"):
            pieces = re.split(rf"(?:^|\n)--{re.escape(params['boundary'])}(--)?[ \t]*(?=\n|$)", body)
            # pieces: preamble, closing mark or None, part, ...
            inner = []
            for i in range(1, len(pieces) - 1, 2):
                if pieces[i]:
                    break
                inner.append((pieces[i + 1].removeprefix("\n"), within))
            todo += reversed(inner)
        elif kind == "message/rfc822":
            todo.append((decode_body(body, encoding, "utf-8"), True))
        elif kind in ("text/plain", "text/html"):
            attached = within or head.get("content-disposition", "").strip().lower().startswith("attachment")
            plain = decode_body(body, encoding, params.get("charset", "").strip("'\""))
            if "\r" in plain:
                plain = plain.replace("\r\n", "\n").replace("\r", "\n")
            out.append(Part(kind, attached, plain))
    return out


def text_parts(message: str | None) -> list[Part]:
    """Text leaves (plain and HTML) of a message in order, decoded; null gives none."""
    if not message:
        return []
    t = message
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = t.lstrip("\n﻿")
    if t.startswith(("From ", ">From ")):
        t = t[t.find("\n") + 1 :] if "\n" in t else ""
    return _leaves(t)


_DROP = re.compile(r"<!--.*?(?:-->|$)|<(style|script|head|title)\b[^>]*>.*?(?:</\1\s*>|$)", re.I | re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|<![^>]*>|<\?[^>]*>")
# HTML elements that are blocks.
BLOCKS = frozenset(
    "address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
BLOCK_END = "\u0002"
QUOTE_OPEN = "\u0003"
QUOTE_CLOSE = "\u0004"
_SPACE = re.compile(r"[ \t\n\r\f]+")


def html_text(source: str) -> str:
    """Text of an HTML part: BLOCK_END at block borders, a line feed at <br>, quote marks around blockquotes."""

    def piece(m: re.Match) -> str:
        name = (m[2] or "").lower()
        if name == "br":
            return "\u0005"
        if name == "blockquote":
            return BLOCK_END + (QUOTE_CLOSE if m[1] else QUOTE_OPEN) + BLOCK_END
        return BLOCK_END if name in BLOCKS else ""

    plain = _TAG.sub(piece, _SPACE.sub(" ", _DROP.sub(" ", source)))
    return html.unescape(plain).replace("\u0005", "\n").replace(" ", " ")
