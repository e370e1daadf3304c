"""Bodies: transfer encodings and charsets, both ways."""

from __future__ import annotations

import base64
import binascii
import quopri
import re

from lettermill.kernels.encodedword import codec_of, to_text

_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/]")


def decode_base64(raw: bytes) -> bytes:
    """Strictly if possible; else only characters of the alphabet count, and the last group is filled or cut."""
    try:
        return base64.b64decode(raw, validate=False) if not _NOT_BASE64.search(re.sub(rb"[\s=]", b"", raw)) else _recovered(raw)
    except binascii.Error:
        return _recovered(raw)


def _recovered(raw: bytes) -> bytes:
    clean = _NOT_BASE64.sub(b"", raw)
    clean = clean[:-1] if len(clean) % 4 == 1 else clean
    return base64.b64decode(clean + b"=" * (-len(clean) % 4))


def decode_transfer(encoding: str | None, body: str | bytes) -> bytes:
    raw = body.encode("utf-8", "surrogateescape") if isinstance(body, str) else body
    if encoding == "base64":
        return decode_base64(raw)
    return quopri.decodestring(raw) if encoding == "quoted-printable" else raw


def decode_body(body: str | bytes | None, encoding: str | None, main: str | None, sub: str | None, charset: str | None) -> tuple[str | None, bytes | None]:
    """(text, bytes) of a body: text for text types, bytes for others. HTML in UTF-8 keeps its no-break spaces as entities."""
    if body is None:
        return None, None
    raw = decode_transfer(encoding, body)
    if main not in ("text", "message"):
        return None, raw
    text = body if isinstance(body, str) and encoding not in ("base64", "quoted-printable") else to_text(raw, charset)
    return (text.replace("\xa0", "&nbsp;") if sub == "html" and codec_of(charset) == "utf-8" else text), None


def has_long_lines(raw: bytes, longest: int = 599) -> bool:
    return any(len(line) >= longest for line in raw.splitlines())


def stronger(a: str, b: str) -> str:
    """The stronger of two transfer encodings; unknown ones are weakest."""
    weight = {"7bit": 0, "quoted-printable": 1, "base64": 1, "8bit": 3}
    return a if weight.get(a, -1) > weight.get(b, -1) else b


def choose_text_encoding(charset: str, preferred: str, raw: bytes) -> str:
    if charset in ("ascii", "iso-8859-1", "us-ascii"):
        return stronger(preferred, "quoted-printable") if has_long_lines(raw) else preferred
    return stronger(preferred, "quoted-printable")


def fix_leading_dots(text: str) -> str:
    """A dot that begins a line of quoted-printable is written `=2E`; a line that gets too long is cut where no code is split."""
    out = []
    for line in text.split("\n"):
        end = "\r" if line.endswith("\r") else ""
        line = line[: len(line) - len(end)]
        if line.startswith("."):
            line = "=2E" + line[1:]
            if len(line) > 76:
                cut = len(line) // 2
                while cut > 3 and "=" in line[cut - 2 : cut]:
                    cut -= 1
                line = line[:cut] + "=" + (end or "") + "\n" + line[cut:]
                head, _, tail = line.partition("\n")
                line = head + "\n" + ("=2E" + tail[1:] if tail.startswith(".") else tail)
        out.append(line + end)
    return "\n".join(out)


def encode_body(text: str | bytes, main: str = "text", charset: str | None = None, preferred: str = "7bit", attachment: bool = False) -> tuple[str | None, str, str]:
    """(charset, transfer encoding, encoded body): the preferred charset if it has all characters, else UTF-8; base64 for attachments and what is no text."""
    if isinstance(text, bytes):
        return None, "base64", base64.encodebytes(text).decode().replace("\n", "\r\n")
    used = charset or "ascii"
    try:
        raw = text.encode(codec_of(used) if used != "ascii" else "ascii")
    except UnicodeEncodeError:
        used, raw = "utf-8", text.encode()
    if main != "text" or attachment:
        return used, "base64", base64.encodebytes(raw).decode().replace("\n", "\r\n")
    encoding = choose_text_encoding(used, preferred, raw)
    if encoding == "quoted-printable":
        return used, encoding, fix_leading_dots(quopri.encodestring(raw).decode("ascii"))
    if encoding == "base64":
        return used, encoding, base64.encodebytes(raw).decode().replace("\n", "\r\n")
    return used, encoding, raw.decode("latin-1") if used != "utf-8" else text
