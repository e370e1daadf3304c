"""Messages from their pieces, and parsed messages back to text."""

from __future__ import annotations

import hashlib
import mimetypes

from lettermill.kernels.body import encode_body
from lettermill.kernels.headers import encode_header, fix_content_type

# Types of compressed files, which the table of types gives as encodings; first bytes of images and sounds.
COMPRESSED = {".bz2": ("application", "x-bzip2"), ".gz": ("application", "x-gzip")}
MAGIC = [
    (0, b"\x89PNG\r\n\x1a\n", ("image", "png")), (0, b"\xff\xd8\xff", ("image", "jpeg")), (0, b"GIF87a", ("image", "gif")), (0, b"GIF89a", ("image", "gif")), (0, b"BM", ("image", "bmp")),
    (0, b"II*\x00", ("image", "tiff")), (0, b"MM\x00*", ("image", "tiff")), (8, b"WEBP", ("image", "webp")), (8, b"WAVE", ("audio", "x-wav")), (8, b"AIFF", ("audio", "x-aiff")), (0, b".snd", ("audio", "basic")),
]


def detect_type(main: str, sub: str, body: bytes | None = None, filename: str | None = None) -> tuple[str, str]:
    """A better type for octet streams by file name, for images and sounds by their first bytes."""
    if (main, sub) == ("application", "octet-stream") and filename:
        for ending, kind in COMPRESSED.items():
            if filename.lower().endswith(ending):
                return kind
        guess = mimetypes.guess_type(filename)[0]
        if guess:
            main, sub = guess.split("/", 1)
    if main in ("image", "audio") and body:
        return next((k for at, magic, k in MAGIC if k[0] == main and body[at : at + len(magic)] == magic), (main, sub))
    return main, sub


def boundary_for(key: str) -> str:
    return "=_" + hashlib.sha256(key.encode()).hexdigest()[:32]


def leaf(content_type: str, body: str | bytes, filename: str | None = None, disposition: str | None = None, charset: str | None = None) -> str:
    """One part with its headers."""
    main, sub = fix_content_type(content_type)
    main, sub = detect_type(main, sub, body if isinstance(body, bytes) else None, filename)
    if isinstance(body, str) and main != "text":
        body = body.encode()
    if isinstance(body, bytes) and main == "text":
        try:
            body = body.decode(charset or "utf-8")
        except (UnicodeDecodeError, LookupError):
            main, sub = "application", "octet-stream"
    disposition = disposition or ("attachment" if filename else None)
    used, encoding, text = encode_body(body, main, charset, attachment=disposition == "attachment")
    params = ({"charset": used} if used and main == "text" else {}) | ({"name": filename} if filename else {})
    head = [f"Content-Type: {encode_header('Content-Type', f'{main}/{sub}', params)}"]
    if disposition:
        head.append(f"Content-Disposition: {encode_header('Content-Disposition', disposition, {'filename': filename} if filename else {})}")
    head.append(f"Content-Transfer-Encoding: {encoding}")
    return "\r\n".join(head) + "\r\n\r\n" + text


def multipart(subtype: str, parts: list[str], key: str) -> str:
    b = boundary_for(key)
    return f'Content-Type: multipart/{subtype}; boundary="{b}"\r\n\r\n' + "".join(f"--{b}\r\n{p}\r\n" for p in parts) + f"--{b}--\r\n"


def message_container(message: str) -> str:
    return "Content-Type: message/rfc822\r\nContent-Disposition: attachment\r\n\r\n" + message
