"""Header sections: lines to names, values and parameters, and back."""

from __future__ import annotations

import re
import string
from urllib.parse import quote, unquote_to_bytes

from lettermill.kernels.encodedword import decode_words, encode_unstructured, to_text, unfold

PARAMETRISED = ("Content-Type", "Content-Disposition", "Content-Transfer-Encoding")
ADDRESS_HEADERS = ("From", "To", "Delivered-To", "Cc", "Bcc", "Reply-To", "Sender")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_VALUE = re.compile(r"\s*([^\s;]+(?:\s*/\s*[^\s;]+)?)[^;]*;?", re.S)
_PARAM = re.compile(r"""[\s;]*(?P<key>[^\s=;*]+)(?P<part>\*\d+)?(?P<enc>\*)?\s*=\s*(?P<value>"(?:[^"\\]|\\.)*"|[^\s;"]*(?:[^;"\r\n]*[^\s;"])?)\s*(?=;|$|\s)""", re.S)


def normalize(name: str) -> str:
    return string.capwords(name.lower(), "-")


def fix_content_type(value: str | None) -> tuple[str, str]:
    """Main and sub type of a value that may be broken."""
    if not value:
        return "text", "plain"
    parts = value.lower().split("/")
    if len(parts) >= 2:
        return parts[0].strip(), parts[1].strip()
    return {"text": ("text", "plain"), "html": ("text", "html")}.get(parts[0], ("application", "octet-stream"))


def parameters(text: str) -> dict[str, str]:
    """Parameters of a header value. Pieces `key*0`, `key*1*` that follow one another are one value; percent-encoded
    neighbours are joined before their charset is applied. A later run of the same key replaces an earlier one."""
    runs: list[tuple[str, list[tuple[bool, str]]]] = []
    at = 0
    while (m := _PARAM.match(text, at)) and m.end() > at:
        at = m.end()
        key, piece = m.group("key").lower(), (bool(m.group("enc")), m.group("value"))
        if m.group("part") and runs and runs[-1][0] == key:
            runs[-1][1].append(piece)
        else:
            runs.append((key, [piece]))
    return {key: _joined(pieces) for key, pieces in runs}


def _joined(pieces: list[tuple[bool, str]]) -> str:
    if len(pieces) == 1 and not pieces[0][0]:
        return decode_words(pieces[0][1].strip('"')) or ""
    out, pending = [], ""
    for encoded, value in [*pieces, (False, None)]:
        if encoded and value is not None and not value.startswith('"'):
            pending += value
            continue
        if pending:
            head = pending.split("'", 2)
            out.append(to_text(unquote_to_bytes(head[2]), head[0]) if len(head) == 3 else to_text(unquote_to_bytes(pending)) if "%" in pending else pending)
            pending = ""
        if value is not None:
            out.append(value.strip('"'))
    return "".join(out)


def parametrised(value: str) -> tuple[str | None, dict[str, str]]:
    """`value; key=v` as the value in lower case and its parameters."""
    flat = unfold(value)
    if not (m := _VALUE.match(flat)):
        return None, {}
    return m.group(1).lower(), parameters(flat[m.end() :])


def _in_section(line: str) -> bool:
    """Whether a line belongs to a header section: it carries a header on, is an envelope line, or has a name and its colon."""
    if line[0] in " \t" or line.startswith("From "):
        return True
    name, colon, _ = line.partition(":")
    return bool(colon and name) and name.isascii() and name.isprintable() and " " not in name


def split_section(text: str, start: int = 0, end: int | None = None) -> tuple[list[str], int]:
    """Unfolded header lines from `start`, and where the body begins. A line that is no header begins the body."""
    end = len(text) if end is None else end
    lines: list[list[str]] = []
    at = start
    while at < end:
        m = _LINE.match(text, at, end)
        line = m.group()
        if not line.strip("\r\n"):
            at = m.end()
            break
        if not _in_section(line):
            break
        at = m.end()
        if line[0] in " \t":
            if lines:
                lines[-1].append(line)
        elif not line.startswith("From "):
            lines.append([line])
    return ["".join(x) for x in lines], at


def parse_header(line: str, only: frozenset[str] | None = None) -> tuple | None:
    """(name, raw, value, params) of one header with its folds; null without a colon, or if its name is not in `only`.

    Raises ValueError for a name, or a described value, that is not ASCII.
    """
    name, colon, raw = line.rstrip("\r\n").partition(":")
    if not colon:
        return None
    name, raw = normalize(name.rstrip()), raw.lstrip()
    if only is not None and name not in only:
        return None
    if not name.isascii():
        raise ValueError("the name of a header is not ASCII")
    if name not in PARAMETRISED:
        return name, unfold(raw), decode_words(raw), {}
    value, params = parametrised(raw)
    if name == "Content-Type":
        value = "/".join(fix_content_type(value))
    return name, unfold(raw), value, params


def parse_headers(text: str, start: int = 0, end: int | None = None, only: frozenset[str] | None = None) -> tuple[list[tuple], int]:
    """(name, raw, value, params) of each header in order (of those in `only`), and where the body begins. Values are decoded text."""
    lines, body = split_section(text, start, end)
    return [h for h in (parse_header(line, only) for line in lines) if h is not None], body


def encode_param(key: str, value: str) -> str:
    if value.isascii():
        return f'{key}="{value}"' if re.search(r'[\s;,"()<>@:\\/\[\]?=]', value) or not value else f"{key}={value}"
    return f"{key}*=utf-8''{quote(value, safe='')}"


def encode_header(name: str, value: str | None, params: dict[str, str] | None = None) -> str:
    """The value of a header as it is sent: parametrised, a list of addresses, or folded text."""
    from lettermill.kernels.address import full_spec, parse_discrete_list

    value = (value or "").replace("\r", "").replace("\n", "")
    if name in PARAMETRISED:
        return "; ".join([value, *(encode_param(k, v) for k, v in (params or {}).items())])
    if name in ADDRESS_HEADERS and "@" in value and not value.isascii():
        good, bad, _ = parse_discrete_list(value)
        if good and not bad:
            return "; ".join(full_spec(a[1], a[2], a[3]) or a[4] for a in good)
    return encode_unstructured(name, value)
