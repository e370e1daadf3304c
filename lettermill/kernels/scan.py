"""A whole message to its parts, in one pass over its lines.

Lines that matter are content types, lines that begin with `--`, and empty ones. They drive a stack of open parts: a
content type names the part on top, an empty line ends its headers and may open an enclosed message, a boundary that
an open part has declared closes what lies above that part and opens the next one. Parts are slices of the text;
their headers are read where they are, bodies are left to whoever wants them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from email import message_from_string, policy

from lettermill.kernels.encodedword import to_text
from lettermill.kernels.headers import fix_content_type, parametrised, parse_headers

_TYPE_NAME = "content-type:"
_UNPRINTED = re.compile(r"[^\t -~]")
# The limit and the kinds of parts.
#: Lines that matter in one message; more is an error, as no mail has so many parts.
MOST_EVENTS = 5000
MESSAGES = {("message", "rfc822"), ("message", "global"), ("message", "news")}
STATUS = {("message", "delivery-status")}
HEADERS_ONLY = {("text", "rfc822-headers"), ("message", "feedback-report"), ("message", "external-body"), ("message", "disposition-notification")}


class MalformedError(ValueError):
    """The text is no MIME message."""


@dataclass
class Part:
    rel: str
    start: int
    parent: Part | None = None
    main: str = "text"
    sub: str = "plain"
    params: dict[str, str] = field(default_factory=lambda: {"charset": "ascii"})
    named: bool = False
    end: int | None = None
    children: list[Part] = field(default_factory=list)

    @property
    def kind(self) -> tuple[str, str]:
        return self.main, self.sub

    def child(self, rel: str, start: int) -> Part:
        self.children.append(Part(rel, start, self))
        return self.children[-1]


def _folded(text: str, at: int, stop: int) -> tuple[str, int]:
    """The header that begins at `at`, with the lines that carry it on, and where the next line begins. It ends before
    a character that is not printable ASCII."""
    pieces = []
    while True:
        line = text[at:stop].rstrip("\r\n")
        odd = _UNPRINTED.search(line)
        pieces.append(line[: odd.start()] if odd else line)
        at, stop = stop, text.find("\n", stop) + 1 or len(text)
        if odd or text[at : at + 1] not in (" ", "\t"):
            return "".join(pieces), at


def scan(text: str) -> Part:
    """The root part. Raises MalformedError for a multipart without boundary or without a first one, and for status reports that stand alone.

    Header sections are walked line by line; in a body the search jumps from one line that begins with `--` to the next.
    """
    root = Part("root", 0)
    stack, in_headers, events, at = [root], True, 0, 0
    while at < len(text):
        if not in_headers and not text.startswith("--", at):
            at = text.find("\n--", at) + 1
            if not at:
                break
        stop = text.find("\n", at) + 1 or len(text)
        top, begin, at = stack[-1], at, stop
        if text.startswith("--", begin):
            events += 1
            in_headers = _boundary(text, begin, stop, stack, in_headers)
        elif text[begin:stop] in ("\n", "\r\n"):
            if top.rel == "headers":
                continue
            in_headers = False
            if top.kind in STATUS and not (top.parent and top.parent.main == "multipart"):
                raise MalformedError("status report that stands alone")
            if top.kind in MESSAGES or top.kind in HEADERS_ONLY:
                stack.append(top.child("enclosed" if top.kind in MESSAGES else "headers", stop))
                in_headers = True
        elif text[begin : begin + len(_TYPE_NAME)].lower() == _TYPE_NAME:
            events += 1
            if not top.named:
                line, at = _folded(text, begin, stop)
                value, params = parametrised(line[len(_TYPE_NAME) :].strip())
                top.main, top.sub = fix_content_type(value)
                top.params, top.named = params, True
                if top.main == "multipart" and not params.get("boundary") and top.rel != "headers":
                    raise MalformedError("multipart without boundary")
        if events > MOST_EVENTS:
            raise MalformedError("too many parts")
    for p in stack:
        p.end = len(text) if p.end is None else p.end
    _check(root)
    return root


def _boundary(text: str, begin: int, stop: int, stack: list[Part], in_headers: bool) -> bool:
    """What the line at `begin` does if an open part has declared it: it ends what lies above that part, and the part
    itself if it is the last one, else it opens the next. Returns whether headers follow."""
    line = text[begin:stop].rstrip("\t\r\n")[2:]
    for depth in range(len(stack) - 1, -1, -1):
        p = stack[depth]
        declared = p.params.get("boundary") if p.named and p.main == "multipart" and p.rel != "headers" else None
        if declared is None or line not in (declared, declared + "--"):
            continue
        for above in stack[depth + 1 :]:
            above.end = _line_start(text, begin)
        del stack[depth + 1 :]
        if line == declared:
            stack.append(p.child("part", stop))
            return True
        p.end = stop
        if depth:
            stack.pop()
        return False
    return in_headers


def _check(root: Part) -> None:
    todo = [root]
    while todo:
        p = todo.pop()
        if p.main == "multipart" and p.rel != "headers" and not any(c.rel == "part" for c in p.children):
            holder = p.parent
            if holder and holder.kind in MESSAGES and holder.parent and holder.parent.kind == ("multipart", "report"):
                # The body of a delivery report may hold any bad MIME: it is then plain text.
                holder.main, holder.sub, holder.params, holder.children = "text", "plain", {"charset": "ascii"}, []
                continue
            raise MalformedError("multipart without its first boundary")
        todo.extend(p.children)


def _line_start(text: str, at: int) -> int:
    if at and text[at - 1] == "\n":
        at -= 1
        if at and text[at - 1] == "\r":
            at -= 1
    return at


#: Fields of a part that need its header section.
SECTION = frozenset(["body_start", "disposition", "disposition_params", "encoding", "headers"])
_DESCRIBING = frozenset(["Content-Disposition", "Content-Transfer-Encoding"])


def rows(root: Part, text: str, fields: frozenset[str] | None = None) -> list[tuple]:
    """Parts before their children, as tuples of the fields of PART. With `fields` only what these need is read; the others are null."""
    out: list[tuple] = []
    todo: list[tuple[Part, int | None, list[int]]] = [(root, None, [])]
    whole = fields is None or "headers" in fields
    while todo:
        p, parent, path = todo.pop()
        headers, body, disposition, encoding = [], None, None, None
        if whole or fields & SECTION:
            headers, body = parse_headers(text, p.start, p.end, None if whole else _DESCRIBING)
            body = p.end if p.rel == "headers" else min(body, p.end)
            for h in headers:  # of several the last counts
                if h[0] == "Content-Disposition":
                    disposition = h
                elif h[0] == "Content-Transfer-Encoding":
                    encoding = h
        number = len(out)
        out.append((
            number, parent, path, len(path), p.rel, p.start, p.end, body, p.main, p.sub, p.params,
            disposition[2] if disposition else None, disposition[3] if disposition else {}, (encoding[2] if encoding and encoding[2] else "7bit"), headers if whole else None,
        ))
        todo.extend((c, number, [*path, i]) for i, c in reversed(list(enumerate(p.children))))
    return out


def last_boundary(text: str | None) -> tuple[int | None, str | None]:
    """Where the closing line of a multipart message begins, and the line that opens a part; nulls if it has none."""
    try:
        root = scan(text) if text is not None else None
    except MalformedError:
        return None, None
    if root is None or root.main != "multipart":
        return None, None
    line = "--" + root.params["boundary"]
    at = text.rfind(f"\n{line}--", 0, root.end)
    return (at + 1, line) if at >= 0 else (None, None)


def parse_message(raw: str | bytes | None, recover: bool = False, fields: frozenset[str] | None = None) -> tuple[list[tuple] | None, str | None, str | None]:
    """(rows, error, parser) of a message. With `recover` a malformed one is read by the standard library's lenient parser."""
    if raw is None:
        return None, None, None
    text = to_text(bytes(raw)) if isinstance(raw, (bytes, bytearray, memoryview)) else raw
    try:
        return rows(scan(text), text, fields), None, "scan"
    except (MalformedError, RecursionError) as e:
        if not recover:
            return None, str(e)[:256], "scan"
    return _lenient(text), None, "lenient"


def _lenient(text: str) -> list[tuple]:
    out: list[tuple] = []
    todo = [(message_from_string(text, policy=policy.compat32), None, [], "root")]
    while todo:
        msg, parent, path, rel = todo.pop()
        kids = msg.get_payload() if msg.is_multipart() else []
        headers = [(str(k), str(v), str(v), {}) for k, v in msg.items()]
        number = len(out)
        body = "" if msg.is_multipart() else str(msg.get_payload())
        at = text.find(body) if body else -1
        params = {k: v if isinstance(v, str) else v[2] for k, v in (msg.get_params(failobj=[]) or [])[1:]}
        out.append((number, parent, path, len(path), rel, max(at, 0), max(at, 0) + len(body), max(at, 0), msg.get_content_maintype(), msg.get_content_subtype(), params, msg.get_content_disposition(), {}, str(msg.get("Content-Transfer-Encoding", "7bit")).lower(), headers))
        inner = "enclosed" if msg.get_content_maintype() == "message" else "part"
        todo.extend((c, number, [*path, i], inner) for i, c in reversed(list(enumerate(kids if isinstance(kids, list) else []))))
    return out
