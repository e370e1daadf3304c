"""Addresses: grammar, quoting, construction and ASCII forms. Pure functions on text.

The grammar is regular: comments and quotes do not nest. Loops inside a token are possessive, so a text of any length
is read in one pass; the choice between a phrase and an address may go back.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

try:
    import idna
except ImportError:  # names of hosts then stay as they are
    idna = None

from lettermill.kernels.encodedword import decode_words, encode_words

# Limits that are part of the meaning.
MAX_ADDRESS, MAX_ITEMS, MAX_LIST = 1024, 1024, 1_048_576

_U = "\x80-퟿-\U0010ffff"
_ATEXT = rf"[A-Za-z0-9!#$%&'*+\-/=?^_`{{|}}~{_U}]"
_FWS = r"(?:\s++)"
_ATOM = rf"{_ATEXT}++"
_DOT_ATOM = rf"{_ATOM}(?:\.{_ATOM})*+"
_QUOTED = rf'"(?:[\x21\x23-\x5b\x5d-\x7e{_U}]|\\[\x21-\x7e\s{_U}]|\s)*+"'
_COMMENT = rf"\((?:[\x21-\x27\x2a-\x5b\x5d-\x7e{_U}]|\s)*+\)"
_CFWS = rf"(?:{_FWS}?(?:{_COMMENT}{_FWS}?)?)"
_LITERAL = rf"\[(?:[\x21-\x5a\x5e-\x7e{_U}]|\s)*+\]"
_LOCAL, _DOMAIN = rf"(?:{_DOT_ATOM}|{_QUOTED})", rf"(?:{_DOT_ATOM}|{_LITERAL})"
_SPEC = rf"{_CFWS}(?P<local{{n}}>{_LOCAL})@(?P<domain{{n}}>{_DOMAIN}){_CFWS}"
_WORD = rf"(?:{_DOT_ATOM}|{_QUOTED}|\.)"
_PHRASE = rf"{_WORD}(?:{_FWS}?{_WORD})*"
_URL = r"https?://[^\s<>{}|^~\[\]`;,]++"
_MAILBOX = rf"(?:{_SPEC.replace("{n}", "1")}|{_CFWS}(?P<phrase>{_PHRASE})?{_CFWS}<{_SPEC.replace("{n}", "2")}>{_CFWS})"
SPEC_RE = re.compile(_SPEC.replace("{n}", "1"))
MAILBOX_RE = re.compile(_MAILBOX)
URL_RE = re.compile(rf"{_CFWS}(?P<url>{_URL}){_CFWS}")
ITEM_RE = re.compile(rf"(?:{_CFWS}(?P<url>{_URL}){_CFWS}|{_MAILBOX})")
_DELIMITER = re.compile(r"(?:\s*[,;])+\s*")
_ATOM_PHRASE = re.compile(rf"(?:(?:{_ATEXT}|\.)++(?:{_FWS}(?:{_ATEXT}|\.)++)*+)?")


def smart_quote(s: str) -> str:
    """Quoted, unless the text is atoms and dots with white space between."""
    return s if _ATOM_PHRASE.fullmatch(s) else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def smart_unquote(s: str) -> str:
    """Quotes dropped, escapes inside them resolved; text outside stays. An open quote ends with the text."""
    return re.sub(r'"((?:[^"\\]|\\.)*+)(?:"|\\?$)', lambda m: re.sub(r"\\(.)", r"\1", m.group(1), flags=re.S), s, flags=re.S)


def host_name(raw: str) -> str | None:
    """Lower case and in Unicode; null where an ACE label does not decode or does not come back as it was."""
    host = raw.lower()
    if host.startswith("[") or idna is None:
        return host
    if any(label.startswith("xn--") for label in host.split(".")):
        try:
            wide = idna.decode(host)
            return wide if idna.encode(wide).decode() == host else None
        except (idna.IDNAError, UnicodeError):
            return None
    return host


def make_address(name: str | None, local: str, domain: str) -> tuple | None:
    """An e-mail address as a tuple of the fields of ADDRESS, from the pieces as they stand in the text."""
    host = host_name(re.sub(r"\s+", "", domain) if domain.startswith("[") else domain)
    if host is None:
        return None
    display = ""
    if name:
        display = re.sub(r"\s+", " ", name.strip()) if '"' not in name else _collapsed(name.strip())
        display = decode_words(smart_unquote(display))
    return "email", display, local, host, f"{local}@{host}", None, None, None


def _collapsed(phrase: str) -> str:
    return "".join(p if p.startswith('"') else re.sub(r"\s+", " ", p) for p in re.split(rf"({_QUOTED})", phrase) if p)


def make_url(raw: str) -> tuple | None:
    try:
        parts = urlsplit(raw)
    except ValueError:
        return None
    try:
        port = parts.port
    except ValueError:
        port = None
    return "url", None, None, (parts.hostname or None), raw, parts.scheme.lower(), port, parts.path


def _lift(m: re.Match) -> tuple | None:
    if (url := m.groupdict().get("url")) is not None:
        return make_url(url)
    g = m.groupdict()
    n = 1 if g.get("local1") is not None else 2
    return make_address(g.get("phrase"), g[f"local{n}"], g[f"domain{n}"])


def parse(text: str | None, addr_spec_only: bool = False, strict: bool = False) -> tuple | None:
    """One mailbox, addr-spec or URL; null if the text is none. Unless `strict`, the last word may be the address and what stands before it its name."""
    if text is None:
        return None
    text = text.strip()
    if not text or len(text) > MAX_ADDRESS:
        return None
    m = SPEC_RE.fullmatch(text) if addr_spec_only else (URL_RE.fullmatch(text) or MAILBOX_RE.fullmatch(text))
    if m is None and not strict:
        name, _, last = text.rpartition(" ")
        if name and (m := (SPEC_RE.fullmatch(last) if addr_spec_only else (URL_RE.fullmatch(last) or MAILBOX_RE.fullmatch(last)))):
            found = _lift(m)
            return (found[0], found[1] or name.strip(), *found[2:]) if found and found[0] == "email" and not addr_spec_only else found
    return _lift(m) if m else None


def parse_discrete_list(text: str | None) -> tuple[list, list, str | None]:
    """A delimited text, all or nothing: parsed, unparsed, error."""
    if not text or not text.strip():
        return [], [], None
    if len(text) > MAX_LIST:
        return [], [text], "too long"
    good, bad, at = [], [], 0
    body = text.strip()
    while at < len(body):
        m = ITEM_RE.match(body, at)
        if not m or m.end() == at:
            return [], [text], None
        found = _lift(m)
        if found:
            good.append(found)
        else:
            g = m.groupdict()
            n = 1 if g.get("local1") is not None else 2
            bad.append(g.get("url") or f"{g.get(f'local{n}')}@{g.get(f'domain{n}')}")
        at = m.end()
        if at < len(body):
            d = _DELIMITER.match(body, at)
            if not d:
                return [], [text], None
            at = d.end()
    return good, bad if good else [*bad, text], None


def parse_list(items: list[str | None] | None, strict: bool = False) -> tuple[list, list, str | None]:
    """A list item by item; above the limit of items the result is empty, with an error."""
    if not items:
        return [], [], None
    if len(items) > MAX_ITEMS:
        return [], [], "too many items"
    good, bad = [], []
    for item in items:
        found = parse(item, strict=strict)
        (good if found else bad).append(found or item)
    return good, [b for b in bad if b is not None], None


def ace_host(host: str | None) -> str | None:
    """The host in ASCII; null if it has no such form."""
    if host is None:
        return None
    if re.fullmatch(r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?", host):
        return host
    try:
        return idna.encode(host).decode() if idna else None
    except (idna.IDNAError, UnicodeError):
        return None


def ace_address(mailbox: str | None, host: str | None) -> str | None:
    ace = ace_host(host)
    return f"{mailbox}@{ace}" if mailbox is not None and mailbox.isascii() and ace else None


def ace_display_name(name: str | None) -> str | None:
    """The name quoted where it must be, and in encoded words where it is not ASCII."""
    if not name:
        return name
    return smart_quote(name) if name.isascii() else encode_words(name)


def full_spec(name: str | None, mailbox: str | None, host: str | None) -> str | None:
    """The whole address in ASCII; null where it has no such form."""
    ace = ace_address(mailbox, host)
    return None if ace is None else f"{ace_display_name(name)} <{ace}>" if name else ace
