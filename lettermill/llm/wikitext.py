"""Wiki markup to the words a reader sees. Pure Python, used inside the kernels of the operators."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

#: Characters that nothing is seen of: soft hyphen, joiners, marks of direction, byte order mark and the like.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_ANGLE = re.compile(r"<(?:!--.*?-->|ref\b[^<>]*/\s*>|ref\b[^<>]*>.*?</ref\s*>|(?:math|gallery|score|syntaxhighlight|timeline)\b[^<>]*>.*?</(?:math|gallery|score|syntaxhighlight|timeline)\s*>|(/?(?:p|div|br|li|ul|ol|tr|td|th|table|blockquote|hr|h[1-6])\b)[^<>]*>|/?[a-zA-Z][^<>]*>)", re.S | re.I)
_TABLE = re.compile(r"^[ :*]*\{\|.*?^[ ]*\|\}", re.S | re.M)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}", re.S)
_PARAMETER = re.compile(r"\{\{\{[^{}]*\}\}\}")
_META_LINK = re.compile(r"\[\[\s*:?\s*(?:category|file|image|media|[a-z]{2,3}(?:-[a-z]+)?)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_OUTER_LINK = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_BOLD = re.compile(r"'{2,5}")
_HEADING = re.compile(r"^\s*=+[^=\n]+=+\s*$", re.M)
_REDIRECT = re.compile(r"^\s*#redirect\b", re.I)
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _angle(hit: re.Match) -> str:
    return "\n" if hit.group(1) else ""


def _unnested(text: str, keep: Callable[[str], str]) -> str:
    """Templates of any depth in one pass, the innermost first; what is not closed stays."""
    open_: list[list[str]] = [[]]
    last = 0
    for m in re.finditer(r"\{\{|\}\}", text):
        open_[-1].append(text[last : m.start()])
        last = m.end()
        if m.group() == "{{":
            open_.append([])
        elif len(open_) > 1:
            inner = "".join(open_.pop())
            open_[-1].append(keep(inner))
        else:
            open_[-1].append(m.group())
    open_[-1].append(text[last:])
    return "{{".join("".join(x) for x in open_)


def plain(text: str, quotes: bool = False, headings: bool = True) -> str:
    """`text` without markup, references, comments, tables and templates.

    With `quotes` the tables stay and so do the words of templates that hold a passage (more than six words): a
    passage may stand in them. Without `headings` these lines go as well.
    """
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "&" in text:
        text = html.unescape(text.replace("&shy;", "").replace("&zwnj;", "").replace("&nbsp;", " "))
        text = INVISIBLE.sub("", text)
    if "<" in text:
        text = _ANGLE.sub(_angle, text)
    if "{" in text:
        if not quotes:
            text = _TABLE.sub("\n", text)
        if "{{{" in text:
            text = _PARAMETER.sub("", text)
        keep = (lambda inner: " " + inner.partition("|")[2] + " " if len(inner.split()) > 6 else "") if quotes else (lambda inner: "")
        for _ in range(12):
            text, n = _TEMPLATE.subn(lambda m: keep(m.group(1)), text)
            if not n:
                break
        else:
            text = _unnested(text, keep)
    if "[" in text:
        if "[[" in text:
            text = _META_LINK.sub("", text)
            text = _LINK.sub(r"\1", text)
        if "//" in text:
            text = _OUTER_LINK.sub(r"\1", text)
    if "''" in text:
        text = _BOLD.sub("", text)
    if not headings and "=" in text:
        text = _HEADING.sub("", text)
    return text


def is_redirect(text: str) -> bool:
    return bool(_REDIRECT.match(text))
