"""What the parts of a message say about its delivery."""

from __future__ import annotations

import re

from lettermill.kernels.headers import parse_headers

# Headers that speak of a bounce.
BOUNCE_HEADERS = ["Action", "Content-Description", "Diagnostic-Code", "Final-Recipient", "Received", "Remote-Mta", "Reporting-Mta", "Status"]
NO_REPORT = (0.0, "", "", "")
_STATUS = re.compile(r"\d\.\d+\.\d+")
_BLOCKS = re.compile(r"\r?\n[ \t]*\r?\n")
_NAMES = frozenset(BOUNCE_HEADERS)


def bounce_report(text: str, parts: list[tuple[tuple, str | None]]) -> tuple[float, str, str, str]:
    """(score, status, diagnostic code, notification) from the parts (with their headers) and their texts.

    The first status that has the form of one holds, the last diagnostic code, the first notification.
    """
    count, status, code, note = 0, "", "", None
    for p, body in parts:
        own = {h[0]: h[2] for h in p[14] if h[0] in _NAMES and h[2] is not None}
        count += len(own)
        told = list(own.items())
        if (p[8], p[9]) == ("message", "delivery-status") and body:
            for block in _BLOCKS.split(body.lstrip())[:3]:
                block_headers = [(h[0], h[2]) for h in parse_headers(block + "\n\n")[0]]
                count += len(block_headers)
                told += block_headers
        for name, value in told:
            if name == "Status" and not status and _STATUS.match(value or ""):
                status = value
            elif name == "Diagnostic-Code":
                code = value or ""
        if note is None and p[1] is not None and (own.get("Content-Description") or "").lower() == "notification":
            note = body or ""
    return count / 8.0, status, code, note or ""
