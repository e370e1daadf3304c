"""Mail exchangers of domains: looking them up and trying to reach them. Both are arguments of the operator; these are its defaults."""

from __future__ import annotations

import socket
from collections.abc import Callable

try:
    import dnsq
except ImportError:  # then no domain is found, unless the caller brings a look-up
    dnsq = None

#: Seconds for one connection, and the port that is tried.
WAIT, PORT = 1.0, 25


def look_up_domain(domain: str) -> list[str]:
    """Hosts that take the mail of a domain, best first; none if the look-up fails."""
    try:
        return list(dnsq.mx_hosts_for(domain)) if dnsq else []
    except Exception:  # whatever a resolver raises: the domain is then one without exchangers
        return []


def connect_to_exchanger(hosts: list[str]) -> str | None:
    """The first of `hosts` that takes a connection."""
    for host in hosts:
        try:
            socket.create_connection((host, PORT), WAIT).close()
        except OSError:
            continue
        return host
    return None


def find_exchanger(domain: str, look_up: Callable[[str], list[str]], connect: Callable[[list[str]], str | None]) -> str | None:
    """The exchanger that was reached for a domain, or null. A literal is its own host; a look-up that gives nothing is tried once more."""
    if domain.startswith("[") and domain.endswith("]"):
        return connect([domain[1:-1]])
    name = domain if domain.endswith(".") else domain + "."
    hosts = look_up(name) or look_up(name)
    return connect(list(hosts)) if hosts else None
