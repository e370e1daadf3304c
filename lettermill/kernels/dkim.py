"""Canonical forms and signatures of messages (RFC 6376, RFC 4870)."""

from __future__ import annotations

import base64
import ctypes
import hashlib
import math
import re
import threading
from collections.abc import Callable
from functools import lru_cache

# DER prefixes of digests in PKCS #1 signatures.
_DIGEST = {"sha256": bytes.fromhex("3031300d060960864801650304020105000420"), "sha1": bytes.fromhex("3021300906052b0e03021a05000414")}


def _trimmed(body: bytes) -> bytes:
    """The body without the line ends at its end; each byte is looked at once."""
    kept = body.rstrip(b"\r\n")
    ends = body[len(kept) :]
    return body if ends.endswith(b"\r") else body[: len(kept) + ends.rfind(b"\r\r") + 1]


def canonical_header(name: bytes, value: bytes, how: str) -> bytes:
    """A header line in the form `simple`, `relaxed` or `nofws`, with its line end."""
    if how == "simple":
        return name + b":" + value
    if how == "nofws":
        return re.sub(rb"\s+", b"", name + b":" + value) + b"\r\n"
    return name.lower().strip() + b":" + re.sub(rb"\s+", b" ", value).strip() + b"\r\n"


def canonical_body(body: bytes, how: str) -> bytes:
    if how == "simple":
        return _trimmed(body) + b"\r\n"
    if how == "nofws":
        return body.translate(None, b" \t\x0b\x0c").rstrip(b"\r\n") + b"\r\n"
    text = re.sub(rb"[ \t]+(?=\r?\n|$)", b"", re.sub(rb"[ \t]+", b" ", body))
    return _trimmed(text) + b"\r\n" if _trimmed(text) else b""


def split_message(message: bytes) -> tuple[list[tuple[bytes, bytes]], bytes]:
    """(name, value with its folds and line end) of each header, and the body. Raises ValueError at a line that is no header."""
    headers: list[tuple[bytes, bytes]] = []
    at = 0
    while at < len(message):
        line = message[at : message.find(b"\n", at) + 1 or len(message)]
        at += len(line)
        if not line.strip(b"\r\n"):
            return headers, message[at:]
        if line[:1] in b" \t" and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + line)
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[\x21-\x39\x3b-\x7e]+", name):
            raise ValueError("bad header")
        headers.append((name, value))
    return headers, b""


def fold(line: bytes, width: int = 72) -> bytes:
    """The line with breaks after its blanks, or within long words, so that no piece is longer than `width`."""
    out, column = b"", 0
    for word in re.findall(rb"[^ ]+ ?|.", line):
        while len(word) > width:
            out, word, column = out + word[: width - column] + b"\r\n ", word[width - column :], 1
        if column + len(word) > width:
            out, column = out + b"\r\n ", 1
        out, column = out + word, column + len(word)
    return out


def _der(data: bytes) -> list:
    out, at = [], 0
    while at < len(data):
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        value = data[at : at + size]
        out.append(_der(value) if tag == 0x30 else int.from_bytes(value, "big") if tag == 2 else _der(value) if tag == 4 and value[:1] == b"\x30" else value)
        at += size
    return out


def _key(pem: bytes) -> list:
    """The fields of an RSA key in PEM, PKCS #1 or #8: version, modulus, both exponents, primes."""
    found = _der(base64.b64decode(b"".join(x for x in pem.split(b"\n") if not x.startswith(b"-----") and b":" not in x)))[0]
    while not (len(found) > 5 and isinstance(found[3], int)):
        found = next(x for x in found if isinstance(x, list) and len(x) and (isinstance(x[0], list) or len(x) > 5))
        found = found[0] if len(found) == 1 else found
    return found


def private_key(pem: bytes) -> tuple[int, int]:
    """(modulus, private exponent) of an RSA key in PEM, PKCS #1 or #8."""
    found = _key(pem)
    return found[1], found[3]


@lru_cache(maxsize=1)
def _libcrypto() -> ctypes.CDLL | None:
    """The library that hashlib has its digests from, None where it cannot be called."""
    pointer, number = ctypes.c_void_p, ctypes.c_int
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for name, gives, *takes in (
            ("BN_new", pointer), ("BN_clear_free", None, pointer), ("BN_CTX_new", pointer), ("BN_CTX_free", None, pointer), ("BN_MONT_CTX_new", pointer), ("BN_MONT_CTX_free", None, pointer),
            ("BN_bin2bn", pointer, ctypes.c_char_p, number, pointer), ("BN_bn2binpad", number, pointer, ctypes.c_char_p, number),
            ("BN_MONT_CTX_set", number, *[pointer] * 3), ("BN_mod_exp_mont", number, *[pointer] * 6),
        ):
            call = getattr(lib, name)
            call.restype, call.argtypes = gives, takes
    except (ImportError, AttributeError, OSError):
        return None
    return lib


class _Power:
    """x ** exponent % modulus; by libcrypto, where there is one and the modulus is odd."""

    def __init__(self, exponent: int, modulus: int) -> None:
        self.exponent, self.modulus, self.size, self.lock = exponent, modulus, (modulus.bit_length() + 7) // 8, threading.Lock()
        self.lib = _libcrypto() if modulus & 1 else None
        if self.lib:
            self.buffer = ctypes.create_string_buffer(self.size)
            self.numbers = [self.lib.BN_bin2bn(x.to_bytes(self.size, "big"), self.size, None) for x in (0, 0, exponent, modulus)]
            self.context, self.mont = self.lib.BN_CTX_new(), self.lib.BN_MONT_CTX_new()
            self.lib.BN_MONT_CTX_set(self.mont, self.numbers[3], self.context)

    def __call__(self, x: int) -> int:
        if self.lib:
            out, base, exponent, modulus = self.numbers
            with self.lock:
                self.lib.BN_bin2bn((x % self.modulus).to_bytes(self.size, "big"), self.size, base)
                if self.lib.BN_mod_exp_mont(out, base, exponent, modulus, self.context, self.mont) == 1 and self.lib.BN_bn2binpad(out, self.buffer, self.size) == self.size:
                    return int.from_bytes(self.buffer.raw, "big")
        return pow(x, self.exponent, self.modulus)

    def __del__(self) -> None:
        if self.lib:
            for x in self.numbers:
                self.lib.BN_clear_free(x)
            self.lib.BN_MONT_CTX_free(self.mont)
            self.lib.BN_CTX_free(self.context)


@lru_cache(maxsize=64)
def _signer(pem: bytes) -> tuple[int, Callable[[int], int]]:
    """The modulus of a key and the power by its private exponent, which is put together from those by the two primes. Both are
    had from primes and exponent, as the fields for them may be empty; a key whose primes do not fit is used without them."""
    _, n, _, d, p, q, *_ = _key(pem)
    if isinstance(p, int) and isinstance(q, int) and p * q == n and min(p, q) > 1 and math.gcd(p, q) == 1:
        first, second = _Power(d % (p - 1), p), _Power(d % (q - 1), q)
        inverse = pow(q, -1, p)

        def by_primes(x: int) -> int:
            low = second(x)
            return low + q * ((first(x) - low) * inverse % p)

        if by_primes(n // 3) == pow(n // 3, d, n):
            return n, by_primes
    return n, _Power(d, n)


def rsa_sign(pem: bytes, data: bytes, digest: str = "sha256") -> bytes:
    n, power = _signer(bytes(pem))
    size = (n.bit_length() + 7) // 8
    block = _DIGEST[digest] + hashlib.new(digest, data).digest()
    padded = b"\x00\x01" + b"\xff" * (size - len(block) - 3) + b"\x00" + block
    return power(int.from_bytes(padded, "big")).to_bytes(size, "big")


def dkim_signature(message: bytes, pem: bytes, selector: str, domain: str, signed: list[str] | None = None, header_form: str = "simple", body_form: str = "simple", now: int = 0) -> bytes:
    """The DKIM-Signature line of a message."""
    headers, body = split_message(message)
    chosen = [(k, v) for k, v in headers if not signed or k.decode().lower() in {s.lower() for s in signed}]
    digest = base64.b64encode(hashlib.sha256(canonical_body(body, body_form)).digest())
    fields = [b"v=1", b"a=rsa-sha256", f"c={header_form}/{body_form}; d={domain}; s={selector}; t={now}; h=".encode() + b" : ".join(k.lower() for k, _ in chosen), b"bh=" + digest, b"b="]
    line = fold(b"DKIM-Signature: " + b"; ".join(fields))
    data = b"".join(canonical_header(k, v, header_form) for k, v in chosen)
    name, _, value = line.partition(b":")
    data += canonical_header(name, value, header_form).rstrip(b"\r\n")
    return fold(line + base64.b64encode(rsa_sign(pem, data))) + b"\r\n"


def domainkey_signature(message: bytes, pem: bytes, selector: str, domain: str) -> bytes:
    """The DomainKey-Signature line of a message: all headers, without folds and white space, SHA-1."""
    headers, body = split_message(message)
    data = b"".join(canonical_header(k, v, "nofws") for k, v in headers) + b"\r\n" + canonical_body(body, "nofws")
    fields = f"a=rsa-sha1; c=nofws; d={domain}; s={selector}; q=dns; h=".encode() + b" : ".join(k.lower() for k, _ in headers)
    return fold(b"DomainKey-Signature: " + fields + b"; b=" + base64.b64encode(rsa_sign(pem, data, "sha1"))) + b"\r\n"
