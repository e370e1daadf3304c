"""Columns of addresses, address lists and URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions._udf import kernel_udf
from lettermill.kernels import address as K
from lettermill.types import ADDRESS, ADDRESS_LIST

_FIELDS = [f.split()[0] for f in ADDRESS.split(", ")]
#: ASCII text without quotes, comments, escapes, encoded words or ACE labels: [Name ]<local@host> or local@host.
_ATEXT = r"[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~]"
_DOTTED = rf"{_ATEXT}++(?:\.{_ATEXT}++)*+"
SIMPLE = rf"^[ \t]*(?:((?:{_DOTTED}|\.)(?:[ \t]+(?:{_DOTTED}|\.))*+)[ \t]*)?<({_DOTTED})@({_DOTTED})>[ \t]*$|^[ \t]*({_DOTTED})@({_DOTTED})[ \t]*$"
_NOT_SIMPLE = r"=\?|(?i)xn--"
URL = r"^[hH][tT][tT][pP][sS]?://[^\s<>{}|^~\[\]`;,]+$"


def _rows(found: list[tuple | None]) -> pd.DataFrame:
    return pd.DataFrame([f or (None,) * len(_FIELDS) for f in found], columns=_FIELDS).astype(object)


def _parse_kernel(strict: bool, spec_only: bool):
    @kernel_udf(ADDRESS)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return _rows([K.parse(t, spec_only, strict) for t in texts])

    return parse


def parse_address(text: Column, strict: bool = False, addr_spec_only: bool = False) -> Column:
    """Struct of an address, or null. Plain ASCII addresses are read by one regular expression in the JVM; only others go to the kernel."""
    # The pattern is run once: what it finds is put between marks that no such address has, and cut at these.
    marked = F.regexp_replace(text, SIMPLE, "\x01$1\x01$2$4\x01$3$5")
    simple = marked.startswith("\x01") & ~text.contains("\x01") & ~text.rlike(_NOT_SIMPLE) & (F.length(F.trim(text)) <= K.MAX_ADDRESS)
    if addr_spec_only:
        simple = simple & ~text.contains("<")
    none = lambda t: F.lit(None).cast(t)

    def address(found: Column) -> Column:
        local, host = F.get(found, F.lit(2)), F.lower(F.get(found, F.lit(3)))
        return F.struct(
            F.lit("email").alias("addr_type"), F.regexp_replace(F.get(found, F.lit(1)), r"[ \t]+", " ").alias("display_name"), local.alias("mailbox"), host.alias("hostname"),
            F.concat(local, F.lit("@"), host).alias("address"), none("string").alias("scheme"), none("int").alias("port"), none("string").alias("path"),
        )

    native = F.get(F.transform(F.array(F.split(marked, "\x01", -1)), address), F.lit(0))
    kernel = _parse_kernel(strict, addr_spec_only)(F.when(simple, None).otherwise(text))
    return F.when(simple, native).when(kernel["addr_type"].isNotNull(), kernel)


def is_email(text: Column) -> Column:
    return F.coalesce(parse_address(text, addr_spec_only=True)["addr_type"] == "email", F.lit(False))


@kernel_udf(ADDRESS_LIST)
def _list_kernel(texts: pd.Series) -> pd.DataFrame:
    found = [K.parse_discrete_list(t) for t in texts]
    as_row = lambda a: dict(zip(_FIELDS, a, strict=True))
    return pd.DataFrame([([as_row(a) for a in good], bad, error) for good, bad, error in found], columns=["parsed", "unparsed", "error"])


def parse_address_list(text: Column) -> Column:
    """Struct of parsed and unparsed entries of a delimited text: all or nothing. Null and blank give two empty arrays."""
    return _list_kernel(text)


def _items_kernel(strict: bool):
    @kernel_udf(ADDRESS_LIST)
    def parse(lists: pd.Series) -> pd.DataFrame:
        found = [K.parse_list(None if x is None else list(x), strict) for x in lists]
        as_row = lambda a: dict(zip(_FIELDS, a, strict=True))
        return pd.DataFrame([([as_row(a) for a in good], bad, error) for good, bad, error in found], columns=["parsed", "unparsed", "error"])

    return parse


def parse_address_items(items: Column, strict: bool = False) -> Column:
    """The same for an array of texts, item by item; more than 1024 items give empty arrays and an error."""
    return _items_kernel(strict)(items)


# Parts and forms of an address struct


def address_key(a: Column) -> Column:
    """Key of equality, for joins, groups and deduplication: e-mail without case, URLs as they are."""
    return F.when(a["addr_type"] == "email", F.lower(a["address"])).otherwise(a["address"])


def supports_routing(a: Column) -> Column:
    return a["addr_type"] == "email"


def is_pure_ascii(s: Column) -> Column:
    return F.coalesce(~s.rlike(r"[^\x00-\x7F]"), F.lit(False))


def contains_non_ascii(a: Column) -> Column:
    return ~is_pure_ascii(a["address"])


def contains_domain_literal(a: Column) -> Column:
    return a["hostname"].startswith("[") & a["hostname"].endswith("]")


def to_unicode(a: Column) -> Column:
    return F.when(F.coalesce(a["display_name"], F.lit("")) != "", F.concat(smart_quote(a["display_name"]), F.lit(" <"), a["address"], F.lit(">"))).otherwise(a["address"])


def _on_parts(name: str, f, columns: int):
    if columns == 1:
        @kernel_udf("string")
        def one(x: pd.Series) -> pd.Series:
            return x.map(f, na_action="ignore")

        return one

    if columns == 2:
        @kernel_udf("string")
        def two(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([f(a, b) for a, b in zip(x, y, strict=True)], dtype=object)

        return two

    @kernel_udf("string")
    def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([f(a, b, c) for a, b, c in zip(x, y, z, strict=True)], dtype=object)

    return three


def ace_hostname(host: Column) -> Column:
    """The host in ASCII; null if it has no such form."""
    plain = host.rlike(r"^[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?$")
    return F.when(plain, host).otherwise(_on_parts("ace", K.ace_host, 1)(F.when(plain, None).otherwise(host)))


def ace_address(a: Column) -> Column:
    return _on_parts("ace", K.ace_address, 2)(a["mailbox"], a["hostname"])


def ace_display_name(name: Column) -> Column:
    plain = is_pure_ascii(name)
    return F.when(plain, smart_quote(name)).otherwise(_on_parts("ace", K.ace_display_name, 1)(F.when(plain, None).otherwise(name)))


def full_spec(a: Column) -> Column:
    """Name and address in ASCII; null where they have no such form. URLs stay."""
    mail = _on_parts("spec", K.full_spec, 3)(a["display_name"], a["mailbox"], a["hostname"])
    return F.when(a["addr_type"] == "url", a["address"]).otherwise(mail)


def requires_non_ascii(a: Column) -> Column:
    return ~is_pure_ascii(a["mailbox"]) | ace_hostname(a["hostname"]).isNull()


def address_equals(a: Column, text: Column) -> Column:
    """Whether an address is the one a text names."""
    return address_key(a).eqNullSafe(address_key(parse_address(text)))


# Quoting and cleaning

_ATOMS = r"^(?:(?:[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~.]|[^\x00-\x7F])++(?:\s++(?:[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~.]|[^\x00-\x7F])++)*+)?$"


def smart_quote(s: Column) -> Column:
    escaped = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(s.rlike(_ATOMS), s).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def smart_unquote(s: Column) -> Column:
    """Native where there is no escape; the kernel gets the rest."""
    plain = ~s.contains("\\")
    return F.when(plain, F.translate(s, '"', "")).otherwise(_on_parts("unquote", K.smart_unquote, 1)(F.when(plain, None).otherwise(s)))


def cleanup_display_name(s: Column) -> Column:
    return F.regexp_replace(s, r"^[;,'\r\n ]+|[;,'\r\n ]+$", "")


def cleanup_email(s: Column) -> Column:
    return F.regexp_replace(s, r"^[<>;, ]+|[<>;, ]+$", "")


def contains_control_chars(s: Column) -> Column:
    """Whether the first character is a control."""
    return s.rlike(r"^[\x00-\x1F\x7F-\x9F]")


# URLs


def is_url(s: Column) -> Column:
    return F.coalesce(s.rlike(URL), F.lit(False))


def url_hostname(u: Column) -> Column:
    return F.when(is_url(u), F.nullif(F.lower(F.regexp_extract(u, r"^[^:]+://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("")))


def url_port(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, r"^[^:]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1), F.lit("")).cast("int")


def url_scheme(u: Column) -> Column:
    return F.when(is_url(u), F.lower(F.regexp_extract(u, r"^([^:]+):", 1)))


def url_path(u: Column) -> Column:
    return F.when(is_url(u), F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#;]*)", 1))


# Algebra of address lists (arrays of address structs)


def list_append(xs: Column, a: Column) -> Column:
    return F.concat(xs, F.array(a))


def list_remove(xs: Column, a: Column) -> Column:
    """Without the first equal element."""
    keys = F.transform(xs, address_key)
    at = F.array_position(keys, address_key(a))
    return F.when(at == 0, xs).otherwise(F.filter(xs, lambda x, i: i != at - 1))


def list_concat(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


def list_equals(xs: Column, ys: Column) -> Column:
    """As sets: order and repeats do not count."""
    keys = lambda zs: F.array_sort(F.array_distinct(F.transform(zs, address_key)))
    return keys(xs) == keys(ys)


def list_contains(xs: Column, a: Column) -> Column:
    key = address_key(a)
    return F.exists(xs, lambda x: address_key(x) == key)


def list_addresses(xs: Column) -> Column:
    return F.transform(xs, lambda x: x["address"])


def list_hostnames(xs: Column) -> Column:
    return F.array_distinct(F.transform(xs, lambda x: x["hostname"]))


def list_addr_types(xs: Column) -> Column:
    return F.array_distinct(F.transform(xs, lambda x: x["addr_type"]))


def list_to_unicode(xs: Column, delimiter: str = ", ") -> Column:
    return F.array_join(F.transform(xs, to_unicode), delimiter)


@kernel_udf("array<string>")
def _specs_kernel(lists: pd.Series) -> pd.Series:
    spec = lambda a: a["address"] if a["addr_type"] == "url" else K.full_spec(a["display_name"], a["mailbox"], a["hostname"])
    return pd.Series([None if xs is None else [spec(a) for a in xs] for xs in lists], dtype=object)


def list_to_ascii(xs: Column) -> Column:
    return _specs_kernel(xs)


def list_full_spec(xs: Column, delimiter: str = ", ") -> Column:
    return F.array_join(_specs_kernel(xs), delimiter)


# Local parts of providers. U stands for what is not ASCII.

_U = r"[^\x00-\x7F]"
_LOOP = rf"^(?:[A-Za-z]|{_U})++(?:[._]?(?:[A-Za-z0-9]|{_U})++)*+[._]?$"


def _len(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def provider_valid(provider: Column, mailbox: Column, hostname: Column) -> Column:
    """Whether a local part keeps the rules of its provider: yahoo, gmail, aol, icloud, hotmail, google. Null for others."""
    base = F.substring_index(mailbox, "+", 1)
    alnum = rf"(?:[A-Za-z0-9]|{_U})"
    ends = lambda c: c.rlike(rf"{alnum}$")
    aol = (hostname == "verizon.net") | (_len(mailbox, 3, 32) & mailbox.rlike(_LOOP) & ends(mailbox) & F.when(hostname.isin("aol.com", "aim.com"), mailbox.rlike(rf"^(?:[A-Za-z]|{_U})")).otherwise(True))
    gmail = _len(F.translate(base, ".", ""), 6, 30) & base.rlike(rf"^{alnum}++(?:\.{alnum}++)*+$")
    google = (F.length(base) <= 64) & base.rlike(rf"^(?:[A-Za-z0-9_\-'.]|{_U})++$") & ~base.startswith(".") & ~base.endswith(".")
    hotmail = _len(base, 1, 64) & base.rlike(rf"^{alnum}") & ~base.endswith(".") & (F.length(mailbox) - F.length(F.translate(mailbox, "+", "")) <= 1) & base.rlike(rf"^(?:[A-Za-z0-9._\-]|{_U})++$")
    icloud = _len(base, 3, 20) & base.rlike(_LOOP) & ends(base) & ~mailbox.endswith("+")
    managed = hostname.isin("yahoo.com", "ymail.com", "rocketmail.com")
    primary = _len(mailbox, 4, 32) & (F.length(mailbox) - F.length(F.translate(mailbox, ".", "")) <= 1) & mailbox.rlike(r"^[A-Za-z0-9]++(?:[._]?[A-Za-z0-9]++)*+$")
    pieces = F.split(mailbox, "-", -1)
    disposable = _len(mailbox, 3, 65) & (F.size(pieces) == 2) & _len(F.get(pieces, F.lit(0)), 1, 32) & _len(F.get(pieces, F.lit(1)), 1, 32) & F.get(pieces, F.lit(0)).rlike("^[A-Za-z0-9_]+$") & F.get(pieces, F.lit(1)).rlike("^[A-Za-z0-9]+$")
    yahoo = (~managed | mailbox.rlike("^[A-Za-z]")) & mailbox.rlike("[A-Za-z0-9]$") & F.when(mailbox.contains("-"), disposable).otherwise(primary)
    return F.when(provider == "yahoo", yahoo).when(provider == "gmail", gmail).when(provider == "aol", aol).when(provider == "icloud", icloud).when(provider == "hotmail", hotmail).when(provider == "google", google)


# Which exchangers belong to which provider, in this order; all are anchored at the start only.
PROVIDERS = [
    ("yahoo", r"^mta[0-9]+\.am[0-9]+\.yahoodns\.net$"), ("gmail", r"^.*gmail-smtp-in\.l\.google.com$"), ("aol", r"^.*\.mx\.aol\.com$"),
    ("icloud", r"^.*\.mail\.icloud\.com$"), ("hotmail", r"^mx[0-9]\.hotmail\.com"), ("google", r"(?i)^(?:.*aspmx\.l\.google\.com$|aspmx.*\.googlemail.com$)"),
]


def provider_of(exchanger: Column) -> Column:
    out = None
    for name, pattern in PROVIDERS:
        out = F.when(exchanger.rlike(pattern), name) if out is None else out.when(exchanger.rlike(pattern), name)
    return out
