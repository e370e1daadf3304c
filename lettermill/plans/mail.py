"""Queries of the mail operators, with the SQL they must equal where SQL can say it."""

from __future__ import annotations

import base64
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import addresses as A
from lettermill.functions import messages as M
from lettermill.kernels.address import MAX_ITEMS
from lettermill.operators.addresses import EXACT_FIXES, explode_addresses, lookup_exchangers, members, suggest_domains, validate_addresses, validate_lists
from lettermill.operators.mail import BOUNCE_HEADERS, append_parts, apply_edits, attached_message, detect_bounces, explode_bodies, explode_parts, parse_errors, part_edits, subtree_changed
from lettermill.operators.threads import build_threads, descendants
from lettermill.session import materialise, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


# Grammar in SQL: white space, comments, words, an address alone (with what may surround it), and one with a name.
_WS = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_HIGH = r"\x{80}-\x{10FFFF}"
_ATOM = rf"[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~{_HIGH}-]+"
_DOTS = rf"{_ATOM}(\.{_ATOM})*"
_IN_QUOTES = rf'"([\x21\x23-\x5b\x5d-\x7e{_HIGH}]|\\[\x21-\x7e{_HIGH}]|\\?{_WS})*"'
_AROUND = rf"{_WS}*(\(([\x21-\x27\x2a-\x5b\x5d-\x7e{_HIGH}]|{_WS})*\){_WS}*)?"
_ALONE = rf"({_DOTS}|{_IN_QUOTES})@({_DOTS}|\[([\x21-\x5a\x5e-\x7e{_HIGH}]|{_WS})*\])"
_SPEC = rf"{_AROUND}{_ALONE}{_AROUND}"
_NAMED = rf"{_AROUND}(({_DOTS}|{_IN_QUOTES}|\.)({_WS}*({_DOTS}|{_IN_QUOTES}|\.))*)?{_AROUND}<{_SPEC}>{_AROUND}"
_LINK = rf"{_AROUND}https?://[^\s<>{{}}|^~\[\]`;,]+{_AROUND}"
_TRIM = rf"regexp_replace(address, '^{_WS}+|{_WS}+$', '', 'g')"
_MAILS = "SELECT * FROM addresses WHERE addr_type = 'email' AND address IS NOT NULL"


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "addresses").where((F.col("addr_type") == "email") & F.col("address").isNotNull())
    return a.withColumn("a", A.parse_address(F.col("address"), strict=True)).where(F.col("a").isNotNull())


_STRICT = (
    rf"SELECT *, lower(regexp_extract(alone, '@([^@]*)$', 1)) AS host, regexp_extract(alone, '^(.*)@[^@]*$', 1) AS local FROM (SELECT *, regexp_extract(t, '{_ALONE}') AS alone FROM "
    rf"(SELECT *, {_TRIM} AS t FROM ({_MAILS})) WHERE (regexp_full_match(t, '{_SPEC}') OR regexp_full_match(t, '{_NAMED}')) AND length(t) <= 1024)"
)


@query(f"SELECT host, count(*) AS n FROM ({_STRICT}) GROUP BY host")
def addr_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed addresses of the address book by host."""
    return emails(spark, sf_dir).groupBy(F.col("a.hostname").alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT addr_id, local AS mailbox, host AS hostname, local || '@' || host AS address FROM ({_STRICT})")
def addr_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails(spark, sf_dir).select("addr_id", F.col("a.mailbox").alias("mailbox"), F.col("a.hostname").alias("hostname"), F.col("a.address").alias("address"))


@query(rf"SELECT addr_id, coalesce(length(t) <= 1024 AND regexp_full_match(t, '{_SPEC}'), false) AS strict_ok FROM (SELECT addr_id, {_TRIM} AS t FROM addresses WHERE addr_type = 'email')")
def addr_is_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which typed addresses are addr-specs; nulls are none."""
    a = table(spark, sf_dir, "addresses").where(F.col("addr_type") == "email")
    return a.select("addr_id", A.parse_address(F.col("address"), strict=True, addr_spec_only=True).isNotNull().alias("strict_ok"))


@query(rf"SELECT addr_id, coalesce(length(t) <= 1024 AND (regexp_full_match(t, '{_SPEC}') OR (contains(t, ' ') AND regexp_full_match(regexp_extract(t, '[^ ]*$'), '{_SPEC}'))), false) AS is_one FROM (SELECT addr_id, {_TRIM} AS t FROM addresses)")
def addr_is_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which typed addresses, URLs included, are or end with an addr-spec."""
    return table(spark, sf_dir, "addresses").select("addr_id", A.is_email(F.col("address")).alias("is_one"))


@query(f"SELECT addr_id, local || '@' || host AS relaxed, true AS strict_null FROM ({_STRICT})")
def addr_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with an address as its last word."""
    a = emails(spark, sf_dir).select("addr_id", F.concat(F.lit("call me at "), F.col("a.address")).alias("text"))
    return a.select("addr_id", A.parse_address(F.col("text"))["address"].alias("relaxed"), A.parse_address(F.col("text"), strict=True).isNull().alias("strict_null"))


@query(f"SELECT addr_id, c_name, local || '@' || host AS address FROM (SELECT addr_id, local, host, 'Person ' || (addr_id % 97) AS c_name FROM ({_STRICT}))")
def addr_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and address, put together in four ways and parsed again."""
    name = F.concat(F.lit("Person "), (F.col("addr_id") % 97).cast("string"))
    spec = F.col("a.address")
    text = (
        F.when(F.col("addr_id") % 4 == 0, F.concat(name, F.lit(" <"), spec, F.lit(">"))).when(F.col("addr_id") % 4 == 1, F.concat(F.lit('"'), name, F.lit('" <'), spec, F.lit(">")))
        .when(F.col("addr_id") % 4 == 2, F.concat(name, F.lit("   < "), spec, F.lit(" > (a comment)"))).otherwise(F.concat(F.lit("(first) "), name, F.lit(" <"), spec, F.lit(">")))
    )
    p = A.parse_address(text, strict=True)
    return emails(spark, sf_dir).select("addr_id", p["display_name"].alias("c_name"), p["address"].alias("address"))


@query(rf"SELECT msg_id, count(*) AS listed FROM ({_STRICT}) WHERE msg_id IS NOT NULL GROUP BY msg_id")
def addr_list_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a message joined to one text with mixed delimiters, parsed as a list."""
    lists = emails(spark, sf_dir).where(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("a.address"))), " ;, ").alias("text"))
    return lists.select("msg_id", F.size(A.parse_address_list(F.col("text"))["parsed"]).cast("bigint").alias("listed"))


_ITEM_OK = rf"length(t) <= 1024 AND (regexp_full_match(t, '{_SPEC}') OR regexp_full_match(t, '{_NAMED}') OR regexp_full_match(t, '(?i){_LINK}'))"


@query(f"SELECT coalesce(msg_id, -1) AS msg_id, count(*) FILTER (WHERE {_ITEM_OK}) AS good, count(*) FILTER (WHERE NOT ({_ITEM_OK})) AS bad FROM (SELECT msg_id, {_TRIM} AS t FROM ({_MAILS})) GROUP BY 1")
def addr_list_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of texts item by item: good ones and bad ones."""
    return _list_counts(table(spark, sf_dir, "addresses").where((F.col("addr_type") == "email") & F.col("address").isNotNull()))


def _list_counts(a: DataFrame) -> DataFrame:
    """Good and bad items of the lists of each message."""
    # A hot key makes many lists, not one; each of them is cut at the limit of items, above which nothing would be parsed.
    part = (F.xxhash64("addr_id") % 1000).alias("part")
    gathered = a.groupBy(F.coalesce("msg_id", F.lit(-1)).alias("msg_id"), part).agg(F.collect_list("address").alias("items"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("items"), F.lit(MAX_ITEMS)), lambda i: F.slice("items", i, MAX_ITEMS))
    lists = gathered.select("msg_id", F.explode(cuts).alias("items"))
    parsed = lists.select("msg_id", A.parse_address_items(F.col("items"), strict=True).alias("l"))
    return parsed.groupBy("msg_id").agg(F.sum(F.size("l.parsed")).alias("good"), F.sum(F.size("l.unparsed")).alias("bad"))


@query()
def addr_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each parsed address of the To fields."""
    to = table(spark, sf_dir, "message_headers").where(F.lower("hname") == "to").select("msg_id", "hpos", "raw").dropDuplicates()
    return explode_addresses(to, "raw").select("msg_id", "hpos", "pos", A.to_unicode(F.col("address")).alias("address"))


@query(f"SELECT account_key, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts FROM ({_STRICT}) GROUP BY account_key")
def addr_distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails(spark, sf_dir).groupBy("account_key").agg(F.array_join(F.sort_array(F.collect_set("a.hostname")), ",").alias("hosts"))


@query(f"SELECT addr_id FROM ({_STRICT}) WHERE host IN (SELECT lower(hostname) FROM common_hosts)")
def addr_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emails(spark, sf_dir)
    return members(e, F.col("a.hostname"), table(spark, sf_dir, "common_hosts"), F.lower("hostname")).select("addr_id")


@query(f"SELECT addr_id FROM ({_STRICT}) WHERE host NOT IN (SELECT lower(hostname) FROM common_hosts)")
def addr_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emails(spark, sf_dir)
    return members(e, F.col("a.hostname"), table(spark, sf_dir, "common_hosts"), F.lower("hostname"), inside=False).select("addr_id")


@query(f"SELECT lower(local || '@' || host) AS key, count(*) AS n FROM ({_STRICT}) GROUP BY 1")
def addr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails(spark, sf_dir).groupBy(A.address_key(F.col("a")).alias("key")).agg(F.count("*").alias("n"))


@query(f"SELECT msg_id, count(*) AS n, count(DISTINCT lower(local || '@' || host)) AS different, count(DISTINCT host) AS hosts FROM ({_STRICT}) WHERE msg_id IS NOT NULL GROUP BY msg_id")
def addr_list_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of lists after concatenation with itself and removal of one, as sets, and their hosts."""
    xs = emails(spark, sf_dir).where(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.collect_list("a").alias("xs"))
    xs = xs.withColumn("twice", A.list_concat(F.col("xs"), F.col("xs")))
    same = A.list_equals(F.col("xs"), F.col("twice")) & A.list_contains(F.col("xs"), F.col("xs")[0])
    n = F.size(A.list_append(A.list_remove(F.col("xs"), F.col("xs")[0]), F.col("xs")[0]))
    return xs.where(same).select("msg_id", n.cast("bigint").alias("n"), F.size(F.array_distinct(F.transform("twice", A.address_key))).cast("bigint").alias("different"), F.size(A.list_hostnames(F.col("xs"))).cast("bigint").alias("hosts"))


@query(f"SELECT addr_id, NOT regexp_full_match(address_, '[\\x00-\\x7F]*') AS non_ascii, starts_with(host, '[') AND ends_with(host, ']') AS literal FROM (SELECT *, local || '@' || host AS address_ FROM ({_STRICT}))")
def addr_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails(spark, sf_dir).select("addr_id", A.contains_non_ascii(F.col("a")).alias("non_ascii"), A.contains_domain_literal(F.col("a")).alias("literal"))


@query()
def addr_full_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with their display names in ASCII."""
    named = emails(spark, sf_dir).select("addr_id", F.struct(F.lit("email").alias("addr_type"), F.col("display_name"), F.col("a.mailbox").alias("mailbox"), F.col("a.hostname").alias("hostname"), F.col("a.address").alias("address")).alias("a"))
    return named.select("addr_id", A.full_spec(F.col("a")).alias("spec"), A.ace_hostname(F.col("a.hostname")).alias("ace"), A.requires_non_ascii(F.col("a")).alias("needs_unicode"))


@query("SELECT lower(regexp_extract(address, '^https?://([^/:?#]+)', 1)) AS host, count(*) AS n FROM addresses WHERE addr_type = 'url' AND regexp_full_match(address, '(?i)https?://[^\\s<>{}|^~\\[\\]`;,]+') GROUP BY 1")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "addresses").where((F.col("addr_type") == "url") & A.is_url(F.col("address")))
    return u.groupBy(A.url_hostname(F.col("address")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT addr_id, lower(regexp_extract(address, '^(https?)://', 1)) AS scheme, regexp_extract(address, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM addresses WHERE addr_type = 'url' AND regexp_full_match(address, '(?i)https?://[^\\s<>{}|^~\\[\\]`;,]+')")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "addresses").where((F.col("addr_type") == "url") & A.is_url(F.col("address")))
    return u.select("addr_id", A.url_scheme(F.col("address")).alias("scheme"), A.url_path(F.col("address")).alias("path"))


_PROVIDER_SQL = r"""
WITH m AS (SELECT DISTINCT mailbox FROM addresses WHERE addr_type = 'email' AND mailbox IS NOT NULL), b AS (SELECT mailbox, split_part(mailbox, '+', 1) AS base FROM m)
SELECT mailbox,
 length(replace(base, '.', '')) BETWEEN 6 AND 30 AND regexp_full_match(base, '(?:[A-Za-z0-9]|[^\x00-\x7F])+(?:\.(?:[A-Za-z0-9]|[^\x00-\x7F])+)*') AS gmail,
 length(base) <= 64 AND regexp_full_match(base, '(?:[A-Za-z0-9_\-''.]|[^\x00-\x7F])+') AND NOT starts_with(base, '.') AND NOT ends_with(base, '.') AS google,
 length(base) BETWEEN 1 AND 64 AND regexp_matches(base, '^(?:[A-Za-z0-9]|[^\x00-\x7F])') AND NOT ends_with(base, '.') AND length(mailbox) - length(replace(mailbox, '+', '')) <= 1 AND regexp_full_match(base, '(?:[A-Za-z0-9._\-]|[^\x00-\x7F])+') AS hotmail,
 length(base) BETWEEN 3 AND 20 AND regexp_full_match(base, '(?:[A-Za-z]|[^\x00-\x7F])+(?:[._]?(?:[A-Za-z0-9]|[^\x00-\x7F])+)*[._]?') AND regexp_matches(base, '(?:[A-Za-z0-9]|[^\x00-\x7F])$') AND NOT ends_with(mailbox, '+') AS icloud,
 length(mailbox) BETWEEN 3 AND 32 AND regexp_full_match(mailbox, '(?:[A-Za-z]|[^\x00-\x7F])+(?:[._]?(?:[A-Za-z0-9]|[^\x00-\x7F])+)*[._]?') AND regexp_matches(mailbox, '(?:[A-Za-z0-9]|[^\x00-\x7F])$') AS aol
FROM b"""


@query(_PROVIDER_SQL)
def provider_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "addresses").where((F.col("addr_type") == "email") & F.col("mailbox").isNotNull()).select("mailbox").distinct()
    return m.select("mailbox", *(A.provider_valid(F.lit(p), F.col("mailbox"), F.lit("x.example")).alias(p) for p in ("gmail", "google", "hotmail", "icloud", "aol")))


_YAHOO = r"""regexp_matches(mailbox, '[A-Za-z0-9]$') AND CASE WHEN contains(mailbox, '-') THEN length(mailbox) BETWEEN 3 AND 65 AND len(string_split(mailbox, '-')) = 2
 AND regexp_full_match(split_part(mailbox, '-', 1), '[A-Za-z0-9_]{1,32}') AND regexp_full_match(split_part(mailbox, '-', 2), '[A-Za-z0-9]{1,32}')
 ELSE length(mailbox) BETWEEN 4 AND 32 AND length(mailbox) - length(replace(mailbox, '.', '')) <= 1 AND regexp_full_match(mailbox, '[A-Za-z0-9]+([._]?[A-Za-z0-9]+)*') END"""


@query(f"SELECT mailbox, regexp_matches(mailbox, '^[A-Za-z]') AND {_YAHOO} AS managed, {_YAHOO} AS other FROM (SELECT DISTINCT mailbox FROM addresses WHERE addr_type = 'email' AND mailbox IS NOT NULL)")
def provider_yahoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "addresses").where((F.col("addr_type") == "email") & F.col("mailbox").isNotNull()).select("mailbox").distinct()
    return m.select("mailbox", A.provider_valid(F.lit("yahoo"), F.col("mailbox"), F.lit("yahoo.com")).alias("managed"), A.provider_valid(F.lit("yahoo"), F.col("mailbox"), F.lit("x.example")).alias("other"))


@query(f"SELECT a.addr_id, CASE WHEN a.address IS NULL OR a.address = '' THEN 'empty' WHEN NOT contains(a.address, '@') THEN 'no @' WHEN p.addr_id IS NULL THEN 'syntax' WHEN h.hostname IS NULL AND NOT starts_with(p.host, '[') THEN 'exchanger' END AS reject_reason FROM addresses a LEFT JOIN (SELECT * FROM ({_STRICT}) WHERE regexp_full_match(t, '{_SPEC}')) p USING (addr_id) LEFT JOIN (SELECT DISTINCT lower(hostname) AS hostname FROM common_hosts) h ON h.hostname = p.host WHERE a.addr_type = 'email'")
def addr_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation against a table of exchangers; those of the common hosts belong to no provider."""
    a = table(spark, sf_dir, "addresses").where(F.col("addr_type") == "email")
    mx = table(spark, sf_dir, "common_hosts").select(F.col("hostname").alias("domain"), F.concat(F.lit("mx."), "hostname").alias("mx_host"))
    return validate_addresses(a, "address", exchangers=mx).select("addr_id", "reject_reason")


@query()
def domain_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for every address of the address book from the common hosts; the ratio of matching blocks has no SQL."""
    common = table(spark, sf_dir, "common_hosts").select("hostname")
    return suggest_domains(table(spark, sf_dir, "addresses").select("addr_id", "address"), "address", common)


_FIXED = ", ".join(f"('{k}', '{v}')" for k, v in EXACT_FIXES.items())


@query(f"SELECT addr_id, CASE WHEN f.good IS NOT NULL THEN coalesce(local, '') || '@' || f.good END AS suggestion FROM (SELECT addr_id, regexp_extract(address, '^([^@]*)', 1) AS local, CASE addr_id % 3 WHEN 0 THEN 'gmail' WHEN 1 THEN 'verizon' ELSE 'gmail.com' END AS word FROM addresses WHERE address IS NOT NULL) LEFT JOIN (VALUES {_FIXED}) f(bad, good) ON f.bad = word")
def domain_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local parts with a bare word for a domain, which stands for a fixed domain."""
    word = F.when(F.col("addr_id") % 3 == 0, "gmail").when(F.col("addr_id") % 3 == 1, "verizon").otherwise("gmail.com")
    typed = table(spark, sf_dir, "addresses").where(F.col("address").isNotNull()).select("addr_id", F.concat(F.substring_index("address", "@", 1), F.lit("@"), word).alias("typed"))
    return suggest_domains(typed, "typed", cutoff=1.0).select("addr_id", "suggestion")


def _known_hosts(name: str) -> list[str]:
    """Two exchangers for each domain; none for those that begin with a vowel. Stands in for a resolver."""
    return [] if name[0] in "aeiou" else [f"mx1.{name}", f"mx2.{name}"]


def _reach_second(hosts: list[str]) -> str | None:
    """The last host. Stands in for a connection."""
    return hosts[-1] if hosts else None


@query(f"SELECT host AS domain, CASE WHEN starts_with(host, '[') THEN host[2:-2] WHEN h.hostname IS NOT NULL THEN CASE WHEN h.host_id % 3 = 0 THEN NULL WHEN h.host_id % 3 = 1 THEN 'kept.' || host WHEN NOT regexp_matches(host, '^[aeiou]') THEN 'mx2.' || host || '.' END WHEN NOT regexp_matches(host, '^[aeiou]') THEN 'mx2.' || host || '.' END AS mx_host FROM (SELECT DISTINCT host FROM ({_STRICT})) LEFT JOIN (SELECT lower(hostname) AS hostname, min(host_id) AS host_id FROM common_hosts GROUP BY 1) h ON h.hostname = host")
def exchangers_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchangers of all hosts: a third of the common hosts is known to have none, a third is known, of a third what is known is too old."""
    now = dt.datetime(2025, 1, 10)
    kept = F.when(F.col("id") % 3 == 0, "False").otherwise(F.concat(F.lit("kept."), "domain"))
    at = F.when(F.col("id") % 3 == 2, F.lit(dt.datetime(2025, 1, 1))).otherwise(F.lit(dt.datetime(2025, 1, 9)))
    known = table(spark, sf_dir, "common_hosts").groupBy(F.lower("hostname").alias("domain")).agg(F.min("host_id").alias("id")).select("domain", kept.alias("mx_host"), at.cast("timestamp").alias("fetched_at"))
    hosts = emails(spark, sf_dir).select(F.col("a.hostname").alias("host"))
    return lookup_exchangers(hosts, now, known, _known_hosts, _reach_second).select("domain", "mx_host")


_PROVIDER_MX = ["mta5.am0.yahoodns.net", "alt1.gmail-smtp-in.l.google.com", "mailin-01.mx.aol.com", "mx01.mail.icloud.com", "mx1.hotmail.com", "aspmx.l.google.com", "mx.other.example"]
_PROVIDER_NAMES = ["yahoo", "gmail", "aol", "icloud", "hotmail", "google", None]


@query("SELECT addr_id, " + "CASE addr_id % 7 " + " ".join(f"WHEN {i} THEN {repr(x) if x else 'NULL'}" for i, x in enumerate(_PROVIDER_NAMES)) + " END AS provider FROM addresses")
def provider_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers by the names of their exchangers."""
    mx = F.element_at(F.array(*map(F.lit, _PROVIDER_MX)), (F.col("addr_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "addresses").select("addr_id", A.provider_of(mx).alias("provider"))


@query(f"SELECT msg_id, array_to_string(list_sort(list(host_ok) FILTER (WHERE ok)), ' ') AS valid, array_to_string(list_sort(list(host_ok) FILTER (WHERE NOT ok)), ' ') AS rejected FROM (SELECT msg_id, local || '@' || host AS host_ok, host IN (SELECT lower(hostname) FROM common_hosts) OR starts_with(host, '[') AS ok FROM ({_STRICT}) WHERE msg_id IS NOT NULL) GROUP BY msg_id")
def addr_lists_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of a message as one text, validated against the exchangers of the common hosts."""
    lists = emails(spark, sf_dir).where(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("a.address"))), ", ").alias("text"))
    mx = table(spark, sf_dir, "common_hosts").select(F.col("hostname").alias("domain"), F.concat(F.lit("mx."), "hostname").alias("mx_host"))
    joined = lambda c: F.nullif(F.array_join(F.sort_array(c), " "), F.lit(""))
    return validate_lists(lists, "msg_id", "text", exchangers=mx).select("msg_id", joined("valid").alias("valid"), joined("rejected").alias("rejected"))


@query(f"SELECT msg_id, 'email url' AS types, string_agg(local || '@' || host, '; ' ORDER BY local || '@' || host) || '; https://x.example:8080/p' AS spec, count(*) + 1 AS n, string_agg(local || '@' || host, ', ' ORDER BY local || '@' || host) AS mails FROM ({_STRICT}) WHERE msg_id IS NOT NULL AND regexp_full_match(host, '[a-z0-9]([a-z0-9.-]*[a-z0-9])?') AND regexp_full_match(local, '[\\x00-\\x7F]*') GROUP BY msg_id")
def addr_list_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ASCII addresses and a URL as text: their kinds, their whole text, and the addresses in Unicode."""
    e = emails(spark, sf_dir).where(F.col("msg_id").isNotNull() & A.ace_address(F.col("a")).eqNullSafe(F.concat(F.col("a.mailbox"), F.lit("@"), F.col("a.hostname"))))
    plain = F.struct(*(F.when(F.lit(f == "display_name"), "").otherwise(F.col(f"a.{f}")).alias(f) if f == "display_name" else F.col(f"a.{f}").alias(f) for f in ("addr_type", "display_name", "mailbox", "hostname", "address", "scheme", "port", "path")))
    xs = e.groupBy("msg_id").agg(F.sort_array(F.collect_list(F.col("a.address"))).alias("texts"), F.array_sort(F.collect_list(plain), lambda x, y: F.when(x["address"] < y["address"], -1).when(x["address"] > y["address"], 1).otherwise(0)).alias("mails"))
    url = A.parse_address(F.lit("https://x.example:8080/p"))
    xs = xs.withColumn("all", A.list_append(F.col("mails"), url))
    return xs.select("msg_id", F.array_join(A.list_addr_types(F.col("all")), " ").alias("types"), A.list_full_spec(F.col("all"), "; ").alias("spec"), F.size(A.list_to_ascii(F.col("all"))).cast("bigint").alias("n"), A.list_to_unicode(F.col("mails")).alias("mails"))


@query(f"SELECT addr_id, true AS same, true AS routed, lower(local || '@' || host) AS key FROM ({_STRICT})")
def addr_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality with the address in capitals."""
    shouted = F.concat(F.upper("a.mailbox"), F.lit("@"), F.col("a.hostname"))
    return emails(spark, sf_dir).select("addr_id", (A.address_key(F.col("a")) == F.lower(shouted)).alias("same"), A.supports_routing(F.col("a")).alias("routed"), A.address_key(F.col("a")).alias("key"))


@query("SELECT addr_id, CASE addr_id % 3 WHEN 0 THEN 8080 WHEN 1 THEN 80 ELSE -1 END AS port, true AS same, u AS spec FROM (SELECT addr_id, regexp_extract(address, '^(https?://[^/?#:]+)', 1) || CASE addr_id % 3 WHEN 0 THEN ':8080' WHEN 1 THEN ':80' ELSE '' END || '/x?q=1' AS u FROM addresses WHERE addr_type = 'url' AND regexp_full_match(address, '(?i)https?://[^\\s<>{}|^~\\[\\]`;,]+'))")
def url_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports of URLs, their equality and their whole text."""
    u = table(spark, sf_dir, "addresses").where((F.col("addr_type") == "url") & A.is_url(F.col("address")))
    port = F.when(F.col("addr_id") % 3 == 0, ":8080").when(F.col("addr_id") % 3 == 1, ":80").otherwise("")
    u = u.select("addr_id", F.concat(F.regexp_extract("address", "^(https?://[^/?#:]+)", 1), port, F.lit("/x?q=1")).alias("u")).withColumn("a", A.parse_address(F.col("u")))
    return u.select("addr_id", F.coalesce(A.url_port(F.col("u")), F.lit(-1)).alias("port"), A.address_equals(F.col("a"), F.col("u")).alias("same"), A.full_spec(F.col("a")).alias("spec"))


@query(r"SELECT addr_id, trim(address, '<>;, ') AS cleaned, regexp_matches(address, '^[\x00-\x1F\x{7F}-\x{9F}]') AS control FROM addresses WHERE address IS NOT NULL")
def addr_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "addresses").where(F.col("address").isNotNull())
    return a.select("addr_id", A.cleanup_email(F.col("address")).alias("cleaned"), A.contains_control_chars(F.col("address")).alias("control"))


@query(r"""SELECT addr_id, CASE WHEN regexp_full_match(display_name, '(?:(?:[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]|[^\x00-\x7F])+(?:\s+(?:[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]|[^\x00-\x7F])+)*)?') THEN display_name ELSE '"' || replace(replace(display_name, '\', '\\'), '"', '\"') || '"' END AS quoted, trim(display_name, ';,''' || chr(13) || chr(10) || ' ') AS cleaned FROM addresses WHERE display_name IS NOT NULL""")
def names_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "addresses").where(F.col("display_name").isNotNull())
    return a.select("addr_id", A.smart_quote(F.col("display_name")).alias("quoted"), A.cleanup_display_name(F.col("display_name")).alias("cleaned"))


@query("SELECT addr_id, display_name AS again FROM addresses WHERE display_name IS NOT NULL")
def names_unquoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoting and unquoting gives the name back."""
    a = table(spark, sf_dir, "addresses").where(F.col("display_name").isNotNull())
    return a.select("addr_id", A.smart_unquote(A.smart_quote(F.col("display_name"))).alias("again"))


@query("SELECT array_to_string(list_transform(string_split(lower(hname), '-'), lambda p: upper(p[1]) || p[2:]), '-') AS name, count(*) AS n FROM message_headers WHERE hname IS NOT NULL GROUP BY 1")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "message_headers").where(F.col("hname").isNotNull()).groupBy(M.normalize_name(F.col("hname")).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT msg_id, hpos, decoded AS subject FROM message_headers WHERE lower(hname) = 'subject' AND raw IS NOT NULL")
def subject_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded words of subjects; the table has them decoded by other means."""
    s = table(spark, sf_dir, "message_headers").where((F.lower("hname") == "subject") & F.col("raw").isNotNull())
    return s.select("msg_id", "hpos", M.decode_header(F.col("raw")).alias("subject")).dropDuplicates()


@query(r"SELECT DISTINCT msg_id, hpos, regexp_replace(coalesce(decoded, ''), '(?i)(?:(?:RE|FW|FWD|HA)(?:\[\d\])*:\s*)+', '', 'g') AS subject FROM message_headers WHERE lower(hname) = 'subject'")
def subject_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "message_headers").where(F.lower("hname") == "subject")
    return s.select("msg_id", "hpos", M.clean_subject(F.col("decoded")).alias("subject")).dropDuplicates()


@query(r"SELECT DISTINCT msg_id, hpos, array_to_string(list_filter(regexp_extract_all(raw, '<([^<>\r\n]+)>', 1), lambda i: length(i) > 5 AND length(i) < 256), ' ') AS ids FROM message_headers WHERE lower(hname) = 'references' AND raw IS NOT NULL")
def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "message_headers").where((F.lower("hname") == "references") & F.col("raw").isNotNull())
    return r.select("msg_id", "hpos", F.array_join(M.message_ids(F.col("raw")), " ").alias("ids")).dropDuplicates()


@query(r"SELECT DISTINCT msg_id, hpos, regexp_replace(raw, '\n\r?|\r\n?', '', 'g') AS flat, replace(replace(raw, chr(13), ''), chr(10), '') AS bare FROM message_headers WHERE raw IS NOT NULL")
def headers_unfolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "message_headers").where(F.col("raw").isNotNull())
    return h.select("msg_id", "hpos", M.unfold(F.col("raw")).alias("flat"), M.remove_newlines(F.col("raw")).alias("bare")).dropDuplicates()


@query(r"SELECT msg_id, arg_max(raw, hpos) AS last, count(DISTINCT hpos) AS n FROM message_headers WHERE lower(hname) = 'received' AND raw IS NOT NULL GROUP BY msg_id")
def header_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a message as an ordered multi-map: the last Received and how many there are."""
    h = table(spark, sf_dir, "message_headers").where((F.lower("hname") == "received") & F.col("raw").isNotNull()).select("msg_id", "hpos", "hname", "raw").dropDuplicates(["msg_id", "hpos"])
    one = F.struct("hpos", M.normalize_name(F.col("hname")).alias("name"), "raw")
    params = F.create_map().cast("map<string,string>")
    hs = h.groupBy("msg_id").agg(F.array_sort(F.collect_list(one)).alias("hs")).withColumn("hs", F.transform("hs", lambda x: F.struct(x["name"].alias("name"), x["raw"].alias("raw"), x["raw"].alias("value"), params.alias("params"))))
    return hs.select("msg_id", M.header_get(F.col("hs"), "RECEIVED").alias("last"), F.size(M.header_all(F.col("hs"), "received")).cast("bigint").alias("n"))


def _multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id and `hs`, the ordered headers of each message; of repeated rows one counts, and of different values at one place the least."""
    h = table(spark, sf_dir, "message_headers").where(F.col("msg_id").isNotNull() & F.col("hname").isNotNull()).groupBy("msg_id", "hpos").agg(F.min(F.struct("hname", F.coalesce("raw", F.lit("")).alias("raw"))).alias("h")).select("msg_id", "hpos", "h.*")
    params = F.create_map().cast("map<string,string>")
    hs = h.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("hpos", M.normalize_name(F.col("hname")).alias("name"), "raw"))).alias("hs"))
    return hs.withColumn("hs", F.transform("hs", lambda x: F.struct(x["name"].alias("name"), x["raw"].alias("raw"), x["raw"].alias("value"), params.alias("params"))))


_HEADS = "SELECT msg_id, hpos, array_to_string(list_transform(string_split(lower(h.hname), '-'), lambda p: upper(p[1]) || p[2:]), '-') AS name, h.raw AS raw FROM (SELECT msg_id, hpos, min({'hname': hname, 'raw': coalesce(raw, '')}) AS h FROM message_headers WHERE msg_id IS NOT NULL AND hname IS NOT NULL GROUP BY msg_id, hpos)"


@query(f"SELECT msg_id, count(*) AS before, 1 + count(*) FILTER (WHERE name <> 'Subject') + 1 AS after_set, 2 + count(*) FILTER (WHERE name NOT IN ('Subject', 'Received')) AS after_delete, true AS changed, false AS there, CASE WHEN count(*) FILTER (WHERE name = 'Subject') > 0 THEN 'X-Seen' ELSE 'Subject' END AS first FROM ({_HEADS}) GROUP BY msg_id")
def header_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set, prepend and delete on the headers of every message."""
    e = _multimap(spark, sf_dir)
    e = e.withColumn("changed", M.header_set(M.header_prepend(F.col("hs"), "X-Seen", F.lit("1")), "Subject", F.lit("edited"))).withColumn("left", M.header_delete(F.col("changed"), "Received"))
    size = lambda c: F.size(c).cast("bigint")
    return e.select("msg_id", size("hs").alias("before"), size("changed").alias("after_set"), size("left").alias("after_delete"), M.headers_changed(F.col("hs"), F.col("left")).alias("changed"), M.header_has(F.col("left"), "received").alias("there"), F.col("left")[0]["name"].alias("first"))


@query(f"SELECT msg_id, arg_max(raw, hpos) FILTER (WHERE name = 'From') AS sender, string_agg(name, ' ' ORDER BY hpos) AS names, string_agg('<' || raw || '>', '|' ORDER BY hpos) AS marked FROM ({_HEADS}) GROUP BY msg_id")
def header_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw value of From, all names in order, and all values transformed."""
    hs = F.col("hs")
    marked = M.header_transform(hs, lambda h: F.struct(h["name"].alias("name"), h["raw"].alias("raw"), F.concat(F.lit("<"), h["value"], F.lit(">")).alias("value"), h["params"].alias("params")))
    return _multimap(spark, sf_dir).select("msg_id", M.header_get_raw(hs, "from").alias("sender"), F.array_join(F.transform(hs, lambda h: h["name"]), " ").alias("names"), F.array_join(F.transform(marked, lambda h: h["value"]), "|").alias("marked"))


@query(f"SELECT msg_id, hpos, name, raw AS value FROM ({_HEADS})")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-map back to rows with positions."""
    m = M.header_rows(_multimap(spark, sf_dir), "msg_id", "hs")
    real = table(spark, sf_dir, "message_headers").where(F.col("msg_id").isNotNull() & F.col("hname").isNotNull()).groupBy("msg_id").agg(F.sort_array(F.collect_set("hpos")).alias("places"))
    return m.join(real, "msg_id").select("msg_id", F.col("places")[F.col("pos")].alias("hpos"), "name", "value")


@query("SELECT msg_id, 'X-Trace: ' || msg_id || chr(13) || chr(10) || body AS text FROM (SELECT msg_id, min(body) AS body FROM messages WHERE body IS NOT NULL GROUP BY msg_id)")
def header_prepended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with nothing but a new header in front: the rest is their own text."""
    from lettermill.operators.mail import serialise

    m = table(spark, sf_dir, "messages").where(F.col("body").isNotNull()).groupBy("msg_id").agg(F.min("body").alias("body"))
    none = F.array().cast("array<struct<name:string,raw:string,value:string,params:map<string,string>>>")
    head = M.headers_to_text(M.header_prepend(none, "X-Trace", F.col("msg_id").cast("string")))
    return serialise(m.withColumn("head", head), "body", "head").select("msg_id", "text")


@query(r"SELECT addr_id, replace(replace(display_name, chr(13), ''), chr(10), '') AS name, true AS coded FROM addresses WHERE display_name IS NOT NULL AND NOT contains(display_name, '=?') AND NOT regexp_matches(display_name, '^\s|\s$|\s\s') AND NOT regexp_matches(display_name, '[\x00-\x1f\x{7f}-\x{9f}]')")
def header_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names as header values: encoded, folded and decoded again. Where white space would be folded away the round trip says nothing."""
    a = table(spark, sf_dir, "addresses").where(F.col("display_name").isNotNull() & ~F.col("display_name").contains("=?") & ~F.col("display_name").rlike(r"^\s|\s$|\s\s") & ~F.col("display_name").rlike(r"[\x00-\x1f\x7f-\x9f]"))
    coded = a.withColumn("v", M.encode_header("X-Name", F.col("display_name")))
    return coded.select("addr_id", F.regexp_replace(M.decode_header(F.col("v")), r"[\r\n]", "").alias("name"), A.is_pure_ascii(F.col("v")).alias("coded"))


@query("SELECT addr_id, 'attachment' AS value, display_name AS name, display_name AS pieces FROM addresses WHERE display_name IS NOT NULL AND display_name <> '' AND NOT regexp_matches(display_name, '[\"\\\\]')")
def header_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names as a parameter in percent-encoded UTF-8, whole and in two numbered pieces."""
    a = table(spark, sf_dir, "addresses").where(F.col("display_name").isNotNull() & (F.col("display_name") != "") & ~F.col("display_name").rlike(r'["\\]'))
    coded = F.replace(F.url_encode("display_name"), F.lit("+"), F.lit("%20"))
    a = a.withColumn("coded", coded).withColumn("one", F.concat(F.lit("attachment; filename*=utf-8''"), F.col("coded")))
    a = a.withColumn("two", F.concat(F.lit("attachment; filename*0*=utf-8''"), F.expr("substr(coded, 1, 3 * (length(coded) div 6))"), F.lit("; filename*1*="), F.expr("substr(coded, 3 * (length(coded) div 6) + 1)")))
    one, two = M.parametrised(F.col("one")), M.parametrised(F.col("two"))
    return a.select("addr_id", one["value"].alias("value"), one["params"]["filename"].alias("name"), two["params"]["filename"].alias("pieces"))


_KIND_SQL = r"""SELECT DISTINCT msg_id, hpos, raw, CASE WHEN k = '' THEN 'text/plain' WHEN contains(k, '/') THEN trim(split_part(k, '/', 1)) || '/' || trim(split_part(k, '/', 2)) WHEN k = 'text' THEN 'text/plain' WHEN k = 'html' THEN 'text/html' ELSE 'application/octet-stream' END AS kind
 FROM (SELECT *, lower(regexp_extract(raw, '^\s*([^\s;]+(?:\s*/\s*[^\s;]+)?)', 1)) AS k FROM message_headers WHERE lower(hname) = 'content-type' AND raw IS NOT NULL)"""


@query(rf"SELECT msg_id, hpos, kind, coalesce(lower(nullif(regexp_extract(raw, '(?i)charset=\"?([^\";\s]+)', 1), '')), CASE WHEN starts_with(kind, 'text/') THEN 'ascii' END) AS charset FROM ({_KIND_SQL})")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _typed(spark, sf_dir)
    return c.select("msg_id", "hpos", "kind", M.part_charset(F.col("main"), F.col("p.params")).alias("charset"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-Type fields with their kind, `main`, `sub` and the parsed value `p`."""
    c = table(spark, sf_dir, "message_headers").where((F.lower("hname") == "content-type") & F.col("raw").isNotNull()).select("msg_id", "hpos", "raw").dropDuplicates()
    c = c.withColumn("p", M.parametrised(F.col("raw"))).withColumn("kind", M.fix_content_type(F.col("p.value")))
    return c.withColumn("main", F.trim(F.split("kind", "/")[0])).withColumn("sub", F.trim(F.split("kind", "/")[1])).withColumn("kind", F.concat_ws("/", "main", "sub"))


@query(rf"SELECT msg_id, hpos, starts_with(kind, 'multipart/') AS multi, kind IN ('message/rfc822', 'message/global', 'message/news') AS message, kind IN ('text/rfc822-headers', 'message/feedback-report', 'message/external-body', 'message/disposition-notification') AS headers, kind = 'message/delivery-status' AS status, kind = 'message/feedback-report' AS feedback, kind = 'text/plain' AS same FROM ({_KIND_SQL})")
def content_type_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of content types, and equality with plain text."""
    main, sub = F.col("main"), F.col("sub")
    return _typed(spark, sf_dir).select("msg_id", "hpos", M.is_multipart(main).alias("multi"), M.is_message_container(main, sub).alias("message"), M.is_headers_container(main, sub).alias("headers"), M.is_delivery_status(main, sub).alias("status"), M.is_feedback_report(main, sub).alias("feedback"), M.content_type_equals(main, sub, F.lit("Text/PLAIN")).alias("same"))


@query(rf"SELECT msg_id, hpos, CASE WHEN regexp_matches(raw, '(?i)boundary=') THEN '--' || regexp_extract(raw, '(?i)boundary=\"?([^\";\s]+)', 1) || '--' END AS final, 'utf-8' AS charset FROM ({_KIND_SQL})")
def content_type_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing boundary line, and the parameters with another charset."""
    return _typed(spark, sf_dir).select("msg_id", "hpos", M.boundary_line(F.col("p.params"), final=True).alias("final"), M.set_charset(F.coalesce(F.col("p.params"), F.create_map().cast("map<string,string>")), F.lit("UTF-8"))["charset"].alias("charset"))


@query("SELECT msg_id, count(*) FILTER (WHERE id <> '') AS ids, min(id) FILTER (WHERE id <> '') AS least, true AS same FROM (SELECT DISTINCT msg_id, hpos, regexp_extract(raw, '<([^<>\\r\\n]+)>', 1) AS id FROM message_headers WHERE lower(hname) IN ('message-id', 'in-reply-to') AND raw IS NOT NULL) GROUP BY msg_id")
def message_id_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of messages and of what they answer, and equality without quotes."""
    h = table(spark, sf_dir, "message_headers").where(F.lower("hname").isin("message-id", "in-reply-to") & F.col("raw").isNotNull()).select("msg_id", "hpos", M.message_id(F.col("raw")).alias("id")).dropDuplicates()
    same = M.message_id_key(F.concat(F.lit("'"), F.coalesce("id", F.lit("")), F.lit('"'))) == M.message_id_key(F.coalesce("id", F.lit("")))
    return h.groupBy("msg_id").agg(F.count("id").alias("ids"), F.min("id").alias("least"), F.min(same).alias("same"))


@query("SELECT count(*) AS made, count(*) AS well_formed FROM messages")
def message_ids_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh ids: all different and of the form of an id."""
    m = table(spark, sf_dir, "messages").select("msg_id", M.generate_message_id("x.example").alias("id"))
    ok = F.col("id").rlike(r"^<[^<>@\s]+@x\.example>$")
    return m.agg(F.count("id").alias("made"), F.sum(ok.cast("bigint")).alias("well_formed"))


@query(r"SELECT doc_id, coalesce(regexp_full_match(text, '(?s)[\x00-\x7F]*'), false) AS ascii FROM documents")
def ascii_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", A.is_pure_ascii(F.col("text")).alias("ascii"))


@query(r"SELECT doc_id, list_max(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda l: strlen(l))) >= 599 AS long FROM documents WHERE text IS NOT NULL")
def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", M.has_long_lines(F.col("text")).alias("long"))


@query(r"SELECT encoding, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(text, '(?s)[\x00-\x7F]*') AND list_max(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda l: strlen(l))) < 599 THEN '7bit' ELSE 'quoted-printable' END AS encoding FROM documents WHERE text IS NOT NULL) GROUP BY encoding")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    charset = F.when(A.is_pure_ascii(F.col("text")), "ascii").otherwise("utf-8")
    return d.groupBy(M.choose_text_encoding(charset, F.lit("7bit"), F.col("text")).alias("encoding")).agg(F.count("*").alias("n"))


def _mime_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message of a text and an attachment for each document."""
    d = spread(table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text"))
    first = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 7bit\r\n\r\nhello "), F.col("doc_id").cast("string"))
    second = F.concat(F.lit('Content-Type: text/plain; charset="utf-8"; name="a.txt"\r\nContent-Disposition: attachment; filename="a.txt"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), F.base64(F.encode("text", "utf-8")))
    head = F.concat(F.lit("From: a@b.example\r\nSubject: doc "), F.col("doc_id").cast("string"), F.lit("\r\n"))
    return d.select("doc_id", F.concat(head, M.build_multipart("mixed", F.col("doc_id"), first, second)).alias("raw"))


@query("SELECT doc_id, part_id, kind, depth FROM documents, (VALUES (0, 'multipart/mixed', 0), (1, 'text/plain', 1), (2, 'text/plain', 1)) p(part_id, kind, depth) WHERE text IS NOT NULL")
def mime_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explode_parts(_mime_source(spark, sf_dir), "doc_id", "raw", fields=["part_id", "main", "sub", "depth"])
    return parts.select("doc_id", "part_id", F.concat_ws("/", "main", "sub").alias("kind"), "depth")


def is_attached(part: tuple) -> bool:
    """The test on a part's fields of `explode_bodies` for attachments."""
    return part[11] == "attachment"


@query("SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents WHERE text IS NOT NULL")
def mime_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attachment decoded is the document."""
    bodies = explode_bodies(_mime_source(spark, sf_dir), "doc_id", "raw", fields=["disposition"], keep=is_attached)
    return bodies.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, 'a.txt' AS name, false AS is_body, 'doc ' || doc_id AS subject FROM documents WHERE text IS NOT NULL")
def mime_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explode_parts(_mime_source(spark, sf_dir), "doc_id", "raw")
    root = parts.where(F.col("part_id") == 0).select("doc_id", M.header_get(F.col("headers"), "subject").alias("subject"))
    name = M.detected_file_name(F.col("params"), F.col("disposition_params"))
    return parts.where(F.col("part_id") == 2).select("doc_id", name.alias("name"), M.is_body(F.col("main"), name).alias("is_body")).join(root, "doc_id")


@query("SELECT DISTINCT msg_id, 'text/plain' AS kind, 'inner ' || msg_id AS body FROM messages")
def mime_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message inside a message."""
    m = table(spark, sf_dir, "messages").select("msg_id").distinct()
    inner = F.concat(F.lit("Subject: x\r\nContent-Type: text/plain\r\n\r\ninner "), F.col("msg_id").cast("string"))
    outer = F.concat(F.lit("Subject: y\r\n"), M.build_multipart("mixed", F.col("msg_id"), F.concat(F.lit("Content-Type: text/plain\r\n\r\n"), F.lit("hello")), M.build_message_container(inner)))
    source = m.select("msg_id", outer.alias("raw"))
    found = attached_message(explode_bodies(source, "msg_id", "raw", fields=["part_id", "parent_id", "main", "sub"]), "msg_id")
    return found.select("msg_id", F.concat_ws("/", "main", "sub").alias("kind"), F.col("text").alias("body"))


@query("SELECT doc_id, part_id, part_id <> 1 AS was_changed FROM documents, (VALUES (0), (1), (2)) p(part_id) WHERE text IS NOT NULL")
def mime_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of the second part makes the root a changed one."""
    parts = explode_parts(_mime_source(spark, sf_dir), "doc_id", "raw").withColumn("touched", F.col("part_id") == 2)
    return subtree_changed(parts, "doc_id", "touched")


@query("SELECT doc_id, 'new ' || doc_id AS subject, 'bye ' || doc_id AS first, md5(text) AS second FROM documents WHERE text IS NOT NULL")
def mime_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new subject and a new first body, written and read again; the attachment is as it was."""
    source = _mime_source(spark, sf_dir)
    parts = explode_parts(source, "doc_id", "raw")
    parts = parts.withColumn("h", F.when(F.col("part_id") == 0, M.header_set(F.col("headers"), "Subject", F.concat(F.lit("new "), F.col("doc_id").cast("string")))))
    parts = parts.withColumn("b", F.when(F.col("part_id") == 1, F.concat(F.lit("bye "), F.col("doc_id").cast("string"))))
    again = apply_edits(source, "doc_id", "raw", part_edits(parts, "doc_id", "h", "b"))
    read = explode_bodies(again.withColumnRenamed("text", "raw"), "doc_id", "raw", fields=["part_id", "headers"])
    one = read.groupBy("doc_id").agg(F.max(F.when(F.col("part_id") == 1, F.col("text"))).alias("first"), F.md5(F.encode(F.max(F.when(F.col("part_id") == 2, F.col("text"))), "utf-8")).alias("second"))
    root = read.where(F.col("part_id") == 0).select("doc_id", M.header_get(F.col("headers"), "Subject").alias("subject"))
    return one.join(root, "doc_id").select("doc_id", "subject", "first", "second")


@query("SELECT msg_id, (msg_id % 8) / 8.0 AS score, (msg_id % 8) / 8.0 > 0.3 AS is_bounce FROM (SELECT DISTINCT msg_id FROM messages)")
def bounce_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with as many bounce headers as the id says."""
    m = table(spark, sf_dir, "messages").select("msg_id").distinct()
    head: Column = F.lit("Subject: report\r\n")
    for i, name in enumerate(BOUNCE_HEADERS):
        head = F.concat(head, F.when(F.col("msg_id") % 8 > i, F.lit(f"{name}: 5.1.1 value\r\n")).otherwise(""))
    return detect_bounces(m.select("msg_id", F.concat(head, F.lit("\r\nbody")).alias("raw")), "msg_id", "raw").select("msg_id", "score", "is_bounce")


@query("SELECT msg_id, 'lenient' AS parser, 'multipart/mixed' AS kind, 'Broken: ' || msg_id AS subject FROM (SELECT DISTINCT msg_id FROM messages)")
def mime_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiparts without a boundary, which only the lenient parser reads."""
    m = table(spark, sf_dir, "messages").select("msg_id").distinct()
    raw = F.concat(F.lit("Subject: Broken: "), F.col("msg_id").cast("string"), F.lit("\r\nContent-Type: multipart/mixed\r\n\r\nx"))
    p = m.select("msg_id", M.parse_mime(raw, recover=True).alias("m"))
    top = F.col("m.parts")[0]
    return p.select("msg_id", F.col("m.parser").alias("parser"), F.concat_ws("/", top["main"], top["sub"]).alias("kind"), M.header_get(top["headers"], "Subject").alias("subject"))


@query("SELECT msg_id, CASE WHEN msg_id % 50 = 0 THEN 'too many parts' WHEN msg_id % 2 = 1 THEN 'multipart without boundary' ELSE 'status report that stands alone' END AS error FROM (SELECT DISTINCT msg_id FROM messages)")
def mime_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why messages cannot be read: more parts than the limit, no boundary, a status report alone."""
    many = F.concat(F.lit('Content-Type: multipart/mixed; boundary="b"\r\n\r\n'), F.repeat(F.lit("--b\r\n\r\nx\r\n"), F.lit(5001)))
    k = F.col("msg_id")
    raw = F.when(k % 50 == 0, many).when(k % 2 == 1, "Content-Type: multipart/mixed\r\n\r\nx").otherwise("Content-Type: message/delivery-status\r\n\r\nx")
    m = table(spark, sf_dir, "messages").select("msg_id").distinct().select("msg_id", raw.alias("raw"))
    return parse_errors(m, "msg_id", "raw")


@query("SELECT doc_id, octet_length(encode('Content-Type: text/plain; charset=utf-8' || chr(13) || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(13) || chr(10) || chr(13) || chr(10) || text)) AS size, text AS body FROM documents WHERE text IS NOT NULL")
def mime_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of single-part messages as they are written, and their 8-bit bodies."""
    d = spread(table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text"))
    raw = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.col("text"))
    return explode_bodies(d.select("doc_id", raw.alias("raw")), "doc_id", "raw", fields=["size"]).select("doc_id", F.col("size").cast("bigint").alias("size"), F.col("text").alias("body"))


@query("SELECT doc_id, string_agg(kind, ' ' ORDER BY part_id) AS kinds FROM documents, (VALUES (0, 'multipart/mixed'), (1, 'text/plain'), (2, 'text/plain'), (3, 'message/rfc822'), (4, 'text/plain'), (5, 'text/html')) p(part_id, kind) WHERE text IS NOT NULL GROUP BY doc_id")
def mime_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to which an enclosed message and a part of HTML are appended, read again."""
    source = _mime_source(spark, sf_dir)
    inner = F.concat(F.lit("Subject: in "), F.col("doc_id").cast("string"), F.lit("\r\nContent-Type: text/plain\r\n\r\ninner"))
    more = append_parts(source, "doc_id", "raw", M.build_message_container(inner), F.lit("Content-Type: text/html\r\n\r\n<p>x</p>"))
    parts = explode_parts(more, "doc_id", "text", fields=["part_id", "main", "sub"])
    kinds = F.array_sort(F.collect_list(F.struct("part_id", F.concat_ws("/", "main", "sub").alias("k"))))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(kinds, lambda x: x["k"]), " ").alias("kinds"))


@query("SELECT addr_id, kind, display_name AS body FROM addresses, (VALUES ('7bit'), ('quoted-printable')) k(kind) WHERE display_name IS NOT NULL AND NOT regexp_matches(display_name, '[\\r\\n]')")
def mime_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in UTF-8, or ASCII where that will do, in a transfer encoding that carries them, and decoded again."""
    a = table(spark, sf_dir, "addresses").where(F.col("display_name").isNotNull() & ~F.col("display_name").rlike(r"[\r\n]"))
    a = a.select("addr_id", "display_name", F.explode(F.array(F.lit("7bit"), F.lit("quoted-printable"))).alias("kind"))
    a = a.withColumn("c", M.encode_body(F.col("display_name"), F.lit(None).cast("string"), F.col("kind")))
    raw = F.concat(F.lit("Content-Type: text/plain; charset="), F.col("c.charset"), F.lit("\r\nContent-Transfer-Encoding: "), F.col("c.encoding"), F.lit("\r\n\r\n"), F.col("c.text"))
    keyed = a.select(F.struct("addr_id", "kind").alias("k"), raw.alias("raw"))
    out = explode_bodies(keyed, "k", "raw", fields=["encoding"])
    return out.select("k.addr_id", "k.kind", F.regexp_replace("text", r"\r?\n\z", "").alias("body"))


_CHARSETS = {"iso-8859-1": "ä", "windows-1251": "ж", "koi8-r": "ж", "shift_jis": "あ", "utf-8": "ł"}


@query("SELECT msg_id, CASE msg_id % 5 " + " ".join(f"WHEN {i} THEN 'x {c} y'" for i, c in enumerate(_CHARSETS.values())) + " END AS body FROM (SELECT DISTINCT msg_id FROM messages)")
def mime_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in several charsets, as base64 of their bytes."""
    m = table(spark, sf_dir, "messages").select("msg_id").distinct()
    raw = F.lit("")
    for i, (name, c) in enumerate(_CHARSETS.items()):
        text = f"Content-Type: text/plain; charset={name}\r\nContent-Transfer-Encoding: base64\r\n\r\n{base64.b64encode(f'x {c} y'.encode(name)).decode()}"
        raw = F.when(F.col("msg_id") % 5 == i, text).otherwise(raw)
    return explode_bodies(m.select("msg_id", raw.alias("raw")), "msg_id", "raw", fields=["encoding"]).select("msg_id", F.col("text").alias("body"))


@query("SELECT addr_id, 'image/png' AS kind, addr_id || '.png' AS name, 'image/png' AS detected FROM addresses")
def mime_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments whose type comes from their names, or for pictures from their first bytes, built and read again."""
    data = F.unhex(F.lit("89504E470D0A1A0A0000"))
    name = F.concat(F.col("addr_id").cast("string"), F.lit(".png"))
    a = table(spark, sf_dir, "addresses").select("addr_id", M.build_attachment(F.lit("application/octet-stream"), data, name).alias("raw"))
    out = explode_bodies(a, "addr_id", "raw", fields=["main", "sub", "params", "disposition_params"])
    return out.select("addr_id", F.concat_ws("/", "main", "sub").alias("kind"), M.detected_file_name(F.col("params"), F.col("disposition_params")).alias("name"), M.detect_content_type(F.lit("image"), F.lit("gif"), F.lit(""), F.col("data")).alias("detected"))


@query("SELECT msg_id, 'smtp; 550' AS diagnostic_code, true AS is_bounce, 'not delivered' AS notification, 0.625 AS score, '5.' || (msg_id % 7) || '.1' AS status FROM (SELECT DISTINCT msg_id FROM messages)")
def bounce_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery reports with a status part and a notification."""
    m = table(spark, sf_dir, "messages").select("msg_id").distinct()
    note = F.lit("Content-Description: Notification\r\nContent-Type: text/plain\r\n\r\nnot delivered")
    status = F.concat(F.lit("Content-Type: message/delivery-status\r\n\r\nReporting-MTA: dns; x.example\r\n\r\nFinal-Recipient: rfc822; u@x.example\r\nStatus: 5."), (F.col("msg_id") % 7).cast("string"), F.lit(".1\r\nDiagnostic-Code: smtp; 550\r\n"))
    return detect_bounces(m.select("msg_id", F.concat(F.lit("Subject: r\r\n"), M.build_multipart("report", F.col("msg_id"), note, status)).alias("raw")), "msg_id", "raw")


@query(r"SELECT DISTINCT msg_id, to_base64(from_hex(sha256(regexp_replace(body, '(\r?\n)+$', '') || chr(13) || chr(10)))) AS digest FROM messages WHERE body IS NOT NULL")
def body_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").where(F.col("body").isNotNull()).select("msg_id", M.body_hash(F.col("body")).alias("digest")).dropDuplicates()


@query(r"""SELECT DISTINCT msg_id, sha256(regexp_replace(body, '(\r?\n)+$', '') || chr(13) || chr(10)) AS simple, sha256(regexp_replace(regexp_replace(body, '[ \t\x0b\x0c]+', '', 'g'), '[\r\n]+$', '') || chr(13) || chr(10)) AS nofws,
 sha256(CASE WHEN r = '' THEN '' ELSE r || chr(13) || chr(10) END) AS relaxed FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(body, '[ \t]+', ' ', 'g'), ' (\r?\n|$)', '\1', 'g'), '(\r?\n)+$', '') AS r FROM messages WHERE body IS NOT NULL)""")
def body_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the three canonical forms of each body."""
    m = table(spark, sf_dir, "messages").where(F.col("body").isNotNull()).select("msg_id", "body").dropDuplicates()
    return m.select("msg_id", *(F.sha2(M.canonical_body(F.col("body"), form), 256).alias(form) for form in ("simple", "relaxed", "nofws")))


@query("SELECT count(DISTINCT message_id) AS n FROM messages WHERE message_id IS NOT NULL")
def thread_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is in one thread."""
    t = build_threads(table(spark, sf_dir, "messages"))
    return t.where(~F.col("is_dummy")).agg(F.count("*").alias("n"))


_THREAD_SQL = """
WITH RECURSIVE one AS (SELECT message_id AS node, min({'o': received_at, 'r': refs}) AS m FROM messages WHERE message_id IS NOT NULL GROUP BY message_id),
own AS (SELECT node, m.o AS o, list_filter(coalesce(m.r, []), lambda x: x IS NOT NULL AND x <> node) AS r FROM one),
links AS (SELECT node, r[len(r)] AS parent, 0 AS k, o, 0 AS i FROM own UNION ALL
  SELECT r[i] AS node, r[i - 1] AS parent, 1 AS k, o, i FROM (SELECT o, r, unnest(range(1, len(r) + 1)) AS i FROM own)),
best AS (SELECT l.node, arg_min(parent, {'k': k, 'o': l.o, 'i': i, 'p': parent}) FILTER (WHERE parent IS NOT NULL AND parent <> l.node) AS parent, bool_or(one.node IS NOT NULL) AS real FROM links l LEFT JOIN one ON one.node = l.node GROUP BY l.node),
climb AS (SELECT node, node AS top, parent AS at, 0 AS above, CAST(NULL AS VARCHAR) AS near FROM best WHERE real UNION ALL
  SELECT c.node, b.node, b.parent, c.above + b.real::INT, coalesce(c.near, CASE WHEN b.real THEN b.node END) FROM climb c JOIN best b ON b.node = c.at),
ends AS (SELECT c.*, b.real AS real_top FROM climb c JOIN best b ON b.node = c.top WHERE c.at IS NULL),
dummies AS (SELECT top, count(*) AS n, min(node) AS least FROM ends WHERE NOT real_top AND near IS NULL GROUP BY top),
threads AS (SELECT CASE WHEN d.n = 1 THEN d.least ELSE e.top END AS thread_id, e.node AS node_id, coalesce(e.near, CASE WHEN d.n >= 2 THEN e.top END) AS parent_id, e.above + CASE WHEN d.n >= 2 THEN 1 ELSE 0 END AS depth, false AS is_dummy
  FROM ends e LEFT JOIN dummies d ON d.top = e.top UNION ALL SELECT top, top, NULL, 0, true FROM dummies WHERE n >= 2)
"""


@query(_THREAD_SQL + "SELECT * FROM threads")
def thread_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads, parents and depths of all messages, and the dummies that remain."""
    return build_threads(table(spark, sf_dir, "messages"))


@query(_THREAD_SQL + ", below AS (SELECT parent_id AS ancestor_id, node_id, 1 AS distance FROM threads WHERE parent_id IS NOT NULL UNION ALL SELECT b.ancestor_id, t.node_id, b.distance + 1 FROM below b JOIN threads t ON t.parent_id = b.node_id) SELECT * FROM below")
def thread_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a message and one below it."""
    return descendants(materialise(build_threads(table(spark, sf_dir, "messages")), "threads"))


@query(_THREAD_SQL + "SELECT deepest, count(*) AS threads, sum(dummies) AS dummies FROM (SELECT thread_id, max(depth) AS deepest, sum(is_dummy::INT) AS dummies FROM threads GROUP BY thread_id) GROUP BY deepest")
def thread_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many threads there are of each depth, with their dummies."""
    t = build_threads(table(spark, sf_dir, "messages")).groupBy("thread_id").agg(F.max("depth").alias("deepest"), F.sum(F.col("is_dummy").cast("int")).alias("dummies"))
    return t.groupBy("deepest").agg(F.count("*").alias("threads"), F.sum("dummies").alias("dummies"))


@query("SELECT msg_id, count(*) AS copies, min(ingested_at) AS first FROM messages GROUP BY msg_id")
def messages_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that were taken in twice."""
    return table(spark, sf_dir, "messages").groupBy("msg_id").agg(F.count("*").alias("copies"), F.min("ingested_at").alias("first"))


def _small_key() -> bytes:
    """An RSA key in PEM from two fixed primes, for signatures that can be told apart but keep no secret."""
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))

    def number(x: int) -> bytes:
        raw = x.to_bytes(x.bit_length() // 8 + 1, "big")
        return b"\x02" + (bytes([len(raw)]) if len(raw) < 128 else b"\x82" + len(raw).to_bytes(2, "big")) + raw

    body = b"".join(map(number, (0, n, e, d, p, q, 1, 1, 1)))
    return b"-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(b"\x30\x82" + len(body).to_bytes(2, "big") + body) + b"-----END RSA PRIVATE KEY-----\n"


@query(r"""SELECT msg_id, 'rsa-sha256' AS algorithm, 'from : subject' AS names, to_base64(from_hex(sha256(regexp_replace(body, '(\r?\n)+$', '') || chr(13) || chr(10)))) AS digest, true AS signed, 'rsa-sha1' AS key_algorithm FROM (SELECT msg_id, min(body) AS body FROM messages WHERE body IS NOT NULL GROUP BY msg_id)""")
def messages_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body as a message of two headers, signed in both ways; the fields of the signatures, unfolded."""
    m = table(spark, sf_dir, "messages").where(F.col("body").isNotNull()).groupBy("msg_id").agg(F.min("body").alias("body"))
    text = F.concat(F.lit("From: a@b.example\r\nSubject: mail "), F.col("msg_id").cast("string"), F.lit("\r\n\r\n"), F.col("body"))
    pem = _small_key()
    flat = lambda x: F.replace(x, F.lit("\r\n "), F.lit(""))
    s = m.select("msg_id", flat(M.sign_dkim(text, pem, "sel", "b.example", 1)).alias("d"), flat(M.sign_domainkey(text, pem, "sel", "b.example")).alias("k"))
    part = lambda x, p: F.regexp_extract(x, p, 1)
    return s.select(
        "msg_id", part("d", r"a=([^;]+);").alias("algorithm"), part("d", r" h=([^;]+);").alias("names"), part("d", r"bh=([^;]+);").alias("digest"),
        (F.length(part("d", r" b=([A-Za-z0-9+/=]+)")) == 188).alias("signed"), part("k", r"a=([^;]+);").alias("key_algorithm"),
    )
