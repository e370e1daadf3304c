"""Operators on tables of addresses."""

from __future__ import annotations

import datetime as dt
import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import addresses as A
from lettermill.kernels.exchangers import connect_to_exchanger, find_exchanger, look_up_domain

# Domains that a bare word stands for.
EXACT_FIXES = {
    "yahoo": "yahoo.com",
    "gmail": "gmail.com",
    "hotmail": "hotmail.com",
    "live": "live.com",
    "outlook": "outlook.com",
    "msn": "msn.com",
    "googlemail": "googlemail.com",
    "aol": "aol.com",
    "aim": "aim.com",
    "icloud": "icloud.com",
    "me": "me.com",
    "mac": "mac.com",
    "facebook": "facebook.com",
    "comcast": "comcast.net",
    "sbcglobal": "sbcglobal.net",
    "bellsouth": "bellsouth.net",
    "verizon": "verizon.net",
    "earthlink": "earthlink.net",
    "cox": "cox.net",
    "charter": "charter.net",
    "shaw": "shaw.ca",
    "bell": "bell.net",
}
#: Domains that slips are compared with where the caller names no table of common ones.
COMMON_DOMAINS = sorted(set(EXACT_FIXES.values()))
MOST_COMMON = 10_000


def explode_addresses(df: DataFrame, text: str, out: str = "address", position: str = "pos") -> DataFrame:
    """One row for each parsed address of a delimited text, with its position; other columns stay. Null and unparsable texts give one row with a null address."""
    return df.withColumn("_list", A.parse_address_list(F.col(text))).select(*df.columns, F.posexplode_outer("_list.parsed").alias(position, out))


def _size_checked(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast if it has at most `most` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def validate_addresses(
    df: DataFrame, text: str, suffixes: DataFrame | None = None, exchangers: DataFrame | None = None, reject: str = "reject_reason"
) -> DataFrame:
    """The rows of `df` with `_address` (struct) and a reason for rejection, null where the address is valid.

    In order, the cheapest first: no text, no `@`, not an address, unknown suffix (with a table `suffix`), no mail
    exchanger, and a local part that breaks its provider's rules (with a table `domain, mx_host`). The exchanger table
    is joined by host; it takes the place of lookups.
    """
    col = F.col(text)
    out = df.withColumn("_address", A.parse_address(col, strict=True, addr_spec_only=True))
    host = F.col("_address.hostname")
    reason = F.when(col.isNull() | (col == ""), "empty").when(~col.contains("@"), "no @").when(F.col("_address").isNull(), "syntax")
    if suffixes is not None:
        known = suffixes.select(F.lower("suffix").alias("_suffix"), F.lit(True).alias("_known")).distinct()
        out = out.withColumn("_suffix", F.element_at(F.split(host, r"\."), -1)).join(_size_checked(known), "_suffix", "left")
        reason = reason.when(F.col("_known").isNull() & ~host.startswith("["), "suffix")
    if exchangers is not None:
        hosts = exchangers.select(F.lower("domain").alias("_domain"), F.col("mx_host").alias("_mx")).dropDuplicates(["_domain"])
        out = out.withColumn("_domain", host).join(hosts, "_domain", "left")
        provider = A.provider_of(F.col("_mx"))
        reason = reason.when(F.col("_mx").isNull() & ~host.startswith("["), "exchanger").when(~F.coalesce(A.provider_valid(provider, F.col("_address.mailbox"), host), F.lit(True)), "local part")
    return out.withColumn(reject, reason).select(*df.columns, "_address", reject)


def validate_lists(df: DataFrame, key: str, text: str, suffixes: DataFrame | None = None, exchangers: DataFrame | None = None) -> DataFrame:
    """key, `valid` and `rejected` (arrays of addresses as text, in their order) of each delimited text.

    A text that is no list is rejected whole; an address of a list is rejected for any of the reasons of `validate_addresses`.
    Null and empty texts, and lists without any item, give two empty arrays; of rows with one key one counts. URLs have
    no exchanger and are rejected by a table of these. Parsing cuts a list at its limit, so no key gathers more.
    """
    once = df.groupBy(key).agg(F.min(text).alias("_text")).withColumn("_list", A.parse_address_list(F.col("_text")))
    item = F.explode(F.concat(
        F.transform(F.coalesce("_list.parsed", F.array().cast(_parsed_type(once))), lambda a, i: F.struct(i.alias("pos"), a["address"].alias("item"), F.lit(True).alias("parsed"))),
        F.transform(F.coalesce("_list.unparsed", F.array().cast("array<string>")), lambda u, i: F.struct((i + 1_000_000).alias("pos"), u.alias("item"), F.lit(False).alias("parsed"))),
    ))
    items = once.select(key, item.alias("_i")).select(key, "_i.*")
    checked = validate_addresses(items, "item", suffixes, exchangers)
    good = F.col("parsed") & F.col("reject_reason").isNull()
    gather = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "item")))), lambda x: x["item"])
    lists = checked.groupBy(key).agg(gather(good).alias("valid"), gather(~good).alias("rejected"))
    none = F.array().cast("array<string>")
    return once.select(key).join(lists, key, "left").select(key, F.coalesce("valid", none).alias("valid"), F.coalesce("rejected", none).alias("rejected"))


def _parsed_type(df: DataFrame) -> str:
    return df.select("_list.parsed").schema[0].dataType.simpleString()


def suggest_domains(df: DataFrame, text: str, common: list[str] | DataFrame | None = None, cutoff: float = 0.77, out: str = "suggestion") -> DataFrame:
    """The rows of `df` with a better spelling of the address, null where none is needed.

    The local part is what stands before the first `@`, the domain what stands after the last. Each distinct domain is
    looked at once: first in the table of exact fixes, then by the ratio of matching blocks with the common domains: a
    list, or a table with the domains in its first column, of at most MOST_COMMON entries. Of equal ratios the larger
    string holds. Null and empty texts, and texts without `@`, have no suggestion.
    """
    words = COMMON_DOMAINS if common is None else common
    if isinstance(words, DataFrame):
        words = [r[0] for r in words.select(words.columns[0]).where(F.col(words.columns[0]).isNotNull()).distinct().limit(MOST_COMMON + 1).collect()]
    if len(words) > MOST_COMMON:
        raise ValueError("the list of common domains is too long to be sent to every executor")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [EXACT_FIXES.get(d) or next(iter(difflib.get_close_matches(d, words, 1, cutoff)), d) for d in batch["_domain"]]
            yield pd.DataFrame({"_domain": batch["_domain"], "_better": found})

    pieces = F.split(F.col(text), "@", -1)
    keyed = df.withColumn("_domain", F.when(F.size(pieces) >= 2, F.element_at(pieces, -1))).withColumn("_local", pieces[0])
    fixes = keyed.select("_domain").where(F.col("_domain").isNotNull()).distinct().mapInPandas(best, "_domain string, _better string").where(F.col("_domain") != F.col("_better"))
    return keyed.join(fixes, "_domain", "left").withColumn(out, F.when(F.col("_better").isNotNull(), F.concat("_local", F.lit("@"), "_better"))).select(*df.columns, out)


#: Seconds that a known exchanger holds.
KEPT_SECONDS = 604_800


def lookup_exchangers(
    domains: DataFrame, now: dt.datetime, known: DataFrame | None = None, look_up: Callable[[str], list[str]] = look_up_domain,
    connect: Callable[[list[str]], str | None] = connect_to_exchanger, kept: int = KEPT_SECONDS,
) -> DataFrame:
    """`domain`, `mx_host`, `fetched_at` of each distinct domain in the first column of `domains`; `mx_host` is null where none was reached.

    A domain that is in `known` (the same three columns) and was fetched less than `kept` seconds before `now` is not
    looked up again; a known host `False` says that it has none. All others are looked up once each. Null and empty
    domains give no row. Keep `reached(...)` of the result as the next `known`: failures are tried again next time.
    """
    wanted = domains.select(F.lower(domains.columns[0]).alias("domain")).where(F.col("domain") != "").distinct()
    stamp = F.lit(now).cast("timestamp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"domain": batch["domain"], "mx_host": [find_exchanger(d, look_up, connect) for d in batch["domain"]]})

    if known is None:
        return wanted.mapInPandas(run, "domain string, mx_host string").withColumn("fetched_at", stamp)
    fresh = known.where(F.col("fetched_at") > stamp - F.make_dt_interval(secs=F.lit(kept))).groupBy(F.lower("domain").alias("domain")).agg(F.max(F.struct("fetched_at", "mx_host")).alias("k"))
    there = wanted.join(fresh, "domain").select("domain", F.when(F.col("k.mx_host") != "False", F.col("k.mx_host")).alias("mx_host"), F.col("k.fetched_at").alias("fetched_at"))
    return there.unionByName(wanted.join(fresh, "domain", "left_anti").mapInPandas(run, "domain string, mx_host string").withColumn("fetched_at", stamp))


def reached(exchangers: DataFrame) -> DataFrame:
    """What is worth keeping of `lookup_exchangers`: domains whose exchanger was reached."""
    return exchangers.where(F.col("mx_host").isNotNull())


def members(df: DataFrame, key: Column, other: DataFrame, other_key: Column, inside: bool = True) -> DataFrame:
    """Rows of `df` whose address is (or is not) in `other`: a left semi or anti join on the key of equality."""
    keys = other.select(other_key.alias("_k")).distinct()
    return df.withColumn("_k", key).join(keys, "_k", "left_semi" if inside else "left_anti").drop("_k")
