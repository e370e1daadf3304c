"""Addresses against tables of the grammar and against a reader written another way."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lettermill.functions import addresses as A
from lettermill.kernels import address as K
from lettermill.operators.addresses import lookup_exchangers, members, reached, suggest_domains, validate_addresses, validate_lists

GOOD = [
    ("bob@example.com", "", "bob", "example.com"), ("Bob <bob@Example.COM>", "Bob", "bob", "example.com"), ('"Bob, Jr" <bob@x.io>', "Bob, Jr", "bob", "x.io"),
    ('"a b"@x.io', "", '"a b"', "x.io"), ("a@[127.0.0.1]", "", "a", "[127.0.0.1]"), ("  Bob   B.  <b@x.io>  ", "Bob B.", "b", "x.io"), ("(c) b@x.io (d)", "", "b", "x.io"),
    ("=?utf-8?Q?M=C3=BC?= <m@x.io>", "Mü", "m", "x.io"), ("a@b", "", "a", "b"), ("ü@x.io", "", "ü", "x.io"), ('"\\"q\\"" <q@x.io>', '"q"', "q", "x.io"),
]
BAD = ["", " ", "bob", "@x.io", "bob@", "a@@b.c", "a b@x.io c", ".a@x.io", "a.@x.io", "a..b@x.io", "<a@x.io", "a@x.io>", "a@x.io, b@x.io", 'a"b@x.io', "group: a@b.c;", "a@xn--broken-ÿ.com", "x" * 1020 + "@x.io"]


@pytest.mark.parametrize("text,name,local,host", GOOD)
def test_good(text, name, local, host):
    assert K.parse(text, strict=True)[1:4] == (name, local, host)


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert K.parse(text, strict=True) is None


def test_relaxed_takes_the_last_word():
    assert K.parse("call me a@b.io")[1:4] == ("call me", "a", "b.io")
    assert K.parse("call me a@b.io ")[4] == "a@b.io"
    assert K.parse("a@b.io call", strict=False) is None


@pytest.mark.parametrize("delimiter", [",", ";", " , ", ",,", ";,", " ; ; "])
@pytest.mark.parametrize("tail", ["", ",", " ;"])
def test_lists(delimiter, tail):
    items = ["a@x.io", "Bob <b@x.io>", '"c, d" <c@x.io>', "http://x.io/p"]
    good, bad, error = K.parse_discrete_list(delimiter.join(items) + tail)
    assert [g[4] for g in good] == ["a@x.io", "b@x.io", "c@x.io", "http://x.io/p"] and not bad and not error


def test_lists_are_all_or_nothing():
    assert K.parse_discrete_list("a@x.io, junk") == ([], ["a@x.io, junk"], None)
    assert K.parse_discrete_list(",a@x.io")[0] == []
    assert K.parse_discrete_list(None) == ([], [], None)
    good, bad, _ = K.parse_list(["a@x.io", "junk", None])
    assert len(good) == 1 and bad == ["junk"]
    assert K.parse_list(["a@x.io"] * 1025) == ([], [], "too many items")


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_quote_and_unquote(s):
    assert K.smart_unquote(K.smart_quote(s)) == s or '"' in s or "\\" in s
    assert K.smart_unquote('"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"') == s


def test_long_text_ends():
    assert K.parse("a" * 200_000) is None
    assert K.parse_discrete_list(", ".join(["a@x.io"] * 20_000))[2] is None


def test_column_is_the_kernel(spark):
    texts = [g[0] for g in GOOD] + BAD + [None, "Foo Bar foo@bar.com", "http://A.io:80/x?y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    for strict in (True, False):
        got = {r.i: r.a for r in df.select("i", A.parse_address(F.col("t"), strict=strict).alias("a")).collect()}
        for i, t in enumerate(texts):
            want = K.parse(t, strict=strict)
            assert (tuple(got[i]) if got[i] else None) == want, t


def test_urls_and_lists_as_columns(spark):
    df = spark.createDataFrame([("http://Exa.mple:8080/a/b?c",), ("http:///x",), ("ftp://x",), (None,)], "u string")
    rows = df.select(A.url_hostname(F.col("u")), A.url_port(F.col("u")), A.url_scheme(F.col("u")), A.url_path(F.col("u"))).collect()
    assert tuple(rows[0]) == ("exa.mple", 8080, "http", "/a/b") and rows[2][0] is None and rows[3][0] is None
    one = spark.createDataFrame([("a@x.io, A@x.io; b@y.io",), (None,)], "t string").withColumn("l", A.parse_address_list(F.col("t"))["parsed"])
    r = one.select(
        F.size(A.list_hostnames(F.col("l"))).alias("hosts"), A.list_contains(F.col("l"), F.get(F.col("l"), F.lit(1))).alias("has"), A.list_equals(F.col("l"), F.reverse("l")).alias("same"),
        F.size(A.list_remove(F.col("l"), F.get(F.col("l"), F.lit(0)))).alias("left"), A.list_full_spec(F.col("l")).alias("spec"),
    ).first()
    assert (r.hosts, r.has, r.same, r.left, r.spec) == (2, True, True, 2, "a@x.io, A@x.io, b@y.io")


def test_validation_and_members(spark):
    df = spark.createDataFrame([(1, "a@x.io"), (2, None), (3, "plain"), (4, "a b@x.io"), (5, "a@x.zz"), (6, "ab@gm.io"), (7, "abcdef@gm.io")], "k int, address string")
    mx = spark.createDataFrame([("x.io", "mx.x.io"), ("gm.io", "gmail-smtp-in.l.google.com")], "domain string, mx_host string")
    suffixes = spark.createDataFrame([("io",)], "suffix string")
    got = {r.k: r.reject_reason for r in validate_addresses(df, "address", suffixes, mx).collect()}
    assert got == {1: None, 2: "empty", 3: "no @", 4: "syntax", 5: "suffix", 6: "local part", 7: None}
    other = spark.createDataFrame([("A@X.io",)], "o string")
    assert [r.k for r in members(df, F.lower("address"), other, F.lower("o")).collect()] == [1]


def test_suggestions(spark):
    df = spark.createDataFrame([("a@gmial.com",), ("b@hotmial.com",), ("c@gmail.com",), ("d@yahooo.com",), (None,)], "t string")
    got = {r.t: r.suggestion for r in suggest_domains(df, "t").collect()}
    assert got == {"a@gmial.com": "a@gmail.com", "b@hotmial.com": "b@hotmail.com", "c@gmail.com": None, "d@yahooo.com": "d@yahoo.com", None: None}


def test_providers(spark):
    cases = [("gmail", "abc.def", True), ("gmail", "abc", False), ("gmail", "a..bcdef", False), ("gmail", "abcdef+tag", True), ("aol", "ab", False), ("aol", "abc_", False), ("aol", "a.b_c", True), ("icloud", "abc+", False), ("hotmail", "a..b", True), ("hotmail", "a.", False), ("google", "a'b", True), ("yahoo", "ab-cd", True), ("yahoo", "a-b-c", False), ("yahoo", "a.b.c", False), ("other", "x", None)]
    df = spark.createDataFrame([(p, m, "x.example", w) for p, m, w in cases], "p string, m string, h string, w boolean")
    for r in df.withColumn("ok", A.provider_valid(F.col("p"), F.col("m"), F.col("h"))).collect():
        assert r.ok == r.w, r


def test_suggestions_for_the_whole_address_book(spark):
    import difflib

    from lettermill.operators.addresses import EXACT_FIXES
    from lettermill.plans.mail import domain_suggest

    sf = "/root/testdata/sf0.001"
    common = [r[0] for r in spark.read.parquet(f"{sf}/common_hosts.parquet").select("hostname").collect()]
    want = {}
    for k, text in spark.read.parquet(f"{sf}/addresses.parquet").select("addr_id", "address").collect():
        better = None
        if text is not None and "@" in text:
            d = text.split("@")[-1]
            close = EXACT_FIXES.get(d) or next(iter(difflib.get_close_matches(d, common, 1, 0.77)), d)
            better = f"{text.split('@')[0]}@{close}" if close != d else None
        want[k] = better
    assert {r.addr_id: r.suggestion for r in domain_suggest(spark, sf).collect()} == want and len(want) > 100


def _book(spark, at, rows):
    spark.createDataFrame(rows, "addr_id bigint, addr_type string, msg_id bigint, address string").write.parquet(f"{at}/addresses.parquet")
    return str(at)


def test_lists_above_the_limit_are_cut(spark, tmp_path):
    """Items that fall into one list by their hash are all counted."""
    from lettermill.plans.mail import addr_list_partial

    sf = _book(spark, tmp_path, [(1, "email", None, f"a{i}@b.test" if i % 5 else f"a{i} at b") for i in range(2500)])
    assert [tuple(r) for r in addr_list_partial(spark, sf).collect()] == [(-1, 2000, 500)]


def test_hard_addresses_are_counted(spark, tmp_path):
    """Blanks, brackets and ACE hosts, against the kernel row by row."""
    from lettermill.kernels.address import parse
    from lettermill.plans.mail import addr_is_strict, addr_list_partial

    texts = ["a@b.test", "a@\u00a0b.test", "a@b.test>", "a@[1.2.3.4]", "A <a@b.test>", '"x y"@b.test', "a@xn--bcher-kva.test", "(c) a@b.test", "\u3000a@b.test", "plain", None]
    sf = _book(spark, tmp_path, [(i, "email", i % 3, t) for i, t in enumerate(texts)])
    strict = {r.addr_id: r.strict_ok for r in addr_is_strict(spark, sf).collect()}
    assert strict == {i: t is not None and parse(t, strict=True, addr_spec_only=True) is not None for i, t in enumerate(texts)}
    want = {k: [0, 0] for k in range(3)}
    for i, t in enumerate(texts):
        if t is not None:
            want[i % 3][0 if parse(t, strict=True) else 1] += 1
    assert {r.msg_id: [r.good, r.bad] for r in addr_list_partial(spark, sf).collect()} == want


def test_suggestions_from_a_table(spark):
    """Any table of common domains; slips go to its entries."""
    common = spark.createDataFrame([("ulfmola.example",), ("zanbexa.test",), (None,)], "d string")
    df = spark.createDataFrame([("a@ulfmolla.example",), ("b@zanbexa.test",), ("c@gmail",)], "t string")
    assert {r.t: r.suggestion for r in suggest_domains(df, "t", common).collect()} == {"a@ulfmolla.example": "a@ulfmola.example", "b@zanbexa.test": None, "c@gmail": "c@gmail.com"}


def test_exchangers(spark):
    """What is known and fresh is not asked for; literals are their own hosts; a failed look-up is tried once more."""
    import datetime as dt

    from lettermill.kernels.exchangers import find_exchanger

    asked = []
    assert find_exchanger("x.io", lambda d: asked.append(d) or [], lambda hs: hs[0]) is None and asked == ["x.io.", "x.io."]
    assert find_exchanger("[1.2.3.4]", lambda d: 1 / 0, lambda hs: hs[0]) == "1.2.3.4"
    assert find_exchanger("x.io", lambda d: ["a", "b"], lambda hs: None) is None
    now = dt.datetime(2025, 1, 10)
    known = spark.createDataFrame([("a.io", "old.a", dt.datetime(2025, 1, 1)), ("B.io", "mx.b", dt.datetime(2025, 1, 9)), ("c.io", "False", dt.datetime(2025, 1, 9))], "domain string, mx_host string, fetched_at timestamp")
    domains = spark.createDataFrame([("a.io",), ("A.io",), ("b.io",), ("c.io",), ("d.io",), (None,), ("",), ("[1.2.3.4]",)], "domain string")
    got = lookup_exchangers(domains, now, known, lambda d: ["mx." + d] if d[0] != "d" else [], lambda hs: hs[0])
    assert {r.domain: r.mx_host for r in got.collect()} == {"a.io": "mx.a.io.", "b.io": "mx.b", "c.io": None, "d.io": None, "[1.2.3.4]": "1.2.3.4"}
    assert {r.domain for r in reached(got).collect()} == {"a.io", "b.io", "[1.2.3.4]"}
    assert lookup_exchangers(domains.limit(0), now).count() == 0


def test_lists_are_validated(spark):
    df = spark.createDataFrame([(1, "a@x.io, b@none.io; c@x.io"), (2, "no list"), (3, None), (4, ""), (1, "z@x.io")], "k int, t string")
    mx = spark.createDataFrame([("x.io", "mx.x.io")], "domain string, mx_host string")
    got = {r.k: (r.valid, r.rejected) for r in validate_lists(df, "k", "t", exchangers=mx).collect()}
    assert got == {1: (["a@x.io", "c@x.io"], ["b@none.io"]), 2: ([], ["no list"]), 3: ([], []), 4: ([], [])}
    assert validate_lists(df.limit(0), "k", "t").count() == 0
