"""Messages: headers, parts, bodies, bounces, threads, building and signing."""

import email
import random
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lettermill.functions import messages as M
from lettermill.kernels import body as B
from lettermill.kernels import build as Z
from lettermill.kernels import dkim as D
from lettermill.kernels.encodedword import decode_words, encode_words
from lettermill.kernels.headers import encode_header, parametrised, parse_headers
from lettermill.kernels.scan import parse_message
from lettermill.operators.mail import detect_bounces, explode_parts
from lettermill.operators.threads import build_threads


def kinds(text):
    rows, error, _ = parse_message(text)
    return error or [(r[3], f"{r[8]}/{r[9]}") for r in rows]


def test_scan_shapes():
    inner = "Subject: in\r\nContent-Type: text/plain\r\n\r\nhello"
    text = "From: a@b.c\r\n" + Z.multipart("mixed", [Z.multipart("alternative", [Z.leaf("text/plain", "é"), Z.leaf("text/html", "<p>")], "k2"), Z.message_container(inner)], "k1")
    assert kinds(text) == [(0, "multipart/mixed"), (1, "multipart/alternative"), (2, "text/plain"), (2, "text/html"), (1, "message/rfc822"), (2, "text/plain")]
    assert kinds("no headers at all") == [(0, "text/plain")]
    assert kinds("") == [(0, "text/plain")]
    assert "boundary" in kinds("Content-Type: multipart/mixed\r\n\r\nx")
    assert "boundary" in kinds('Content-Type: multipart/mixed; boundary="b"\r\n\r\nx')
    assert parse_message('Content-Type: multipart/mixed; boundary="b"\r\n\r\nx', recover=True)[2] == "lenient"
    assert parse_message(None) == (None, None, None)
    many = 'Content-Type: multipart/mixed; boundary="b"\r\n\r\n' + "--b\r\n\r\nx\r\n" * 6000
    assert kinds(many) == "too many parts"
    # A content type in a body and a boundary nobody declared are text.
    assert kinds("Subject: x\r\n\r\nContent-Type: multipart/mixed; boundary=z\r\n--z\r\nbody") == [(0, "text/plain")]


def test_scan_is_the_standard_library():
    rng = random.Random(3)
    for n in range(30):
        msg = MIMEMultipart("mixed")
        msg["Subject"] = f"s {n}"
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.4:
                sub = MIMEMultipart("alternative")
                sub.attach(MIMEText("plain é", "plain", "utf-8"))
                sub.attach(MIMEText("<b>", "html"))
                msg.attach(sub)
            else:
                msg.attach(MIMEText("x" * rng.randint(0, 2000), "plain"))
        text = msg.as_string()
        want = [(p.get_content_type(), p.get_payload(decode=True)) for p in email.message_from_string(text).walk()]
        rows, _, _ = parse_message(text)
        got = [(f"{r[8]}/{r[9]}", None if r[8] == "multipart" else B.decode_transfer(r[13], text[r[7] : r[6]])) for r in rows]
        assert got == want


def test_headers():
    headers, at = parse_headers("From x y\nSubject: =?utf-8?B?w7w=?=\r\n =?utf-8?Q?_x?=\r\nX-A: 1\r\nx-a: 2\r\nContent-Type: TEXT/Plain; charset=\"utf-8\"\r\n\r\nbody")
    assert [(h[0], h[2]) for h in headers] == [("Subject", "ü x"), ("X-A", "1"), ("X-A", "2"), ("Content-Type", "text/plain")]
    assert headers[-1][3] == {"charset": "utf-8"}
    assert parse_headers("A: b\nnot a header\nC: d")[0] == [("A", "b", "b", {})]
    assert parametrised("text/plain; a*0*=us-ascii'en'x%20; a*1=\"y z\"; name==?utf-8?Q?=C3=BC?=") == ("text/plain", {"a": "x y z", "name": "ü"})
    assert decode_words("=?utf-8?Q?=C3?= =?utf-8?Q?=BC?=") == "ü"
    assert decode_words("=?nope?Q?abc?=") == "abc"
    assert decode_words("=?utf-8?X?abc?=") == "=?utf-8?X?abc?="
    assert decode_words(None) is None


@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc")), min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_words_round_trip(s):
    if "=?" not in s and s == " ".join(s.split()):
        assert decode_words(encode_words(s)) == s
        assert decode_words(encode_header("X-Text", s)).replace("\n", "") == s or len(s) > 60


@given(st.text(max_size=400), st.sampled_from(["7bit", "quoted-printable", "base64"]))
@settings(max_examples=200, deadline=None)
def test_bodies_round_trip(s, how):
    s = s.encode("utf-8", "ignore").decode()
    charset, encoding, text = B.encode_body(s, "text", "utf-8", how)
    back, _ = B.decode_body(text, encoding, "text", "plain", charset)
    assert back.replace("\r\n", "\n").rstrip("\n") == s.replace("\r\n", "\n").rstrip("\n") or "\r" in s


def test_body_rules():
    assert B.decode_base64(b"aGVs!bG8") == b"hello" and B.decode_base64(b"aGVsbG8x2") == b"hello1"
    assert B.stronger("7bit", "8bit") == "8bit" and B.stronger("junk", "7bit") == "7bit"
    assert all(len(x) <= 76 for x in B.fix_leading_dots("." + "a" * 75).split("\n"))
    assert B.decode_body("a\xa0b", "7bit", "text", "html", "utf-8")[0] == "a&nbsp;b"


def test_header_columns(spark):
    raw = "Subject: Re: Fwd: hi\r\nReceived: one\r\nReceived: two\r\nMessage-Id: <abcdef@x.io>\r\nReferences: <a@b.cd> <junk>\r\n\r\nbody: x"
    df = spark.createDataFrame([(raw,), ("",), (None,)], "raw string").withColumn("h", M.message_headers(F.col("raw")))
    r = df.select(
        M.header_get(F.col("h"), "received").alias("last"), F.size(M.header_all(F.col("h"), "RECEIVED")).alias("n"), M.clean_subject(M.header_get(F.col("h"), "Subject")).alias("subject"),
        M.message_id(M.header_get(F.col("h"), "Message-ID")).alias("id"), M.references(M.header_get(F.col("h"), "References"), F.lit(None).cast("string")).alias("refs"),
        F.size(M.header_delete(F.col("h"), "received", "Subject")).alias("left"), M.headers_to_text(M.header_set(F.col("h"), "Received", F.lit("x"))).alias("text"),
    ).first()
    assert (r.last, r.n, r.subject, r.id, r.refs, r.left) == ("two", 2, "hi", "abcdef@x.io", ["a@b.cd"], 2)
    assert r.text.endswith("Received: x\r\n") and r.text.count("Received") == 1


def test_edits_leave_the_rest(spark):
    from lettermill.operators.mail import apply_edits, part_edits

    raw = "Subject: a\r\n" + Z.multipart("mixed", [Z.leaf("text/plain", "one"), Z.leaf("text/plain", "two")], "k")
    df = spark.createDataFrame([(1, raw), (2, raw), (3, None)], "k int, raw string")
    parts = explode_parts(df, "k", "raw").where("k = 1").withColumn("b", F.when(F.col("part_id") == 2, F.lit("new body")))
    got = {r.k: r.text for r in apply_edits(df, "k", "raw", part_edits(parts, "k", body="b")).collect()}
    assert got == {1: raw.replace("two", "new body"), 2: raw, 3: None}


def test_bounces(spark):
    status = "Content-Type: message/delivery-status\r\n\r\nReporting-MTA: dns; x\r\nArrival-Date: y\r\n\r\nFinal-Recipient: rfc822; u@x\r\nStatus: 5.1.1\r\nDiagnostic-Code: smtp; 550\r\n\r\nStatus: 4.0.0\r\n"
    note = "Content-Description: Notification\r\nContent-Type: text/plain\r\n\r\nsorry"
    text = "Received: a\r\n" + Z.multipart("report", [note, status], "k")
    df = spark.createDataFrame([(1, text), (2, "Subject: x\r\n\r\nhello"), (3, None)], "k int, raw string")
    got = {r.k: r for r in detect_bounces(df, "k", "raw").collect()}
    assert got[1].score == 8 / 8 and got[1].status == "5.1.1" and got[1].diagnostic_code == "smtp; 550" and got[1].notification == "sorry" and got[1].is_bounce
    assert got[2].score == 0.0 and not got[2].is_bounce and 3 not in got


def test_parts_of_no_rows(spark):
    assert explode_parts(spark.createDataFrame([], "k int, raw string"), "k", "raw").count() == 0


def threads(spark, rows):
    df = spark.createDataFrame(rows, "message_id string, refs array<string>, received_at int")
    return {r.node_id: (r.thread_id, r.parent_id, r.depth, r.is_dummy) for r in build_threads(df).collect()}


def test_threads(spark):
    got = threads(spark, [("a", None, 1), ("b", ["a"], 2), ("c", ["a", "b"], 3), ("x", ["gone", "lost"], 4), ("y", ["gone"], 5), ("z", ["alone"], 6), ("a", ["b"], 9), (None, ["a"], 7), ("l", ["m"], 1), ("m", ["l"], 2), ("s", ["s"], 3)])
    assert got["c"] == ("a", "b", 2, False) and got["b"] == ("a", "a", 1, False) and got["a"][1] is None
    assert got["x"] == ("gone", "gone", 1, False) and got["y"] == ("gone", "gone", 1, False) and got["gone"] == ("gone", None, 0, True)
    assert got["z"] == ("z", None, 0, False) and "alone" not in got and "lost" not in got
    assert {got["l"][0], got["m"][0]} == {"l"} and got["s"][1] is None
    assert threads(spark, []) == {}


def test_long_thread(spark):
    got = threads(spark, [(f"n{i:03d}", [f"n{i - 1:03d}"] if i else None, i) for i in range(60)])
    assert got["n059"][0] == "n000" and got["n059"][2] == 59


def test_signatures():
    assert D.canonical_body(b"a  b \r\n\r\n\r\n", "relaxed") == b"a b\r\n" and D.canonical_body(b"", "relaxed") == b"" and D.canonical_body(b"", "simple") == b"\r\n"
    assert D.canonical_header(b"SubJect", b" a\r\n  b \r\n", "relaxed") == b"subject:a b\r\n" and D.canonical_header(b"A", b" b\r\n c\r\n", "nofws") == b"A:bc\r\n"
    assert all(len(x) <= 72 for x in D.fold(b"x" * 300 + b" y z").split(b"\r\n"))
    # A small key, made here: 512 bits from fixed primes.
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))

    def num(x):
        raw = x.to_bytes(x.bit_length() // 8 + 1, "big")
        size = bytes([len(raw)]) if len(raw) < 128 else bytes([0x82]) + len(raw).to_bytes(2, "big")
        return b"\x02" + size + raw

    import base64

    body = b"".join(map(num, (0, n, e, d, p, q, 1, 1, 1)))
    pem = b"-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(b"\x30\x82" + len(body).to_bytes(2, "big") + body) + b"-----END RSA PRIVATE KEY-----\n"
    assert D.private_key(pem) == (n, d)
    sig = D.rsa_sign(pem, b"data")
    import hashlib

    assert pow(int.from_bytes(sig, "big"), e, n).to_bytes(len(sig), "big").endswith(hashlib.sha256(b"data").digest())
    line = D.dkim_signature(b"From: a\r\nSubject: b\r\n\r\nbody\r\n", pem, "s", "x.io", now=1)
    assert line.startswith(b"DKIM-Signature: v=1; a=rsa-sha256") and b"t=1" in line


def test_signatures_take_little_time(monkeypatch):
    """A signature costs less than one power of the full width of its key, and the same without libcrypto, with primes that do
    not fit, and by the plain power; bodies with many line ends are read once."""
    import hashlib
    import time

    from lettermill.plans.mail import _small_key

    def seconds(f):
        times = []
        for _ in range(7):
            began = time.perf_counter()
            f()
            times.append(time.perf_counter() - began)
        return min(times)

    pem = _small_key()
    n, d = D.private_key(pem)
    sign = lambda: [D.rsa_sign(pem, b"data %d" % i) for i in range(5)]
    size, blocks = (n.bit_length() + 7) // 8, [D._DIGEST["sha256"] + hashlib.sha256(b"data %d" % i).digest() for i in range(5)]
    want = [pow(int.from_bytes(b"\x01".ljust(size - len(b) - 2, b"\xff") + b"\x00" + b, "big"), d, n).to_bytes(size, "big") for b in blocks]
    assert sign() == want
    assert seconds(sign) < 0.8 * seconds(lambda: [pow(n // 3 + i, d, n) for i in range(5)])
    fields = D._key(pem)
    monkeypatch.setattr(D, "_libcrypto", lambda: None)
    for changed in (fields, fields[:4] + [fields[4] + 2] + fields[5:], fields[:4] + [n, 1] + fields[6:]):
        D._signer.cache_clear()
        monkeypatch.setattr(D, "_key", lambda _, changed=changed: changed)
        assert sign() == want
    D._signer.cache_clear()

    body = b"a" + b"\r\n" * 20_000 + b"b\r\r\n\n"
    assert seconds(lambda: [D.canonical_body(body, how) for how in ("simple", "nofws", "relaxed")]) < 0.5
    assert D.canonical_body(body, "simple") == body[:-3] + b"\r\n" and D.canonical_body(body, "nofws") == body[:-4] + b"\r\n"
    assert D.split_message(b"A: b\r\n c\r\n\r\n" + body) == ([(b"A", b" b\r\n c\r\n")], body)


def test_many_loops(spark):
    """A thousand loops of two to four, each cut at its least node, with a tail below each."""
    rows, order = [], 0
    for n in range(1000):
        size = 2 + n % 3
        for i in range(size):
            rows.append((f"l{n:04d}{i}", [f"l{n:04d}{(i + 1) % size}"], order := order + 1))
        rows.append((f"t{n:04d}", [f"l{n:04d}1"], order := order + 1))
    got = threads(spark, rows)
    for n in range(1000):
        size = 2 + n % 3
        root = f"l{n:04d}0"
        assert got[root] == (root, None, 0, False)
        assert got[f"l{n:04d}1"][:3] == (root, root if size == 2 else f"l{n:04d}2", size - 1) and got[f"t{n:04d}"][:3] == (root, f"l{n:04d}1", size)


def test_descendants(spark):
    from lettermill.operators.threads import descendants, root_set

    df = spark.createDataFrame([("a", None, 1), ("b", ["a"], 2), ("c", ["a", "b"], 3), ("d", ["a"], 4), ("z", None, 5)], "message_id string, refs array<string>, received_at int")
    t = build_threads(df)
    assert {tuple(r) for r in descendants(t).select("ancestor_id", "node_id", "distance").collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}
    assert [r.node_id for r in root_set(t).collect()] == ["a", "z"]


def test_parts_are_appended(spark):
    from lettermill.operators.mail import append_parts

    raw = "Subject: a\r\n" + Z.multipart("mixed", [Z.leaf("text/plain", "one")], "k")
    df = spark.createDataFrame([(1, raw), (2, "Subject: x\r\n\r\nplain"), (3, None)], "k int, raw string")
    inner = F.lit("Subject: in\r\n\r\nhello")
    got = append_parts(df, "k", "raw", M.build_message_container(inner), F.lit("Content-Type: text/html\r\n\r\n<p>"))
    kinds = [(f"{r.main}/{r.sub}", r.rel) for r in explode_parts(got.where("k = 1"), "k", "text").collect()]
    assert kinds == [("multipart/mixed", "root"), ("text/plain", "part"), ("message/rfc822", "part"), ("text/plain", "enclosed"), ("text/html", "part")]
    assert {r.k: r.text for r in got.where("k > 1").collect()} == {2: "Subject: x\r\n\r\nplain", 3: None}


def test_bodies_in_one_pass(spark):
    from lettermill.operators.mail import explode_bodies

    raw = Z.multipart("mixed", [Z.leaf("text/plain", "é"), Z.leaf("image/png", b"\x89PNG\r\n\x1a\n"), Z.message_container("Subject: in\r\n\r\nhello")], "k")
    df = spark.createDataFrame([(1, raw), (2, None), (3, "Content-Type: multipart/mixed\r\n\r\nx")], "k int, raw string")
    got = [(r.part_id, r.text, r.data and bytes(r.data)) for r in explode_bodies(df, "k", "raw").orderBy("part_id").collect()]
    assert got == [(0, None, None), (1, "é", None), (2, None, b"\x89PNG\r\n\x1a\n"), (3, None, None), (4, "hello", None)] or [g[1] and g[1].strip() for g in got] == [None, "é", None, None, "hello"]
    assert explode_parts(df.where("k = 1"), "k", "raw", skip_enclosed=True).count() == 4 and explode_parts(df, "k", "raw", with_self=False).count() == 4
    assert [r.size for r in explode_parts(df.where("k = 1"), "k", "raw", fields=["size"]).collect()][0] == len(raw.encode())
    assert explode_bodies(df.limit(0), "k", "raw").count() == 0
    both = spark.createDataFrame([(1, bytearray(raw.encode()))], "k int, raw binary")
    assert explode_bodies(both, "k", "raw").where("part_id = 1").first().text == "é"
