"""The core's operators for training data: true cases, nulls, empty tables, repeats, long texts and clashing names."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from lettermill.operators.nested_records import MAIL_ALIKE, Edge, SchemaGraph, dumps, flatten_records, header_table, infer_graph, loads, observed, part_table, readable, unify
from lettermill.operators.nested_records import shred as shred_tables
from lettermill.operators.packed_values import explode_packed, packed_values
from lettermill.operators.timestamps import components, days_from_civil, normalise_timestamps

PACKED = [
    ('"Fenwick, Søren" <s@x.test>, j@x.test', ["s@x.test", "j@x.test"]),
    ("Orlund, Tavik <t@x.test>;n@x.test;", ["t@x.test", "n@x.test"]),
    ("'Verbury; Oskar' <v@x.test>, M@X.TEST", ["v@x.test", "m@x.test"]),
    ('"Pavel \\"Pip, Jr\\" M" <p@x.test>;https://h.test/in/a', ["p@x.test", "https://h.test/in/a"]),
    ('"a@x.test, b@x.test; C@x.test"', ["a@x.test", "b@x.test", "c@x.test"]),
    ("f@x.test (Felix, office; \"x\"), g@x.test", ["f@x.test", "g@x.test"]),
    ("Team Osterby: a@x.test, b@x.test;", ["a@x.test", "b@x.test"]),
    ('Mira <"mira z"@x.test> | list@h <c@x.test>', ['"mira z"@x.test', "c@x.test"]),
    ("undisclosed-recipients:;", []), ("", []), ("no address", []), ("one@x.test", ["one@x.test"]), (",;,a@x.test,;", ["a@x.test"]),
    ("O'Neil <o@x.test>, D'Arcy <d@x.test>", ["o@x.test", "d@x.test"]), ('"open <a@x.test>, b@x.test', ["a@x.test", "b@x.test"]),
]


def test_packed_values(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PACKED)] + [(99, None)], "k int, raw string")
    got = {r.k: r.v for r in df.select("k", packed_values(F.col("raw")).alias("v")).collect()}
    assert got.pop(99) is None
    for i, (text, want) in enumerate(PACKED):
        assert got[i] == want, text


def test_packed_rows(spark):
    many = ", ".join(f"a{i}@x.test" for i in range(20_000))
    rows = [(1, 0, "a@x.test, a@x.test", "x"), (1, 0, "a@x.test, a@x.test", "y"), (2, 0, None, "x"), (3, 0, "", "x"), (4, 1, many, "x"), (5, 0, "one@x.test", "x")]
    df = spark.createDataFrame(rows, "msg_id int, hpos int, raw string, address string")
    got = explode_packed(df, "raw", ["msg_id", "hpos"]).collect()
    assert sorted(tuple(r) for r in got if r.msg_id == 1) == [(1, 0, 0, "a@x.test"), (1, 0, 1, "a@x.test")]
    assert sum(r.msg_id == 4 for r in got) == 20_000 and not any(r.msg_id in (2, 3, 5) for r in got)
    assert explode_packed(df.limit(0), "raw", ["msg_id", "hpos"]).count() == 0


def test_long_comments_and_quotes(spark):
    """A field of a megabyte is read without recursion, however it is made up."""
    n = 1 << 20
    texts = [
        f"a@b.test, ({'x' * n}) c@d.test", f"a@b.test, ({'x' * n} c@d.test, e@f.test", f"a@b.test, ({'\"q\"' * (n // 3)}) c@d.test", '"' * n + " a@b.test, c@d.test",
        f'a@b.test, "{"y, " * (n // 3)}" <c@d.test>', "a@b.test, c@d.test" + " " * n, "(" * n + "a@b.test, c@d.test", "a@b.test, " + "z" * n,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, raw string")
    got: dict = {}
    for r in explode_packed(df, "raw", ["msg_id"]).collect():
        got.setdefault(r.msg_id, []).append(r.address)
    two = ["a@b.test", "c@d.test"]
    assert got == {0: two, 1: [*two, "e@f.test"], 2: two, 3: two, 4: two, 5: two, 6: two}


def test_graph():
    mail = unify(observed(json.loads('{"headers": [["A", "1"]], "content_type": "a/b", "enclosed": {"parts": [{"body": "x", "content_type": ["c/d", {"k": "v"}]}]}}')), "root", MAIL_ALIKE)
    assert mail.relations() == {"root", "headers"}
    assert mail.inlined("root")["content_type_main"] == ["content_type", "main"] and "body" in mail.inlined("root")
    g = SchemaGraph("a", [Edge("a", "b", "b"), Edge("b", "c", "c"), Edge("a", "d", "d"), Edge("d", "c", "c"), Edge("d", "e", "e", True)])
    assert g.relations() == {"a", "c", "e"} and g.recursive() == set()


def shred(node, path="0", parent=""):
    """Brute force: recursion over well-formed records."""
    yield "part", path, parent
    i = 0
    for k, v in node.get("headers", []):
        for _ in v if isinstance(v, list) else [v]:
            yield "header", f"{path}#{i}", path
            i += 1
    for i, c in enumerate(node.get("parts", [])):
        if c is not None:
            yield from shred(c, f"{path}.{i}", path)
    if node.get("enclosed"):
        yield from shred(node["enclosed"], f"{path}.e", path)


def test_records(spark):
    rng = random.Random(5)

    def make(depth):
        out = {}
        if rng.random() < 0.8:
            out["headers"] = [[rng.choice("AB"), rng.choice(["x", ["y", "z"]])] for _ in range(rng.randint(0, 3))]
        if depth and rng.random() < 0.8:
            out["parts"] = [None if rng.random() < 0.2 else make(depth - 1) for _ in range(rng.randint(0, 3))]
        if depth and rng.random() < 0.3:
            out["enclosed"] = make(depth - 1)
        return out | {"size": 1}

    records = [make(4) for _ in range(40)]
    rows = [(i, json.dumps(r), "n") for i, r in enumerate(records)]
    df = spark.createDataFrame(rows + rows[:5], "msg_id int, record_json string, node_path string").repartition(3)
    got = sorted((r.msg_id, r.node_kind, r.node_path, r.parent_path) for r in flatten_records(df, "msg_id", "record_json").collect())
    assert got == sorted((i, *x) for i, r in enumerate(records) for x in shred(r))


def test_record_shapes(spark):
    deep = {}
    for _ in range(3000):
        deep = {"enclosed": deep}
    texts = {
        1: '{"headers": {"To": ["a", "b"], "X": "1"}, "parts": {"content_type": "text/html"}}', 2: '{"message": {"headers": [{"name": "A", "value": "1"}, null, "x"]}, "meta": {}}',
        3: '{"enclosed": "{\\"headers\\": [[\\"A\\", \\"1\\"]]}"}', 4: '{"parts": [', 5: "", 6: "null", 7: "[]", 8: None, 9: '{"content_type": ["text/plain", {"charset": "x"}], "headers": null, "parts": null}', 10: "7",
    }
    df = spark.createDataFrame(list(texts.items()), "k int, j string")
    nodes = flatten_records(df, "k", "j").cache()
    got = {k: sorted(r.node_path for r in nodes.collect() if r.k == k) for k in texts}
    assert got[1] == ["0", "0#0", "0#1", "0#2", "0.0"] and got[2] == ["0", "0#0"] and got[3] == ["0", "0.e", "0.e#0"]
    assert all(not got[k] for k in (4, 5, 6, 7, 8, 10)) and got[9] == ["0"]
    parts = {(r.k, r.node_path): r for r in part_table(nodes, "k").collect()}
    assert parts[1, "0.0"].content_type_main == "text" and parts[1, "0.0"].content_type_sub == "html" and json.loads(parts[9, "0"].content_type_params) == {"charset": "x"}
    assert {(r.name, r.value) for r in header_table(nodes, "k").where("k = 1").collect()} == {("To", "a"), ("To", "b"), ("X", "1")}
    assert flatten_records(df.limit(0), "k", "j").count() == 0
    assert {(e.parent, e.name, e.child, e.many) for e in infer_graph(df.where("k = 1"), "j").edges} >= {("root", "headers", "headers", True), ("root", "parts", "root", False)}
    # Without the edges that the graph has, there are no rows below the root.
    assert {r.node_path for r in flatten_records(df, "k", "j", graph=SchemaGraph("root")).collect()} == {"0"}


def test_elements_of_many_names(spark):
    """A root, a part or a map with any number of names loses nothing, and a map with the names of other elements is none of them."""
    records = [{f"x-{i}-{k}": {"name": "a", "value": "b"} if k == 7 else "v" for k in range(10)} | {"headers": [["A", "1"]], "content_type": "text/plain", "parts": [{"body": f"b{i}", f"y{i}": 1, "headers": {"B": ["2", "3"]}}]} for i in range(60)]
    records[0]["meta"] = {f"k{i}": i for i in range(500)} | {"main": 1, "sub": 2, "name": 3, "value": 4}
    nodes = flatten_records(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "k int, j string").repartition(3), "k", "j").cache()
    mine = sorted((r.k, r.node_kind, r.node_path, r.parent_path) for r in nodes.where("node_kind in ('part', 'header')").collect())
    want = [("part", "0", ""), ("header", "0#0", "0"), ("part", "0.0", "0"), ("header", "0.0#0", "0.0"), ("header", "0.0#1", "0.0")]
    assert mine == sorted((i, *x) for i in range(60) for x in want)
    parts = {(r.k, r.node_path): r for r in part_table(nodes, "k").collect()}
    assert all(parts[i, "0"].content_type_main == "text" and parts[i, "0.0"].body == f"b{i}" for i in range(60))
    fields = {(r.k, r.node_path): r.fields for r in nodes.where("node_kind = 'part'").collect()}
    assert fields[3, "0"]["x-3-2"] == "v" and fields[0, "0"]["meta_k499"] == "499" and fields[3, "0.0"]["y3"] == "1"


def test_deep_records(spark):
    """The reader and the writer do not recurse; rows come from any depth."""
    n = 100_000
    text = '{"enclosed": ' * n + '{"headers": [["A", "1"]]}' + "}" * n
    root = readable(text)
    depth = 0
    while "enclosed" in root:
        root, depth = root["enclosed"], depth + 1
    assert depth == n and root["headers"]
    rng = random.Random(2)
    for _ in range(300):
        x = json.loads(json.dumps([rng.choice([1, -2.5e3, None, True, "a\"\\\n", [], {}, {"k": [1, {"é": []}]}]) for _ in range(rng.randint(0, 4))]))
        from lettermill.operators.nested_records import _deep_loads

        assert _deep_loads(json.dumps(x, indent=rng.choice([None, 1]))) == x
    for bad in ("[1,]", "{,}", "[1 2]", '{"a" 1}', "[", '{"a":', "1 2", "[}", '["a]'):
        try:
            _deep_loads(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert loads(dumps(loads("[" * 30_000 + "]" * 30_000)))  # and back
    df = spark.createDataFrame([(1, '{"enclosed": ' * 3000 + '{"body": {"x": 1}}' + "}" * 3000), (1, '{"enclosed": '), (2, '{"parts": [{"parts": [{}]}]}')], "k int, j string")
    rows = flatten_records(df, "k", "j").groupBy("k").agg(F.count("*").alias("n"), F.max(F.length("node_path")).alias("m")).collect()
    assert {(r.k, r.n, r.m) for r in rows} == {(1, 3001, 6001), (2, 3, 5)}


def test_days(spark):
    days = [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in range(-200_000, 200_000, 997)] + [dt.date(2000, 2, 29), dt.date(1900, 2, 28)]
    df = spark.createDataFrame([(d.year, d.month, d.day, (d - dt.date(1970, 1, 1)).days) for d in days] + [(2023, 2, 29, None), (1900, 2, 29, None), (2023, 13, 1, None), (2023, 4, 31, None), (2023, 0, 1, None)], "y int, m int, d int, w bigint")
    assert df.where(~days_from_civil(F.col("y"), F.col("m"), F.col("d")).eqNullSafe(F.col("w"))).count() == 0


UTC = dt.timezone.utc


def at(*a):
    return dt.datetime(*a, tzinfo=UTC).replace(tzinfo=None)


DATES = [
    ("Fri, 27 Dec 2024 07:38:34 +0000", None, "2024-12-27T07:38:34.000000Z"), ("08/03/2023 13:05", at(2023, 3, 8, 13, 10), "2023-03-08T13:05:00.000000Z"), ("08/03/2023 13:05", at(2023, 8, 3, 13, 10), "2023-08-03T13:05:00.000000Z"),
    ("1701326122772", None, "2023-11-30T06:35:22.772000Z"), ("2022-02-24T15:18:02.720671Z", None, "2022-02-24T15:18:02.720671Z"), ("30 juin 2024 à 07h55", None, "2024-06-30T07:55:00.000000Z"), ("10. März 2022 00:41:17", None, "2022-03-10T00:41:17.000000Z"),
    ("2/24/2024 10:11:24 PM", at(2024, 2, 24, 22, 20), "2024-02-24T22:11:24.000000Z"), ("2/24/2024 12:11:24 AM", None, "2024-02-24T00:11:24.000000Z"), ("Sun Jun 02 2024 09:18:36 GMT+0100 (CET)", None, "2024-06-02T08:18:36.000000Z"),
    ("Fri, 26 Feb 2021 08:38:59 CST", at(2021, 2, 26, 0, 45), "2021-02-26T00:38:59.000000Z"), ("Fri, 26 Feb 2021 08:38:59 CST", at(2021, 2, 26, 14, 45), "2021-02-26T14:38:59.000000Z"), ("Sat, 27 Jan 24 16:15:51 +0530", None, "2024-01-27T10:45:51.000000Z"),
    ("yesterday", None, None), ("", None, None), (None, None, None), ("Thu, 32 Foo 2023 25:61:00 +0000", None, None), ("0000-00-00 00:00:00", None, None), ("2023-02-29 10:00:00", None, None), ("2023-01-01", None, None), ("x" * 100_000, None, None),
]


def test_timestamps(spark):
    rows = [(i, t, "UTC", near, "x") for i, (t, near, _) in enumerate(DATES)]
    df = spark.createDataFrame(rows, "k int, t string, z string, near timestamp_ntz, utc string").withColumn("near", F.col("near").cast("timestamp"))
    got = {r.k: r.utc for r in normalise_timestamps(df, "t", ["k"], "z", "near").collect()}
    for i, (text, near, want) in enumerate(DATES):
        assert got.get(i) == want, (text, near)
    assert normalise_timestamps(df.limit(0), "t", ["k"], "z", "near").count() == 0


def test_timestamps_in_zones(spark):
    rng, rows = random.Random(1), []
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"]
    starts = [dt.datetime(2023, 3, 26, 1, tzinfo=UTC), dt.datetime(2023, 10, 29, 0, 30, tzinfo=UTC), dt.datetime(2023, 11, 5, 5, 30, tzinfo=UTC), dt.datetime(2023, 4, 1, 15, 30, tzinfo=UTC)]
    for i in range(400):
        zone = rng.choice(zones)
        t = rng.choice(starts) + dt.timedelta(minutes=rng.randint(-300, 300)) if i % 2 else dt.datetime(2021, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=rng.randint(0, 10**8))
        t = t.replace(microsecond=0)
        local = t.astimezone(ZoneInfo(zone))
        rows.append((i, local.strftime("%Y-%m-%d %H:%M:%S"), zone, (t + dt.timedelta(minutes=9)).replace(tzinfo=None), t.strftime("%Y-%m-%dT%H:%M:%S.000000Z")))
    df = spark.createDataFrame(rows, "k int, t string, z string, near timestamp_ntz, want string").withColumn("near", F.col("near").cast("timestamp"))
    got = {r.k: r.utc for r in normalise_timestamps(df, "t", ["k"], "z", "near").collect()}
    assert [k for k, *_, want in rows if got[k] != want] == []
    # A local time that no clock shows has a defined result, and so has an unknown zone.
    gap = spark.createDataFrame([(1, "2023-03-26 02:30:00", "Europe/Berlin"), (2, "2023-03-26 02:30:00", "no zone"), (3, "2023-03-26 02:30:00", None)], "k int, t string, z string").withColumn("near", F.lit(None).cast("timestamp"))
    assert {r.k: r.utc[11:16] for r in normalise_timestamps(gap, "t", ["k"], "z", "near").collect()} == {1: "00:30", 2: "02:30", 3: "02:30"}


def test_components():
    assert components("2024-03-31T04:16:55+02:00[Europe/Warsaw]")[7] == [120] and components("2023-12-16T14:14:43[Europe/Berlin]")[8] == "Europe/Berlin"
