"""The operators for language-model training data against brute force, round trips and held-out truth; and their edge cases."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import canonical, encoding, leakage, new_text, personal, reading, tokenizer, wikitext

# New text


class Brute:
    """Inherited runs by looking at every pair of places."""

    def __init__(self, texts):
        self.texts = texts

    def inherited(self, words, least):
        out = [False] * len(words)
        for t in self.texts:
            for i in range(len(words)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    if n >= least:
                        out[i : i + n] = [True] * n
        return out


def test_automaton_is_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(rng.randint(0, 4))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        least = rng.randint(1, 5)
        a = new_text.SuffixAutomaton()
        for t in texts:
            a.add(t)
        assert a.inherited(words, least) == Brute(texts).inherited(words, least)


MAILS = [
    ("Hi Ann,\n\nsee below.\n\nKind regards\nBob Smith\n\nOn 2024-01-02 10:00, Ann Lee <a@x.io> wrote:\n> old\n> text", [4, 5, 7, 8, 9]),
    ("Yes.\r\n\r\n-- \r\nBob Smith\r\n+1 202 555 0101\r\n\r\nSent from my Phone", [2, 3, 4, 6]),
    ("> question one\n\nanswer one\n\n> question two\n\nanswer two", [0, 4]),
    ("ok\n\n-----Original Message-----\nFrom: a@b.io\nSent: x\nTo: y\nSubject: z\n\nall of it\n\nold", [2, 3, 4, 5, 6, 8, 10]),
    ("From: the gate, take lane 4.\n\nSent from the canteen, the crate took 60 days.\n\nThis message board is confidential, I was told.", []),
    ("Text.\n\n______________________________\nThis e-mail is confidential. If you received it in error, delete every copy.", [2, 3]),
    ("Text.\n\nBest,\nBob\n\nPS: more of my text.", [2, 3]),
    ("Text here.\n\nAm 02.01.24 10:00 schrieb Ann Lee\n<a@x.io>:\n> alt", [2, 3, 4]),
    ("Bob Smith wrote:\n| old\n|\n| older", [0, 1, 2, 3]), ("", []), ("\n\n", []), ("Hello,", []),
]


@pytest.mark.parametrize("body,want", MAILS)
def test_lines(body, want):
    assert new_text.line_marks(body) == want


def test_new_text(spark):
    history = " ".join(f"word{i} and{i} so{i}" for i in range(40))
    rows = [(i, "t1", 0, b, "x") for i, (b, _) in enumerate(MAILS)] + [(100, "t2", 0, history, "x"), (101, "t2", 1, "My answer.\n\n" + history.replace("word20", "\nword20") + "\n\nMore.", "y"), (102, None, None, "alone", "x"), (103, "t1", 1, None, "x"), (100, "t2", 0, history, "z")]
    df = spark.createDataFrame(rows, "msg_id bigint, conv_id string, turn bigint, body string, line_no string")
    got = {}
    for r in new_text.old_lines(df).collect():
        got.setdefault(r.msg_id, []).append(r.line_no)
    for i, (_, want) in enumerate(MAILS):
        assert sorted(got.get(i, [])) == want
    assert sorted(got[101]) == [2, 3] and 100 not in got and 102 not in got and 103 not in got
    text = {r.msg_id: r.new_text for r in new_text.new_text(df).collect()}
    assert text[101] == "My answer.\n\n\nMore." or text[101].split() == ["My", "answer.", "More."]
    assert new_text.old_lines(df.limit(0)).count() == 0


def test_unmarked_history_of_fifteen_words(spark):
    """History without any mark, wrapped otherwise, is found by the automaton; sentences that many threads have are not evidence."""
    old = "the spare rotor left the workshop on tuesday and will reach the northern gate before the end of the month"
    chance = "please send the list of all open orders to the finance desk before friday noon and keep a copy for us"
    rows = [(1, "m", 1, 0, old), (2, "m", 1, 1, "Good.\n\n" + old.replace(" will", "\nwill"))]
    for c in range(10, 16):
        rows += [(2 * c, "m", c, 0, f"Number {c}.\n\n{chance}"), (2 * c + 1, "m", c, 1, f"Another {c}.\n\n{chance}")]
    df = spark.createDataFrame(rows, "msg_id bigint, message_id string, conv_id bigint, turn bigint, body string")
    assert {(r.msg_id, r.line_no) for r in new_text.old_lines(df).collect()} == {(2, 2), (2, 3)}


def test_notices_are_learnt(spark):
    """A sentence that recurs beside notices in several threads is known as part of one, also where it stands with no word of a notice."""
    notice, strange = "This message is confidential and intended only for its addressee.", "Mind the whales when you fold this sheet of paper."
    rows = [(k, k, 0, f"Text {k} about parts.\n\n{notice} {strange}") for k in range(6)]
    rows += [(50, 50, 0, f"Other text.\n\n{strange}"), (51, 51, 0, "Mind the gap when you fold.\n\nNot a notice here at all.")]
    df = spark.createDataFrame(rows, "msg_id bigint, conv_id bigint, turn bigint, body string")
    assert {(r.msg_id, r.line_no) for r in new_text.old_lines(df).collect()} == {(k, 2) for k in range(6)} | {(50, 2)}
    few = df.where("msg_id >= 50")
    assert new_text.old_lines(few).count() == 0


def test_two_bodies_under_one_id(spark):
    """The lines that are marked and the spans that are replaced are those of the body that is shown."""
    df = spark.createDataFrame([(1, 2, 0, "aaa first\n> old"), (1, 1, 5, "Z\n\nKind regards\nBob Smith"), (2, None, None, None), (3, 1, 1, " ")], "msg_id bigint, conv_id bigint, turn bigint, body string")
    assert {r.msg_id: r.new_text for r in new_text.new_text(df).collect()} == {1: "Z", 3: ""}
    messages = personal.one_body(spark.createDataFrame([(1, "write to rosa@x.test now"), (1, "zz nothing here at all, dear reader"), (2, None)], "msg_id bigint, body string"))
    none = spark.createDataFrame([], "k string, owner_name string"), spark.createDataFrame([], "addr_id bigint, display_name string")
    assert {r.msg_id: r.masked for r in personal.mask_personal(messages, personal.find_personal(messages, *none)).collect()} == {1: "write to [EMAIL] now"}


def test_crowded_turns(spark, monkeypatch):
    """Many messages of one turn are parted; none is lost."""
    monkeypatch.setattr(new_text, "MOST_TOGETHER", 10)
    df = spark.createDataFrame([(k, 1, 0, f"text {k}\n> old {k}") for k in range(100)], "msg_id bigint, conv_id bigint, turn bigint, body string")
    assert {(r.msg_id, r.line_no) for r in new_text.old_lines(df).collect()} == {(k, 1) for k in range(100)}


def test_long_thread_is_cut(spark):
    rows = [(i, 7, i, f"note {i}\n\n> {i - 1}") for i in range(200)]
    got = new_text.old_lines(spark.createDataFrame(rows, "msg_id bigint, conv_id bigint, turn bigint, body string"))
    assert got.count() == 200 and got.where("line_no = 2").count() == 200


def test_history_from_far_back(spark, monkeypatch):
    """A mail is compared with every earlier one of its thread: a hundred turns before it, and in another part of a crowded turn."""
    old = "the spare rotor left the workshop on tuesday and will reach the northern gate before the end of the month"
    rows = [(0, 1, 0, old), *((i, 1, i, f"note {i}") for i in range(1, 150)), (150, 1, 150, "Good.\n\n" + old.replace(" will", "\nwill"))]
    rows += [(1000 + k, 2, 0, old.replace("rotor", "stator")) if k == 0 else (1000 + k, 2, 0, f"word {k}.\n\n{old.replace('rotor', 'stator')}" if k == 99 else f"word {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "msg_id bigint, conv_id bigint, turn bigint, body string")
    for most in (10, 5000):
        monkeypatch.setattr(new_text, "MOST_TOGETHER", most)
        monkeypatch.setattr(new_text, "WINDOW", most)
        assert {(r.msg_id, r.line_no) for r in new_text.old_lines(df).collect()} == {(150, 2), (150, 3), (1099, 2)}
        unknown = df.select(F.when(F.col("msg_id") != 150, F.col("msg_id")).alias("msg_id"), "conv_id", F.when(F.col("msg_id") == 149, 150).otherwise(F.col("turn")).alias("turn"), "body")
        assert {(r.msg_id, r.line_no) for r in new_text.old_lines(unknown).collect()} == {(None, 2), (None, 3), (1099, 2)}


def test_blocks_are_the_whole_thread(spark, monkeypatch):
    """Cut into blocks or whole, a thread gives the same lines: inherited runs, words that tell nothing, endings."""
    rng = random.Random(7)
    shared = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randint(0, 9)) for _ in range(rng.randint(9, 16))) + "." for _ in range(60)]
    common = [f"This sentence number {'abc'[k]} stands in a great many of the threads." for k in range(3)]
    rows = []
    for c in range(5):
        for t in range(40):
            said = [rng.choice(shared[12 * c : 12 * c + 12] + common) if rng.random() < 0.8 else f"own words of {c} and {t} here." for _ in range(rng.randint(1, 6))]
            rows.append((100 * c + t, c, t // 3 if c % 2 else t, rng.choice([" ", "\n", "\n\n"]).join(said) + rng.choice(["", "\n\nOfficina Nord", "\n\nOfficina Nord\nGate 4"])))
    df = spark.createDataFrame(rows, "msg_id bigint, conv_id bigint, turn bigint, body string")
    whole = {(r.msg_id, r.line_no) for r in new_text.old_lines(df).collect()}
    seen = []
    keep = new_text._inherited_from_afar
    monkeypatch.setattr(new_text, "_inherited_from_afar", lambda placed: seen.append(keep(placed).count()) or keep(placed))
    for window, most, characters in ((4, 6, 1 << 20), (64, 1 << 20, 600)):
        monkeypatch.setattr(new_text, "WINDOW", window)
        monkeypatch.setattr(new_text, "MOST_TOGETHER", most)
        monkeypatch.setattr(new_text, "MOST_CHARACTERS", characters)
        assert {(r.msg_id, r.line_no) for r in new_text.old_lines(df).collect()} == whole
    assert len(seen) == 2 and min(seen) > 20 and len(whole) > 100, (seen, len(whole))


# Personal information

NAMES = personal.Names(frozenset({"rosa", "peter", "will", "zoë"}), frozenset({"quist", "jörbury"}))


def fitted():
    counts = {"EMAIL:+++0": 50, "NAME:+++0": 50, "NAME:0++0": 40, "NAME:0+0-": 9, "PHONE:+++0": 40, "PHONE:-+0-": 40, "ID:+0+0": 20, "ID:-00-": 20, "STREET:+++0": 20, "STREET:+0+0": 10, "STREET:++00": 9}
    probability = personal.em_probabilities(counts)
    return probability, personal.train_classifier([(p.split(":")[0], p, 0, 0, n) for p, n in counts.items()], probability).tolist()


SPANS = [
    ("Hi Rosa, call +44 7700 900123 or write to p.quist@x.test.", [("NAME", "Rosa"), ("PHONE", "+44 7700 900123"), ("EMAIL", "p.quist@x.test")]),
    ("Ticket 4282-806-20 is open. Measured 202 555 0101 pulses.", []), ("I spoke with Quist, Peter\n> about it", [("NAME", "Quist, Peter")]),
    ("His ID is QX1234567, born then.", [("ID", "QX1234567")]), ("Send to 12A Copper Way, Unit 5 now", [("STREET", "12A Copper Way, Unit 5")]), ("Sent from my Rosa handset", []), ("rosa (at) x dot test", [("EMAIL", "rosa (at) x dot test")]),
    ("Dear ZoÃ« JÃ¶rbury,", [("NAME", "ZoÃ« JÃ¶rbury")]), ("", []), ("Will you come?", []),
]


@pytest.mark.parametrize("text,want", SPANS)
def test_spans(text, want):
    _, weights = fitted()
    assert [(t, text[s:e]) for t, s, e in personal.choose(personal.candidates(text, NAMES, frozenset()), weights)] == want


RARE = [
    ("Dear Mr Wilmora,", ["Wilmora"]), ("Hi Ulvane,\nall is well", ["Ulvane"]), ("Dear Team,\n\nHello World of mail", []), ("From: Orla Dorwick <od@x.test>", ["Orla Dorwick"]), ("I am,\nRosa Wilmora\nClerk", ["Rosa Wilmora"]),
    ("From: Support Desk <s@x.test>", []), ("I spoke with Kelmora about it", ["Kelmora"]), ("Dear Ms\nTeam", []),
]


@pytest.mark.parametrize("text,want", RARE)
def test_names_that_few_fields_have(text, want):
    """Found by title, greeting, From line or the name word before, or as words of a single name field."""
    names = personal.Names(NAMES.given, NAMES.family, frozenset(), frozenset({"kelmora"}))
    _, weights = fitted()
    assert [text[s:e] for t, s, e in personal.choose(personal.candidates(text, names, frozenset()), weights) if t == "NAME"] == want


def test_rare_name_words_are_kept(spark):
    who = spark.createDataFrame([("k", "Rosa Quist")] * 3 + [("k", "Orla Kelmora")], "k string, owner_name string")
    names, _ = personal.name_words(who, spark.createDataFrame([], "addr_id bigint, display_name string"))
    assert (names.role("Rosa"), names.role("Quist"), names.role("Orla"), names.role("Kelmora"), names.role("Dorwick")) == (1, 2, personal.WEAK + 1, personal.WEAK + 2, 0)


def test_names_beyond_the_broadcast(spark):
    """Names that do not fit into the gazetteer of every executor come to the bodies by a join, and are found all the same."""
    who = spark.createDataFrame([(f"k{i}", f"Given{chr(97 + i % 26)}{chr(97 + i // 26)} Family{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)], "account_key string, owner_name string")
    book = spark.createDataFrame([], "addr_id bigint, display_name string")
    names, more = personal.name_words(who, book, most=30)
    assert more.count() == 90 and len(names.rare.given | names.rare.family) == 30
    df = spark.createDataFrame([(i, f"Hello Given{chr(97 + i % 26)}{chr(97 + i // 26)} Family{chr(97 + i % 26)}{chr(97 + i // 26)},\n\nall is well.") for i in range(60)], "msg_id bigint, body string")
    keep = personal.name_words
    try:
        personal.name_words = lambda a, b: keep(a, b, most=30)
        got = {(r.msg_id, r.start_pos, r.end_pos) for r in personal.find_personal(df, who, book).collect() if r.pii_type == "NAME"}
    finally:
        personal.name_words = keep
    assert got == {(r.msg_id, r.start_pos, r.end_pos) for r in personal.find_personal(df, who, book).collect() if r.pii_type == "NAME"} and len(got) == 60


def test_towns_of_all_bodies(spark):
    """A town that a sample of the messages has too seldom, or not at all, still ends its streets."""
    rows = [(i, f"Send to {i + 1} Copper Road now" if i % 10 == 0 else f"Hello {i}, nothing here") for i in range(4000)] + [(10_000 + i, f"Send to {i + 1} Copper Road, Selby now") for i in range(4)]
    df = spark.createDataFrame(rows, "msg_id bigint, body string")
    none = spark.createDataFrame([], "k string, owner_name string"), spark.createDataFrame([], "addr_id bigint, display_name string")
    for sample in (5000, 400):
        got = {r.msg_id: dict(rows)[r.msg_id][r.start_pos : r.end_pos] for r in personal.find_personal(df, *none, sample=sample).collect()}
        assert len(got) == 404 and all(got[10_000 + i] == f"{i + 1} Copper Road, Selby" for i in range(4))
    assert personal._towns(spark.createDataFrame([("selby now", 2), ("selby ", 2), ("st ives", 3), ("rare ", 2)], "town string, n bigint")) == {"selby", "st ives"}


class Tried:
    """A pattern that notes what it is tried on."""

    def __init__(self, pattern):
        self.pattern, self.on = pattern, []

    def search(self, text, *at):
        self.on.append(text)
        return self.pattern.search(text, *at)


def test_long_patterns_are_tried_seldom(monkeypatch):
    """The patterns of many words are not tried where the word before a span settles the vote."""
    tried = {k: Tried(getattr(personal, k)) for k in ("_PHONE_YES", "_NUMBER_NO", "_ID_YES", "_STREET_YES", "_NAME_YES")}
    for k, v in tried.items():
        monkeypatch.setattr(personal, k, v)
    body = "We saw 202 555 0101 again; please call 202 555 0102. Order 9281-806-20 is late, nobody knows why. We saw Rosa again. They went past 12 Copper Way again, or from 14 Copper Way. "
    found = personal.proposals(body * 3, NAMES)
    assert {k: len(v.on) for k, v in tried.items()} == dict.fromkeys(tried, 0)
    assert [(t, votes[2:]) for t, _, _, votes, *_ in found if t == "PHONE"] == [("PHONE", (0, 0)), ("PHONE", (1, 0)), ("PHONE", (0, -1))] * 3
    assert [votes[2:] for t, _, _, votes, *_ in found if t == "STREET"] == [(0, 0), (1, 0)] * 3


def test_words_at_the_end_vote_as_the_patterns():
    rng = random.Random(5)
    words = "reach call text me on at t m telefonisch Telefon numer number no nr nr. Ticket Under CASINO batch serial order ticKet caſe factura заказ счет номер numéro ☎ ID ids his ssn passport dni Taxi séc sociale send to point é hat rozmawiam z on 3 4: am 12 2024 10:30 Dear with а a my meu моего From über".split()
    marks = [" ", "  ", "\t", ": ", ". ", ", ", "# ", " #", "> ", "|", "*", "-", "“", "☎ ", "\u00a0", "_", "", "\x1f", "\n"]
    pairs = [(personal._phone_yes, personal._PHONE_YES), (personal._number_no, personal._NUMBER_NO), (personal._id_yes, personal._ID_YES), (personal._street_yes, personal._STREET_YES), (personal._name_yes, personal._NAME_YES), (personal._device_before, personal._DEVICE_BEFORE)]
    said = [0] * len(pairs)
    for _ in range(20_000):
        before = "".join(rng.choice([str, str.upper, str.title])(rng.choice(words)) + rng.choice(marks) for _ in range(rng.randint(0, 4)))[-rng.randint(1, 44) :]
        for i, (vote, pattern) in enumerate(pairs):
            want = bool(pattern.search(before))
            assert vote(before) == want, (pattern.pattern, before)
            said[i] += want
    assert min(said) > 100


def test_em_finds_the_reliable():
    rng = np.random.default_rng(3)
    counts: dict[str, int] = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = [1 if rng.random() < (0.9 if true else 0.1) else -1, 1 if rng.random() < (0.8 if true else 0.3) else 0, 1 if rng.random() < (0.7 if true else 0.05) else 0, -1 if rng.random() < (0.02 if true else 0.6) else 0]
        p = "NAME:" + "".join("-0+"[v + 1] for v in votes)
        counts[p] = counts.get(p, 0) + 1
    q = personal.em_probabilities(counts)
    assert q["NAME:+++0"] > 0.95 and q["NAME:-00-"] < 0.05


def test_personal(spark):
    rows = [(i, f"Hi Rosa,\n\ncall 202.555.01{i % 100:02d} or rosa{i}@x.test\n\nPeter Quist", "x") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (902, "x" * 200_000 + " a@b.test", "x"), (5, "Hi Rosa,\n\ncall 202.555.0105 or rosa5@x.test\n\nPeter Quist", "x")]
    df = spark.createDataFrame(rows, "msg_id bigint, body string, pii_type string")
    who = spark.createDataFrame([("k", f"{g} {f}") for g in ("Rosa", "Peter", "Anna") for f in ("Quist", "Lund", "Vane")] * 2, "k string, owner_name string")
    book = spark.createDataFrame([(1, "Rosa Quist"), (2, None)], "addr_id bigint, display_name string")
    spans = personal.find_personal(df, who, book).cache()
    got = {}
    for r in spans.collect():
        got.setdefault(r.msg_id, set()).add((r.pii_type, rows[r.msg_id][1][r.start_pos : r.end_pos] if r.msg_id < 300 else "long"))
    assert all(got[i] == {("NAME", "Rosa"), ("PHONE", f"202.555.01{i % 100:02d}"), ("EMAIL", f"rosa{i}@x.test"), ("NAME", "Peter Quist")} for i in range(300))
    assert got[902] == {("EMAIL", "long")} and 900 not in got and 901 not in got
    masked = {r.msg_id: r.masked for r in personal.mask_personal(df, spans).collect()}
    assert masked[7] == "Hi [NAME],\n\ncall [PHONE] or [EMAIL]\n\n[NAME]" and masked[901] == "" and masked[902].endswith(" [EMAIL]")
    assert personal.find_personal(df.limit(0), who, book).count() == 0


# Canonical values

HOSTS = [(1, "ulfmola.net.example"), (2, "zanbexa.mail.test"), (3, "zanbexa.com.example"), (4, "tanlune-works.org.example")]
TYPED = {
    "ULFMOLA.NET.EXAMPLE": 1, " ulfmola.net.example.": 1, "ulfmola.nte.example": 1, "ulfmolanet.example": 1, "ulfmоla.net.example": 1, "http://www.ulfmola.net.example/x": 1, "ulfmola": 1, "zanbexa,mail,test": 2, "zanbexa.mailt.est": 2, "ｚａｎｂｅｘａ.ｃｏｍ.ｅｘａｍｐｌｅ": 3,
    "zanbexa": -1, "tanlune-wrks.org.examplle": 4, "mx.ulfmola.net.example": -1, "other.net.example": -1, "[198.51.100.4]": -1, "localhost": -1, "x" * 5000: -1, "zanbexa . com . example": 3,
}


def test_hosts(spark):
    rows = [(i, v, 0) for i, v in enumerate(TYPED)] + [(100, None, 0), (101, "", 0), (102, "  ", 0), (103, "zanbexa.mail.test", 0), (0, next(iter(TYPED)), 1)] + [(1000 + i, "ULFMOLA.NET.EXAMPLE", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "addr_id bigint, hostname string, host_id int")
    hosts = spark.createDataFrame(HOSTS, "host_id int, hostname string")
    got = {r.addr_id: r.host_id for r in canonical.canonical_hosts(df.drop("host_id"), hosts).collect()}
    assert [(v[:40], got[i], want) for i, (v, want) in enumerate(TYPED.items()) if got[i] != want] == []
    assert not {100, 101, 102, 103} & set(got) and len(got) == len(TYPED) + 2000
    assert canonical.canonical_hosts(df.drop("host_id").limit(0), hosts).count() == 0
    assert {r.host_id for r in canonical.canonical_hosts(df.drop("host_id"), hosts.limit(0)).collect()} == {-1}


def test_repairs_are_brute_force():
    """The index of pieces finds every term within its slips, for tokens of any length."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcde") for _ in range(n)) for n in (2, 4, 5, 7, 8, 9, 12, 24, 25, 34, 70, 120)]
    known = canonical.Entries(list(enumerate(names)))
    for _ in range(600):
        b = list(rng.choice(names))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b))
            if rng.random() < 0.4 and k + 1 < len(b):
                b[k], b[k + 1] = b[k + 1], b[k]
            elif rng.random() < 0.5 and len(b) > 1:
                del b[k]
            else:
                b.insert(k, rng.choice("abcde"))
        token = "".join(b)
        want = {t for t in known.idf if canonical.slips(token, t, canonical.term_slips(len(t))) <= canonical.term_slips(len(t))}
        assert set(known.repairs(token)) == want


def test_ranking_decides(monkeypatch):
    """Long labels are repaired too; without the score, or without repairs, nothing is meant."""
    label = "quillmarshandtolland" * 3
    known = canonical.Entries([(1, f"{label}.net.example"), (2, "zanbexa.mail.test")])
    slipped = "x" + label[:20] + label[21:50] + "q" + label[50:] + ".net.example"
    assert known.decide(slipped) == 1 and known.decide("zanbexa.mial.test") == 2 and known.decide("zanbexa") == 2
    monkeypatch.setattr(canonical.Entries, "score", lambda self, repaired, variant: 0.0)
    assert known.decide(slipped) == -1 and known.decide("zanbexa") == -1
    monkeypatch.undo()
    monkeypatch.setattr(canonical.Entries, "repairs", lambda self, token: {})
    assert known.decide(slipped) == -1 and known.decide("zanbexa") == -1


# Encodings


def test_lengths_decide(monkeypatch):
    """Two readings without a strange pair: the one whose words the dictionary has is shorter and holds; without lengths they are equal."""
    d = describer()
    bad = "Über".encode().decode("latin-1") + " " + "Größe".encode().decode("latin-1")
    assert d.restore(bad)[0] == "Über Größe"
    whole = d.bits(bad, list(range(len(d.languages)))) - d.bits("Über Größe", list(range(len(d.languages))))
    assert whole >= encoding.UTF8_BITS
    d.known.clear()
    monkeypatch.setattr(encoding.Describer, "bits", lambda self, text, languages: 8 * (1000 - len(text)))
    assert d.restore(bad)[0] == bad  # lengths that grow where the text gets shorter: no chain pays


CLEAN = ["Réunion à l’entrepôt", "Übergabe der Schlüssel für Größe", "Relação de peças não", "Zamówienie części później", "Новые чертежи и склад", "会議の変更について", "Don’t forget the “list” – ok", "José Müller", "¿Cuándo abre? mañana"]


def describer():
    return encoding.Describer(encoding.train_dictionaries([f"{t}\n{t} {i}" for t in CLEAN for i in range(30)], ["José Müller", "Zoë Żelwick"] * 30))


def test_clean_text_stays():
    d = describer()
    for t in CLEAN:
        assert d.restore_lines(t) == (t, False)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "gbk"])
def test_garbled_text_comes_back(wrong):
    d = describer()
    for t in CLEAN:
        raw = t.encode()
        try:
            bad = raw.decode(wrong)
        except UnicodeDecodeError:
            if wrong != "cp1252":
                continue
            bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
        new, hit = d.restore_lines(bad)
        assert hit and (new == t or wrong in ("gbk", "cp437")), (wrong, bad, new)
        if wrong == "latin-1":
            twice = bad.encode().decode("latin-1")
            assert d.restore_lines(twice) == (t, True)


def test_tables_and_losses():
    d = describer()
    assert d.restore_lines("Новые чертежи".encode("cp1251").decode("latin-1")) == ("Новые чертежи", True)
    assert d.restore_lines("Новые чертежи".encode("koi8-r").decode("cp1251")) == ("Новые чертежи", True)
    assert d.restore_lines("S��ren")[1] and d.restore_lines("ok\nRÃ©union Ã\xa0 lâ€™entrepÃ´t\nRéunion")[0] == "ok\nRéunion à l’entrepôt\nRéunion"


def test_the_jvm_finds_the_same(spark):
    texts = CLEAN + [t.encode().decode("latin-1") for t in CLEAN] + ["", "plain", "Cafй", "ChloΘ", "a�b"]
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", encoding.suspicious(F.col("t")).alias("s")).collect()}
    assert all(got[t] == bool(encoding.SUSPECT.search(t)) for t in texts)


def test_usual_pairs_are_of_all_records(spark):
    """Letters that a sample has too seldom, or only behind the first 4,000 characters, are usual and their lines stay as they are."""
    plain = [(i, f"hello {i}") for i in range(4000)]
    rare = [(10_000 + i, "x " * 2500 + f"\nthe word na\u00efvet\u00e9 {i}") for i in range(5)]
    df = spark.createDataFrame([("", t) for _, t in plain + rare] + [("names", "Zo\u00eb \u017belwick")] * 3, "source string, text string")
    got = encoding.usual_pairs(df)
    brute: dict = {}
    for source, text in df.collect():
        for language, line in encoding._clean_lines(text, source):
            for p in set(encoding.pairs(line)):
                brute[language, p] = brute.get((language, p), 0) + 1
    assert {(k, p) for k, v in got.items() for p in v} == {k for k, n in brute.items() if n >= 3} and got["names"] >= {"o\u00eb", " \u017c"}
    assert encoding.train_dictionaries([], [], known=got)["en"][1] == got["en"]
    messages = spark.createDataFrame(plain + rare, "msg_id bigint, body string")
    headers, addresses = spark.createDataFrame([], "msg_id bigint, hname string, decoded string"), spark.createDataFrame([], "addr_id bigint, display_name string")
    seen = []
    keep, encoding.restore_texts = encoding.restore_texts, lambda r, d, *a: seen.append(d) or keep(r, d, *a)
    try:
        encoding.garbled_records(headers, messages, addresses, sample=100).count()
    finally:
        encoding.restore_texts = keep
    assert seen[0]["en"][1] == got["en"] and len(got["en"]) > 3


def test_dictionaries_are_of_all_records(spark):
    """Words of a few of many texts are in the dictionary, and are counted as often as they stand there."""
    rare = [f"na\u00efvet\u00e9{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    lines = [(50_000 + 3 * i + k, f"the {w} of {k}") for i, w in enumerate(rare) for k in range(3)]
    messages = spark.range(30_000).select(F.col("id").alias("msg_id"), F.concat(F.lit("hello "), F.col("id").cast("string")).alias("body")).unionByName(spark.createDataFrame(lines, "msg_id bigint, body string"))
    headers, addresses = spark.createDataFrame([], "msg_id bigint, hname string, decoded string"), spark.createDataFrame([], "addr_id bigint, display_name string")
    seen = []
    keep, encoding.restore_texts = encoding.restore_texts, lambda r, d, *a: seen.append(d) or keep(r, d, *a)
    try:
        assert encoding.garbled_records(headers, messages, addresses).count() == 0
    finally:
        encoding.restore_texts = keep
    assert [w for w in rare if w.encode() not in seen[0]["en"][0]] == []
    counted = encoding.count_texts(messages.select(F.lit("").alias("source"), F.col("body").alias("text")).repartition(5))
    got = {r["item"]: r["n"] for r in counted.where("kind = 'word'").collect()}
    assert got == {"the": 180, " of": 180, **{f" {k}": 60 for k in range(3)}, **{f" {w}": 3 for w in rare}}
    assert encoding._training_lines([("a", 30), ("b", 10)], places=8, together=4) == [b"aaba", b"aaba"]


def test_garbled_records(spark):
    subjects = [(i, "Subject" if i % 2 else "SUBJECT", f"Réunion à l’entrepôt {i}") for i in range(40)] + [(50, "subject", "RÃ©union Ã\xa0 lâ€™entrepÃ´t"), (50, "subject", "RÃ©union Ã\xa0 lâ€™entrepÃ´t"), (51, "subject", None), (52, "To", "RÃ©union")]
    headers = spark.createDataFrame(subjects, "msg_id bigint, hname string, decoded string")
    messages = spark.createDataFrame([(1, "Réunion à l’entrepôt"), (2, None), (3, ""), (4, "x\n" * 50_000 + "RÃ©union")], "msg_id bigint, body string")
    addresses = spark.createDataFrame([(1, "José"), (2, "JosÃ©"), (3, None)], "addr_id bigint, display_name string")
    got = {(r.field_name, r.rec_id): r for r in encoding.garbled_records(headers, messages, addresses).collect()}
    assert set(got) == {("subject", 50), ("body", 4), ("display_name", 2)} and got["subject", 50].restored == "Réunion à l’entrepôt" and got["display_name", 2].is_restored
    assert encoding.garbled_records(headers.limit(0), messages.limit(0), addresses.limit(0)).count() == 0


# Tokenizer


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(tokenizer.tokenizer_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_reference(reference):
    rng = random.Random(1)
    letters = "ab 's'tllvere'dm \n\t  é漢1２!?  \x1c-\U0001f600Ż'<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["", "a" * 3000, "ab" * 900, " " * 500 + "x", "'" * 700, "the quick  brown\n\n fox's"]
    e = tokenizer.BytePairEncoder(tokenizer.tokenizer_path())
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(t), t
        assert reference.decode(ids.tolist()) == t


def test_long_texts_in_pieces(reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "CHUNK", 64)
    monkeypatch.setattr(tokenizer, "CACHE", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "x", "  ", "\n", "don't ", "é1 "]) for _ in range(400)) for _ in range(20)]
    e = tokenizer.BytePairEncoder(tokenizer.tokenizer_path())
    assert [i.tolist() for i in e.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_corpus(spark, reference):
    rows = [(1, "hello world", [9]), (2, "", [9]), (3, None, [9]), (1, "hello world", [9])]
    got = tokenizer.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>"), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(1, reference.encode_ordinary("hello world"))] * 2 + [(2, []), (3, [])]
    assert tokenizer.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


# Leakage


def brute_passage(item, doc, least=16, one_in=5):
    """Every pair of ranges by the number of edits between them: slow and plain."""
    n, m = len(item), len(doc)
    for i in range(n - least + 1):
        for j in range(m - least + 1):
            if item[i] != doc[j]:
                continue
            # best[a][b]: fewest edits from item[i:i+a] to doc[j:j+b]
            line = list(range(min(m - j, n - i + 30) + 1))
            matched = [0] * len(line)
            for a in range(1, n - i + 1):
                new, hits = [a], [0]
                for b in range(1, len(line)):
                    same = item[i + a - 1] == doc[j + b - 1]
                    options = [(line[b - 1] + (not same), -(matched[b - 1] + same)), (line[b] + 1, -matched[b]), (new[b - 1] + 1, -hits[b - 1])]
                    cost, hit = min(options)
                    new.append(cost)
                    hits.append(-hit)
                line, matched = new, hits
                if any(one_in * c <= a and h >= least for c, h in zip(line, matched, strict=True)):
                    return True
    return False


def test_passages_are_brute_force():
    rng = random.Random(6)
    agree = 0
    for _ in range(120):
        item = [rng.randint(0, 60) for _ in range(rng.randint(16, 30))]
        copy = item[rng.randint(0, 6) :]
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(copy))
            copy = copy[:k] + rng.choice([[], [99], [99, copy[k]], [copy[k]]]) + copy[k + 1 :]
        doc = [rng.randint(70, 90) for _ in range(5)] + copy + [rng.randint(70, 90) for _ in range(5)]
        at = {}
        for i, t in enumerate(item):
            at.setdefault(t, []).append(i)
        places = [(t, p) for p, t in enumerate(doc) if t in at]
        got = leakage.holds_passage(at, [t for t, _ in places], [p for _, p in places], 16, 5)
        agree += got == brute_passage(item, doc)
    assert agree >= 118  # the two count an exchange of neighbours and a repeated word differently


def test_edits_that_lie_together():
    """25 words with five changed ones among the ninth to fifteenth: a passage, though every 16 of its words have more edits than one in five."""
    item = list(range(25))
    doc = [99 if i in (8, 10, 11, 12, 14) else i for i in item]
    at = {t: [t] for t in item}
    places = [(t, p) for p, t in enumerate(doc) if t in at]
    assert leakage.holds_passage(at, [t for t, _ in places], [p for _, p in places], 16, 5) and brute_passage(item, doc)
    doc[16] = 99
    places = [(t, p) for p, t in enumerate(doc) if t in at]
    assert not leakage.holds_passage(at, [t for t, _ in places], [p for _, p in places], 16, 5)


def test_prefilters_lose_no_passage():
    """Whatever holds a passage has enough grams near each other, and a phrase that is found from its rarest term."""
    rng = random.Random(12)
    held = 0
    for _ in range(400):
        item = [rng.randint(0, 40) for _ in range(rng.randint(16, 60))]
        copy = item[:]
        for _ in range(rng.randint(0, len(item) // 5)):
            k = rng.randrange(len(copy))
            copy = copy[:k] + rng.choice([[], [99], [99, copy[k]]]) + copy[k + 1 :]
        doc = [rng.randint(0, 40) for _ in range(20)] + copy + [rng.randint(0, 40) for _ in range(20)]
        at: dict = {}
        for i, t in enumerate(item):
            at.setdefault(t, []).append(i)
        places = [(t, p) for p, t in enumerate(doc) if t in at]
        terms, positions = np.array([t for t, _ in places]), np.array([p for _, p in places])
        if leakage.holds_passage(at, terms.tolist(), positions.tolist(), 16, 5):
            held += 1
            grams = leakage.Grams([item], 16, 5)
            near = [n for n, keep in grams.likely(terms, positions, [0], leakage._reach(16, 5)[1]) if leakage.holds_passage(at, terms[keep].tolist(), positions[keep].tolist(), 16, 5)]
            lists: dict = {}
            for t, p in places:
                lists.setdefault(t, []).append(p)
            seeds = leakage.phrases_from([item], {t: len(x) for t, x in lists.items()}, 4)
            assert near == [0] and leakage.phrase_items(lists, seeds) == {0}
    assert held > 100


def test_posting_lists(spark):
    df = spark.createDataFrame([(1, "a b a c x y"), (1, "a b a c x y"), (1, "b b b"), (2, None), (None, "a b a")], "doc_id bigint, text string")
    vocabulary = {"a": 0, "b": 1, "c": 2}
    rows = leakage.positional_index(df, "doc_id", "text", vocabulary, leakage.Grams([[0, 1, 0, 2]], 4, 5), 10).collect()
    lists = sorted((r["_key"], r.term, list(r.positions)) for r in rows)
    assert [x for x in lists if x[1] != 1] == [(1, 0, [0, 2]), (1, 2, [3])] and (1, 1, [1]) in lists


def test_leaks(spark):
    item = " ".join(f"alpha{i} beta" for i in range(15))
    w = item.split()
    docs = [
        (1, f"Intro. {item} end."), (2, item.upper().replace(" ", "\n")), (3, " ".join(w[:15])), (4, " ".join(w[:16])), (5, "'''" + " ".join(w[:20]).replace("beta", "[[beta]]<ref>note</ref>") + "'''"),
        (6, " ".join(x if i % 3 else "wrong" for i, x in enumerate(w))), (7, " ".join(x if i % 6 else "wrong" for i, x in enumerate(w))), (8, None), (9, ""), (10, "filler " * 50_000 + item), (11, "al­pha0 " + " ".join(w[1:20])), (1, f"Intro. {item} end."), (12, "{{quote|" + item + "}}"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect()} == {(k, 7) for k in (1, 2, 4, 5, 7, 10, 11, 12)}
    assert leakage.leaked_items(df.limit(0), items).count() == 0 and leakage.leaked_items(df, items.limit(0)).count() == 0


def test_null_keys(spark):
    text = " ".join(f"alpha{i} beta" for i in range(15))
    df = spark.createDataFrame([(None, text), (1, "other")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, text), (2, text + " more")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect()} == set()  # a null key joins with nothing
    hosts = spark.createDataFrame([*HOSTS, (None, "x.test"), (9, None)], "host_id int, hostname string")
    typed = spark.createDataFrame([(None, "ulfmola"), (1, "x.tset")], "addr_id bigint, hostname string")
    assert {(r.addr_id, r.host_id) for r in canonical.canonical_hosts(typed, hosts).collect()} == {(None, 1), (1, -1)}
    assert {r.doc_id for r in tokenizer.encode_corpus(df, "doc_id", "text").collect()} == {None, 1}
    spans = personal.find_personal(spark.createDataFrame([(None, "write to a@b.test")], "msg_id bigint, body string"), spark.createDataFrame([], "k string, owner_name string"), spark.createDataFrame([], "addr_id bigint, display_name string"))
    assert [(r.msg_id, r.pii_type) for r in spans.collect()] == [(None, "EMAIL")]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 10)
    texts = [" ".join(f"w{k}x{i}" for i in range(18)) for k in range(3)]
    df = spark.createDataFrame([(k, f"a b {t} c") for k, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect()) == [(0, 0), (1, 1), (2, 2)]


# Reading levels


def test_plain():
    text = "'''Bold''' [[a|b]] [[c]]<ref name=x>no</ref><ref name=y/> {{t|{{u}}|x}} <!-- no -->\n{| class=x\n| cell\n|}\n== Head ==\n&amp; x­y [[Category:No]] [http://x.io link]"
    assert wikitext.plain(text, headings=False).split() == "Bold b c & xy link".split()


def test_deep_templates():
    assert wikitext.plain("a {{x|" * 500 + "inner" + "}}" * 500 + " b").split() == ["a", "b"]
    assert wikitext.plain("a {{x|" * 20 + "b").count("{{") == 20


def test_levels(spark):
    rng = random.Random(8)
    pools = {1: "dog cat run sit big red sun".split(), 2: "harbour market festival children village bakery".split(), 3: "government province agricultural administration revenue".split(), 4: "epistemology heterogeneity parameterization ontological asymptotic".split()}
    make = lambda b: " ".join(f"the {rng.choice(pools[b])} of a {rng.choice(pools[b])} is in the {rng.choice(pools[b if rng.random() < 0.8 else rng.randint(1, 4)])}." for _ in range(20))
    docs = [(i, make(i % 4 + 1), i) for i in range(200)] + [(900, None, 0), (901, "", 0), (902, "the dog is short", 0), (903, "Der Hund und die Katze sind in dem Haus mit der Frau. " * 30, 0), (904, "Der Hund und die Katze. " * 60 + "\n" + make(1), 0), (905, None, 0)]
    docs = docs[:-1] + [docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, reading_band bigint")
    labels = spark.createDataFrame([(i, i, f"r{k}", (i % 4 + 1) if k < 2 else None) for i in range(0, 100) for k in range(3)], "label_id bigint, doc_id bigint, rater string, reading_band int")
    got = {r.doc_id: r.reading_band for r in reading.reading_levels(df, labels).collect()}
    held_out = [got[i] == i % 4 + 1 for i in range(100, 200)]
    assert sum(held_out) >= 98 and not {900, 901, 902, 903, 904} & set(got)
    assert reading.reading_levels(df.limit(0), labels).count() == 0 and reading.reading_levels(df, labels.limit(0)).count() == 0
