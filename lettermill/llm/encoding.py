"""Text that was decoded with the wrong character encoding.

Candidates are chains of steps, each of which takes the characters back to the bytes of one encoding and reads these
by another. Every candidate is compressed with a zstandard dictionary of each language; the chain with the least
description length, its own cost included, holds, and where no chain pays for itself the text stays as it is. The pairs
of characters that a language has only prune: a step must leave fewer strange pairs than there were, and as compressed
lengths are whole bytes, a text without any may be as long as the garbled one to the byte. Pairs and words are counted
over all texts; a dictionary, which has a stated size, is trained on the words of its language as often as they occur in
proportion. Only texts in which neighbouring
characters are unusual come to Python at all: that test is a regular expression in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lettermill.session import materialise, spread

#: Neighbouring characters that clean text seldom has; written so that Java and Python read it alike.
_SYMBOL = "\\u00a1-\\u00bf\\u00d7\\u00f7\\u02c6\\u02dc\\u2010-\\u2018\\u201a-\\u204a\\u20ac\\u2122\\u2202-\\u22ff\\uf8ff"
_LATIN = "\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
_FOREIGN = "\\u0370-\\u03ff\\u0400-\\u052f\\u2200-\\u25ff\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3\\uff61-\\uff9f\\ue000-\\uf8ff"
_UPPER = "\\u00c0-\\u00d6\\u00d8-\\u00de\\u0152\\u0160\\u0178\\u017d"
_WORD = f"A-Za-z{_LATIN}"
_ODD = "\\u00a1-\\u00aa\\u00ac-\\u00be\\u20ac\\u2030\\u2039\\u201a\\u201e\\u2020\\u2021\\u02c6\\u02dc\\u0192"
#: What Cyrillic text becomes if its UTF-8 is read as GBK: rare characters, two bytes of a letter each.
_GBK_CYRILLIC = "".join(c for a in (0xD0, 0xD1) for b in range(0x80, 0xC0) if (c := bytes([a, b]).decode("gbk", "ignore")))
#: What may stand before, a character that is not ASCII, and what stands after it (empty: anything).
_SUSPECTS = [
    ("", "\\ufffd\\u0080-\\u009f", ""),  # what a decoder puts for bytes it can't read, and controls that nobody types
    ("", "\\u2500-\\u259f\\u2264-\\u2265\\u2320-\\u2321", ""),  # frames and blocks
    (_WORD, _FOREIGN, ""), ("", _FOREIGN, _WORD),  # scripts mixed in a word
    ("", _LATIN, f"{_LATIN}{_SYMBOL}\\u2019"), ("", _ODD, _LATIN), ("A-Za-z\\u0400-\\u04ff", _SYMBOL, "A-Za-z\\u0400-\\u04ff"),
    ("A-Za-z", "\\u201a\\u0192\\u201e\\u2020\\u2021\\u02c6\\u2030\\u2039\\u02dc\\u00a2\\u00a4\\u00a6-\\u00a9\\u00ac-\\u00af\\u00b1-\\u00b3\\u00b5-\\u00b9\\u00bc-\\u00bf", ""),
    ("", "\\u0400-\\u04ff", "\\u00a1-\\u00aa\\u00ac-\\u00ba\\u00bc-\\u00bf"), ("", "\\u00a1-\\u00aa\\u00ac-\\u00ba\\u00bc-\\u00bf\\u201a\\u201e\\u2020-\\u2022\\u2030\\u2039", "\\u0400-\\u04ff"),
    ("a-z\\u00df-\\u00f6\\u00f8-\\u00ff", _UPPER, ""), ("", "\\u0430-\\u045f", "\\u0400-\\u042f"),  # a capital after a small letter
    ("", "\\u0400-\\u040f\\u0450-\\u045f\\u0490\\u0491", "\\u0400-\\u045f\\u0490\\u0491"),  # letters of other Cyrillic alphabets
    ("", _SYMBOL, _SYMBOL), ("", "\\u00ac\\u2202-\\u22ff\\u00a2\\u00a8\\u00af\\u00b8\\u00a4", ""), ("", "\\u00bf", "a-z"), ("", _GBK_CYRILLIC, _GBK_CYRILLIC),
]
# A search goes from one character that is not ASCII to the next; what it is and what surrounds it is looked at there.
SUSPECT_PATTERN = "[^\\u0000-\\u007f](?:" + "|".join(f"(?<={f'[{p}]' if p else ''}[{c}]){f'[{n}]' if n else ''}" for p, c, n in _SUSPECTS) + ")"
SUSPECT = re.compile(SUSPECT_PATTERN)
#: Evidence that needs no decoding: bytes were lost, so the text cannot be had back.
LOST = re.compile("[�\u0080-\u009f]")


def suspicious(text: Column) -> Column:
    return text.rlike(SUSPECT_PATTERN)


# Codecs by the bytes 128 to 255: single-byte ones as tables, others by Python's codec.
_WRONG = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-15", "mac_cyrillic"]
_WIDE = ["gbk", "cp932", "big5", "cp949", "euc_jp"]
_RIGHT = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5"]
#: Bits for a step: reading as UTF-8 seldom works by chance, reading by a table more often. Compressed lengths are counted in bytes.
UTF8_BITS, TABLE_BITS, BYTE_BITS = 4, 6, 8


@lru_cache(maxsize=None)
def _byte_of(codec: str) -> dict[str, int]:
    """Character to byte, for the upper half. Bytes without a character in a codec are controls, as lenient decoders make them."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    if codec in ("cp1252", "cp1254", "iso8859-15"):
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _utf8_pattern(codec: str) -> re.Pattern:
    """Sequences of characters whose bytes in `codec` could be one character of UTF-8. A no-break space may have become a blank."""
    byte_of = _byte_of(codec)
    lead = lambda low, high: "".join(re.escape(c) for c, b in byte_of.items() if low <= b <= high)
    tail = "[" + "".join(re.escape(c) for c, b in byte_of.items() if b < 0xC0) + "]"
    return re.compile(f"[{lead(0xC2, 0xDF)}]{tail}|[{lead(0xE0, 0xEF)}]{tail}{{2}}|[{lead(0xF0, 0xF4)}]{tail}{{3}}")


@lru_cache(maxsize=None)
def _table(wrong: str, right: str) -> dict[int, str]:
    out = {}
    for c, b in _byte_of(wrong).items():
        try:
            d = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
        if d != c:
            out[ord(c)] = d
    return out


def as_utf8(text: str, codec: str) -> str:
    byte_of = _byte_of(codec)

    def back(m: re.Match) -> str:
        try:
            c = bytes(byte_of[x] for x in m.group()).decode()
        except UnicodeDecodeError:
            return m.group()
        return m.group() if unicodedata.category(c) in ("Cn", "Co", "Cs") else c

    return _utf8_pattern(codec).sub(back, text)


def likely_codecs(text: str) -> list[str]:
    """Codecs by which UTF-8 was read, by the signs that each leaves; for a first look at a text."""
    out = ["cp1252", "cp1252"] if re.search("[\u00c2-\u00f4]", text) else []
    out += ["mac_roman"] if re.search("\u221a|\u201a\u00c4|\u00ac[\u00a3\u00b0-\u00bf]", text) else []
    return out + (["cp437"] if re.search("[\u251c\u252c\u0393]", text) else [])


_RUN = re.compile(r"[^\x00-\x7f]+[\x40-\x7e]?")


def _wide_as_utf8(text: str, codec: str) -> str:
    def back(m: re.Match) -> str:
        for run in (m.group(), re.sub("[\x00-\x7f]$", "", m.group())):
            try:
                return run.encode(codec).decode() + m.group()[len(run) :]
            except UnicodeError:
                continue
        return m.group()

    return _RUN.sub(back, text)


def _bytes(text: str, codec: str) -> bytes | None:
    byte_of = _byte_of(codec)
    try:
        return bytes(ord(c) if ord(c) < 128 else byte_of[c] for c in text)
    except KeyError:
        return None


def steps(text: str, wanted: Callable[[str], bool] = lambda _: True) -> Iterator[tuple[str, int]]:
    """Every text that one step makes of `text`, with the bits of the step; of readings by tables those whose snippets are `wanted`."""
    seen = {text}
    short = snippets(text)
    looked = {short}
    for codec in _WRONG:
        if (t := as_utf8(text, codec)) not in seen:
            seen.add(t)
            yield t, UTF8_BITS
    for codec in _WIDE[:4]:
        if (t := _wide_as_utf8(text, codec)) not in seen:
            seen.add(t)
            yield t, UTF8_BITS + 1
    high = {c for c in text if ord(c) > 127}
    for wrong in _WRONG:
        byte_of = _byte_of(wrong)
        inside = sum(c in byte_of for c in high)
        if inside * 2 < len(high):
            continue
        raw = _bytes(text, wrong) if inside == len(high) else None
        for right in _RIGHT:
            if right != wrong:
                if (sample := short.translate(_table(wrong, right))) in looked:
                    continue
                looked.add(sample)
                if not wanted(sample):
                    continue
                t = raw.decode(right, "replace") if raw and right != "cp1252" else text.translate(_table(wrong, right))
                if t not in seen:
                    seen.add(t)
                    yield t, TABLE_BITS
        if raw and len(high) > 2 and wrong in ("cp1252", "mac_roman", "cp437"):
            for right in ("cp932", "euc_jp", "gbk"):
                try:
                    t = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if t not in seen:
                    seen.add(t)
                    yield t, TABLE_BITS


_ALIKE = str.maketrans("123456789\t\r", "000000000  ")
_HIGH = re.compile(r"[^\x00-\x7f]+")


def snippets(text: str) -> str:
    """What stands around and in runs of characters that are not ASCII; it has the pairs of the text."""
    return " ".join(text[max(0, m.start() - 1) : m.end() + 1] for m in _HIGH.finditer(text))


_ENDS = {chr(k): v if isinstance(v, str) else chr(v) for k, v in _ALIKE.items()}


def _pieces(text: str) -> Iterator[str]:
    """Each run of characters that are not ASCII with its neighbours, in small letters; digits are alike and so are ends and blanks."""
    last = len(text)
    for m in _HIGH.finditer(text):
        s, e = m.span()
        run = m.group()
        low = run.lower()
        if len(low) != len(run):  # a capital that has two small letters
            low = "".join(c.lower()[:1] for c in run)
        before, after = text[s - 1].lower() if s else " ", text[e].lower() if e < last else " "
        yield _ENDS.get(before, before) + low + _ENDS.get(after, after)


def pairs(text: str) -> list[str]:
    """Neighbouring characters of which one is not ASCII, without case."""
    return [p for piece in _pieces(text) for p in map(str.__add__, piece, piece[1:])]


class Describer:
    """Description length of texts by the dictionaries of several languages; their pairs of characters prune."""

    def __init__(self, languages: dict[str, tuple[bytes, frozenset[str]]]):
        self.languages = []
        for _, (data, known) in sorted(languages.items()):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=3)
            self.languages.append((zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False), known))
        self.any = frozenset().union(*(known for _, known in self.languages)) if self.languages else frozenset()
        self.known: dict[str, tuple[str, bool]] = {}

    def odd_pairs(self, text: str, most: int = 1 << 30) -> tuple[int, list[int]]:
        """The number of pairs that a language does not have, least over the languages, and the languages with so few; `most` and none if there are as many as that."""
        if not self.languages:
            return 0, []
        there, odd, known = [], 0, self.any
        for piece in _pieces(text):
            for p in map(str.__add__, piece, piece[1:]):
                if p not in known and (odd := odd + 1) >= most:
                    return most, []
                there.append(p)
        counts = [len(there) - sum(map(own.__contains__, there)) for _, own in self.languages]
        least = min(counts)
        return (least, [k for k, n in enumerate(counts) if n == least]) if least < most else (most, [])

    def bits(self, text: str, languages: list[int]) -> int:
        """Bits of the text by the dictionary that suits it best, of these languages."""
        raw = text.encode("utf-8", "surrogatepass")
        return BYTE_BITS * min((len(self.languages[k][0].compress(raw)) for k in languages), default=len(raw))

    def usual(self, line: str) -> bool:
        """Whether one language has every pair of the line."""
        there = pairs(line)
        return any(all(map(known.__contains__, there)) for _, known in self.languages)

    def restore(self, text: str) -> tuple[str, bool]:
        """The text by the best chain, and whether it is another text or has lost bytes. A chain has as many steps as pay;
        as each leaves fewer strange pairs, it ends."""
        if text in self.known:
            return self.known[text]
        odd, suited = self.odd_pairs(text)
        best, paid, least = text, 0, self.bits(text, suited)
        while odd:
            found = None
            for t, cost in steps(best, lambda sample, odd=odd: self.odd_pairs(sample, odd)[0] < odd):
                if found is not None and not found[0][1] and cost == TABLE_BITS > found[0][2]:
                    break  # read as UTF-8 it has no strange pair; the readings by tables come last, are longer and cost more
                left, suited = self.odd_pairs(t, odd)
                if left >= odd:
                    continue
                total = self.bits(t, suited) + paid + cost
                rank = (total - (0 if left else BYTE_BITS), left, cost)
                if rank[0] < least and (found is None or rank < found[0]):
                    found = rank, t, total
            if found is None:
                break
            (_, odd, cost), best, least = found
            paid += cost
        out = best, best != text or bool(LOST.search(text))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[text] = out
        return out

    def restore_lines(self, text: str) -> tuple[str, bool]:
        """Line by line, so that a text garbled in part is restored in part; only suspicious lines are looked at."""
        if not SUSPECT.search(text):
            return text, False
        out, garbled = [], False
        for line in text.split("\n"):
            if SUSPECT.search(line) and not self.usual(line):
                line, hit = self.restore(line)
                garbled |= hit
            out.append(line)
        return "\n".join(out), garbled


# Words by which a line is put to the dictionary of a language.
_TELLING = {
    "de": "der die das und ist nicht für mit bitte wir sie ich auf", "fr": "le la les des est pour nous vous une dans pas bonjour merci", "es": "el los las que para por una está con gracias hola señor",
    "pt": "o os que para uma não com obrigado mais olá do da", "pl": "nie się na jest w z dzień dziękuję proszę czy mój", "en": "the of and to is for with you i in on",
}
_TELLING_SETS = {k: frozenset(v.split()) for k, v in _TELLING.items()}


def _language(line: str) -> str:
    if re.search("[぀-ヿ㐀-鿿]", line):
        return "ja"
    if re.search("[Ѐ-ӿ]", line):
        return "ru"
    found = re.findall(r"[^\W\d_]+", line.lower())
    best = max(_TELLING_SETS, key=lambda k: (sum(w in _TELLING_SETS[k] for w in found), k))
    return best if any(w in _TELLING_SETS[best] for w in found) else "other"


def _decodes(line: str) -> bool:
    return any(as_utf8(line, codec) != line for codec in _WRONG)


_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u052f\u2200-\u25ff\u3400-\u9fff]|[\u0370-\u052f\u2200-\u25ff\u3400-\u9fff][A-Za-z\u00c0-\u024f]")
#: A pair is usual if at least this share of the lines of the language that have pairs have it.
USUAL_SHARE = 0.005


def _clean_lines(text: str, source: str, plain: bool = True) -> Iterator[tuple[str, str]]:
    """(language, line) of the lines that could not be read as UTF-8, have lost no bytes and do not mix scripts; ASCII ones if `plain`."""
    for line in text.split("\n"):
        line = line.strip("> |\r\t")
        ascii_only = line.isascii()
        if len(line) < 3 or (ascii_only and not plain) or (not ascii_only and (LOST.search(line) or _MIXED.search(line) or (SUSPECT.search(line) and _decodes(line)))):
            continue
        yield source or _language(line), line


#: Words with the blank before them; what is written without blanks is cut where the script changes.
_TOKEN = re.compile("[\u3040-\u309f]+|[\u30a0-\u30ff]+|[\u3400-\u9fff]{1,4}|\\s?[^\\s\u3040-\u30ff\u3400-\u9fff]+")
#: Languages whose clean lines look suspicious now and then, and are trained on all the same.
_ODD_LANGUAGES = ("pt", "pl", "de")


def count_texts(texts: DataFrame) -> DataFrame:
    """`language`, `kind`, `item`, `n`: pairs of characters by the lines that have them (`pair`; `line` has the number of lines),
    and words by their places (`word`), counted over all lines of `texts` (`source`, which is `names` or empty, and `text`)
    that have a character beyond ASCII. Lines without any are the same in every reading and never looked at."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def taken() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["language", "kind", "item", "n"])
            counts.clear()
            return out

        for batch in batches:
            for source, text in batch.itertuples(index=False, name=None):
                for language, line in _clean_lines(text, source, plain=False):
                    if there := set(pairs(line)):
                        counts[language, "line", ""] += 1
                        counts.update((language, "pair", p) for p in there)
                    if language in _ODD_LANGUAGES or not SUSPECT.search(line):
                        counts.update((language, "word", w) for w in _TOKEN.findall(line))
            if len(counts) > 200_000:
                yield taken()
        yield taken()

    high = texts.where(F.col("text").rlike("[^\\x00-\\x7f]")).select("source", "text")
    return materialise(high.mapInPandas(count, "language string, kind string, item string, n bigint").groupBy("language", "kind", "item").agg(F.sum("n").alias("n")), "counts")


def _usual(counted: DataFrame, share: float) -> dict[str, frozenset[str]]:
    number = {r["language"]: r["n"] for r in counted.where(F.col("kind") == "line").collect()}
    enough = F.lit(False)
    for language, n in number.items():
        enough = enough | ((F.col("language") == language) & (F.col("n") >= max(3, share * n)))
    out: dict[str, set[str]] = {language: set() for language in number}
    for r in counted.where((F.col("kind") == "pair") & enough).toLocalIterator():
        out[r["language"]].add(r["item"])
    return {k: frozenset(v) for k, v in out.items()}


def usual_pairs(texts: DataFrame, share: float = USUAL_SHARE) -> dict[str, frozenset[str]]:
    """The usual pairs of characters of each language, counted over all lines of `texts` (`source`, which is `names` or empty, and
    `text`). The driver is given those alone that are usual: of a language 1 / `share` times the pairs of a line at most."""
    return _usual(count_texts(texts), share)


def _is_usual(word: str, usual: frozenset[str]) -> bool:
    """Whether the pairs inside a word are usual; what stands beside its ends is not known."""
    there = pairs(word)
    return all(p in usual for p in there[not word[0].isascii() : len(there) - (not word[-1].isascii())])


def _training_lines(words: list[tuple[str, int]], places: int = 400_000, together: int = 10) -> list[bytes]:
    """Lines of `together` words, in which each word stands as often as it was counted, or in proportion if that is more than
    `places` in all, but once at least, and evenly spread."""
    scale = min(1.0, places / max(1, sum(n for _, n in words)))
    spread_ = sorted(((i + 0.5) / k, w) for w, n in words for k in (max(1, round(n * scale)),) for i in range(k))
    return ["".join(w for _, w in spread_[i : i + together]).encode() for i in range(0, len(spread_), together)]


def counted_dictionaries(counted: DataFrame, known: dict[str, frozenset[str]], size: int = 48_000) -> dict[str, tuple[bytes, frozenset[str]]]:
    """A dictionary of `size` bytes for each language of `count_texts`, and one for names, with the pairs `known` of it.

    The words are those that have usual pairs alone. The most frequent come to the driver, half as many as the bytes of a
    dictionary, which has no room for more.
    """

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[_is_usual(w, known.get(language, frozenset())) for language, w in zip(batch["language"], batch["item"], strict=True)]]

    words = counted.where(F.col("kind") == "word").select("language", "item", "n").mapInPandas(clean, "language string, item string, n bigint")
    rank = F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "item"))
    by_language: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in words.withColumn("rank", rank).where(F.col("rank") <= size // 2).orderBy("language", "rank").collect():
        by_language[r["language"]].append((r["item"], r["n"]))
    out = {language: (_dictionary(_training_lines(by_language[language]), usual, size), usual) for language, usual in sorted(known.items())}
    return {language: (data, usual) for language, (data, usual) in out.items() if len(data) >= 8}


def _dictionary(samples: list[bytes], usual: frozenset[str], size: int) -> bytes:
    """A dictionary trained on samples; of few of them, or none, these or the usual pairs themselves."""
    data = b""
    if len(samples) > 200:
        try:
            data = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too little to train on
            pass
    return data or b"\n".join(reversed(samples))[-size:] or "".join(sorted(usual)).encode()


def train_dictionaries(texts: list[str], names: list[str], size: int = 48_000, share: float = USUAL_SHARE, known: dict[str, frozenset[str]] | None = None) -> dict[str, tuple[bytes, frozenset[str]]]:
    """A dictionary of `size` bytes for each language of `texts`, and one for names, with the pairs of characters that are usual there.

    Lines that could be read as UTF-8, have lost bytes or mix scripts are left out. The pairs are those of `known`, else
    they are counted in `texts` and `names`. Of equal lines one goes into the training; a language of few lines, or that
    only `known` has, gets these lines, or its pairs, for a dictionary.
    """
    by_language: dict[str, dict[str, None]] = defaultdict(dict)
    counts: dict[str, Counter] = defaultdict(Counter)
    number: Counter = Counter()
    for source, some in (("", texts), ("names", names)):
        for text in some:
            for language, line in _clean_lines(text, source):
                if known is None and (there := set(pairs(line))):
                    number[language] += 1
                    counts[language].update(there)
                if not SUSPECT.search(line) or language in _ODD_LANGUAGES:
                    by_language[language][line] = None
    if known is None:
        known = {language: frozenset(p for p, n in c.items() if n >= max(3, share * number[language])) for language, c in counts.items()}
    out = {}
    for language in {**by_language, **known}:
        lines, usual = by_language.get(language, {}), known.get(language, frozenset())
        clean = [x for x in lines if all(p in usual for p in pairs(x))]
        samples = [x.encode() for x in clean if not x.isascii()] * 2 + [x.encode() for x in clean if x.isascii()]
        data = _dictionary(samples, usual, size)
        if len(data) >= 8:
            out[language] = data, usual
    return out


def _sample(df: DataFrame, key: str, text: str, most: int) -> list[str]:
    """The `most` texts whose keys have the least hashes, whole."""
    rows = df.where(F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("h"), text).orderBy("h").limit(most)
    return [r[1] for r in rows.toLocalIterator()]


_DESCRIBERS: dict[int, Describer] = {}


def restore_texts(records: DataFrame, dictionaries: dict[str, tuple[bytes, frozenset[str]]], keys: list[str], text: str) -> DataFrame:
    """keys, `restored` (the text, as far as it could be had back) and `is_restored` for each garbled record.

    Null, empty and clean texts give no row. `dictionaries` is bounded by its training.
    """
    stamp = hash(tuple((k, d, len(p)) for k, (d, p) in sorted(dictionaries.items())))
    fields = [records.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", restored string, is_restored boolean"
    names = [*keys, "restored", "is_restored"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if stamp not in _DESCRIBERS:
            _DESCRIBERS.clear()
            _DESCRIBERS[stamp] = Describer(dictionaries)
        describer = _DESCRIBERS[stamp]
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                new, garbled = describer.restore_lines(row[-1])
                if garbled:
                    rows.append((*row[:-1], new, new != row[-1] and not LOST.search(new)))
            yield pd.DataFrame(rows, columns=names)

    return records.select(*keys, text).where(F.col(text).isNotNull()).mapInPandas(run, schema)


def text_records(headers: DataFrame, messages: DataFrame, addresses: DataFrame) -> DataFrame:
    """field_name, rec_id, text: subjects, bodies and display names."""
    subject = headers.where(F.lower("hname") == "subject").select(F.lit("subject").alias("field_name"), F.col("msg_id").alias("rec_id"), F.col("decoded").alias("text"))
    body = messages.select(F.lit("body").alias("field_name"), F.col("msg_id").alias("rec_id"), F.col("body").alias("text"))
    name = addresses.select(F.lit("display_name").alias("field_name"), F.col("addr_id").alias("rec_id"), F.col("display_name").alias("text"))
    return subject.unionByName(body).unionByName(name)


def garbled_records(headers: DataFrame, messages: DataFrame, addresses: DataFrame, sample: int | None = None) -> DataFrame:
    """field_name, rec_id, restored, is_restored of every garbled subject, body and display name; repeated records count once.

    The usual pairs of characters, and the words that the zstandard dictionaries are made from, are counted over all
    records. Who wants it cheaper gives `sample`: then the dictionaries alone are made from so many texts of each field,
    whole, chosen by a hash. Suspicious records are spread by a hash of their keys before they are looked at, as they cost
    much and may lie together.
    """
    records = text_records(headers, messages, addresses).where(F.col("text").isNotNull())
    counted = count_texts(spread(records.select(F.when(F.col("field_name") == "display_name", "names").otherwise("").alias("source"), "text")))
    known = _usual(counted, USUAL_SHARE)
    if sample is None:
        dictionaries = counted_dictionaries(counted, known)
    else:
        texts = _sample(messages, "msg_id", "body", sample) + _sample(headers.where(F.lower("hname") == "subject"), "msg_id", "decoded", sample)
        dictionaries = train_dictionaries(texts, _sample(addresses, "addr_id", "display_name", sample), known=known)
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), records.sparkSession.sparkContext.defaultParallelism)
    some = records.where(suspicious(F.col("text"))).repartition(tasks, "field_name", "rec_id", F.xxhash64("text")).dropDuplicates()
    return restore_texts(some, dictionaries, ["field_name", "rec_id"], "text").dropDuplicates(["field_name", "rec_id", "restored"])
