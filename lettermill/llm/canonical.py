"""Freely typed values mapped to a list of canonical entries.

Each distinct value is cleaned and split into tokens. Every token is joined with the vocabulary of the list by edit
distance: an index of pieces of the vocabulary's terms, bounded with the list and kept by each worker, gives the terms
of which a piece is left whole, and these are compared exactly. The repaired tokens are put together by soft TF-IDF,
which ranks the entries and chooses; the slips of the whole value only bound what it may choose. Values are handled
once, however many rows have them, so frequent values make no hot group.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The list is sent to every executor; a longer one needs another design and is refused.
MAX_ENTRIES = 200_000
# Letters and digits that look like a letter of the Latin alphabet.
_CYRILLIC = dict(zip("авекмнорстухіјѕԁһӏ", "abekmhopctyxijsdhl", strict=True))
_GREEK = dict(zip("αορυνικτχε", "aopuviktxe", strict=True))
LOOK_ALIKES = str.maketrans(_CYRILLIC | _GREEK | {"ı": "i", "‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-", "。": ".", "．": ".", "․": ".", "，": ","})
_STRAY = re.compile(r"^(?:[a-z][a-z0-9+.-]*://|mailto:)?(?:www\d?\.)?", re.I)


def clean(value: str) -> str:
    """A host without case, stray marks, scheme, port, path and look-alike letters; commas and blanks between labels are dots."""
    text = unicodedata.normalize("NFKC", value)
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc", "Mn")).lower().translate(LOOK_ALIKES).strip()
    text = re.sub(r"\s*[.,;:]+\s*(?!//)", lambda m: ":" if ":" in m.group() else ".", text)
    text = _STRAY.sub("", text.strip(" \t<>\"'`()[]{}@.,;:|*_~!?#"))
    text = re.sub(r"[/?#:].*$", "", text)
    text = re.sub(r"\s+", ".", text)
    return re.sub(r"\.{2,}", ".", text).strip("<>\"'`()[]{}@.,;:|*_~!?#-. ")


def tokens(cleaned: str) -> list[str]:
    return [t for t in re.split(r"[.\-_@]+", cleaned) if t]


def slips_allowed(length: int) -> int:
    """Slips of the keyboard that a token or value of this length may have."""
    return 0 if length < 2 else 1 if length < 5 else 2


def slips(a: str, b: str, most: int) -> int:
    """Characters changed, added, dropped or exchanged with their neighbour (each once); most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, line = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(line[j] + 1, new[j - 1] + 1, line[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, line = line, new
    return line[-1]


def term_slips(length: int) -> int:
    """Slips that a term of the vocabulary may have suffered in a token."""
    return slips_allowed(length) + (length > 8)


#: Score, of 1, that an entry needs to be meant.
LEAST_SCORE = 0.5


class Entries:
    """The canonical list with its variants, weights and indexes.

    A variant is a way in which an entry is split when marks between its words are lost: as written, its first label
    joined, the first two labels joined, all joined, or its first label alone.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.names = {i: clean(h) for i, h in rows}
        first = Counter(n.partition(".")[0] for n in self.names.values())
        self.variants: dict[int, list[tuple[list[str], bool]]] = {i: self._split(n, first) for i, n in self.names.items()}
        spread = Counter(t for vs in self.variants.values() for t in {t for ts, _ in vs for t in ts})
        self.idf = {t: math.log(1 + len(rows) / n) for t, n in spread.items()}
        self.unknown = math.log(1 + len(rows))
        # Terms that lead to entries: those of the first label.
        self.entries_of: dict[str, set[int]] = defaultdict(set)
        for i, vs in self.variants.items():
            for ts, _ in vs:
                label = tokens(self.names[i].partition(".")[0])
                for t in ts:
                    if t not in self.names[i].split(".")[1:] and (len(t) > 3 or len(label) == 1):
                        self.entries_of[t].add(i)
        # Pieces of terms by the term's length, the piece's place and the piece: of 2n + 1 pieces n slips leave one whole,
        # as an exchange of neighbours can harm two.
        self.pieces: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        self.cuts: dict[int, list[tuple[int, int]]] = {}
        for t in sorted(self.idf):
            if len(t) not in self.cuts:
                n = min(len(t), 2 * term_slips(len(t)) + 1)
                edges = [len(t) * k // n for k in range(n + 1)]
                self.cuts[len(t)] = list(zip(edges, edges[1:], strict=False))
            for low, high in self.cuts[len(t)]:
                self.pieces[len(t), low, t[low:high]].append(t)
        self.most = max((term_slips(n) for n in self.cuts), default=0)
        self.memo: dict[str, dict[str, float]] = {}

    @staticmethod
    def _split(name: str, first: Counter) -> list[tuple[list[str], bool]]:
        labels = name.split(".")
        head = tokens(labels[0])
        rest = [t for x in labels[1:] for t in tokens(x)]
        later = [t for x in labels[2:] for t in tokens(x)]
        ways = [head + rest, ["".join(head), *rest], ["".join(head) + "".join(tokens("".join(labels[1:2]))), *later], ["".join(head + rest)]]
        out = [(w, False) for w in ways if w and w != [""]]
        if first[labels[0]] == 1:  # a first label that several entries have means none of them
            out += [(head, True), (["".join(head)], True)]
        return [x for k, x in enumerate(out) if x not in out[:k]]

    def repairs(self, token: str) -> dict[str, float]:
        """Terms of the vocabulary within their number of slips of the token, with their likeness."""
        if (known := self.memo.get(token)) is not None:
            return known
        near: set[str] = set()
        for length in range(max(1, len(token) - self.most), len(token) + self.most + 1):
            allowed = term_slips(length)
            if length not in self.cuts or abs(length - len(token)) > allowed:
                continue
            for low, high in self.cuts[length]:
                for at in range(max(0, low - allowed), min(len(token) - (high - low), low + allowed) + 1):
                    near.update(self.pieces.get((length, low, token[at : at + high - low]), ()))
        out = {}
        for term in near:
            allowed = term_slips(len(term))
            if (n := slips(token, term, allowed)) <= allowed:
                out[term] = 1.0 - n / max(len(token), len(term))
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[token] = out
        return out

    def score(self, repaired: list[dict[str, float]], variant: list[str]) -> float:
        """Soft TF-IDF of a value and a variant: each of its terms counts with its best repaired match; 1 if all are met exactly."""
        total = 0.0
        weights = [self.idf[t] for t in variant]
        for term, w in zip(variant, weights, strict=True):
            total += w * w * max((r[term] for r in repaired if term in r), default=0.0)
        terms = set(variant)
        norm = 0.0
        for r in repaired:  # a token is worth the term of the variant that it repairs to, else its best known one
            mine = [t for t in r if t in terms]
            norm += max((self.idf[t] for t in mine or r), default=self.unknown) ** 2
        return total / (math.sqrt(sum(w * w for w in weights)) * math.sqrt(norm) or 1.0)

    def decide(self, cleaned: str) -> int:
        """The entry that is meant, or -1: of those that a repaired token leads to and that the slips of the whole value
        allow, the one of the best score, if that is LEAST_SCORE; of equal scores that of the fewest slips, then the lowest id."""
        repaired = [self.repairs(t) for t in tokens(cleaned)]
        best = None
        for i in {i for r in repaired for term in r for i in self.entries_of.get(term, ())}:
            name = self.names[i]
            if cleaned.endswith("." + name):  # a host below an entry is another host
                continue
            most = max(1, min(3, len(name) // 5))
            n = slips(cleaned, name, most)
            for variant, alone in self.variants[i]:
                # A first label that stands alone is meant as it is; anything else may have slips.
                if (cleaned != name.partition(".")[0]) if alone else n > most:
                    continue
                rank = (-round(self.score(repaired, variant), 9), n, i)
                best = min(best or rank, rank)
        return best[2] if best and -best[0] >= LEAST_SCORE else -1


_ENTRIES: dict[int, Entries] = {}


def match_values(df: DataFrame, value: str, entries: DataFrame, entry_id: str, entry_name: str) -> DataFrame:
    """`value` and `entry_id` for each distinct value that is not null, blank or an entry itself; -1 if no entry is meant.

    The list is a fixed reference of at most MAX_ENTRIES entries; an empty list gives -1 throughout. Values and tokens
    may be of any length. Each distinct value is read, repaired and ranked where it lies; the one shuffle makes values
    distinct. Other columns are dropped first.
    """
    listed = sorted((r[0], r[1]) for r in entries.select(entry_id, entry_name).where(F.col(entry_name).isNotNull() & F.col(entry_id).isNotNull()).limit(MAX_ENTRIES + 1).collect())
    if len(listed) > MAX_ENTRIES:
        raise ValueError("the list of entries is too long to be sent to every executor")
    exact = sorted({h for _, h in listed})
    stamp = hash(tuple(listed))
    named = df.select(value).where(F.col(value).isNotNull() & (F.regexp_replace(value, r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+", "") != ""))
    # Few bytes, much work for each: the number of tasks follows the cluster, not the bytes.
    spark = df.sparkSession
    distinct = named.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), value).distinct()

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if stamp not in _ENTRIES:
            _ENTRIES.clear()
            _ENTRIES[stamp] = Entries(listed)
        known, same = _ENTRIES[stamp], frozenset(exact)
        for batch in batches:
            rows = [(v, known.decide(clean(v))) for v in batch[value] if v not in same]
            yield pd.DataFrame({value: [v for v, _ in rows], entry_id: pd.Series([i for _, i in rows], dtype="int32")})

    return distinct.mapInPandas(rank, f"`{value}` string, `{entry_id}` int")


def canonical_hosts(addresses: DataFrame, hosts: DataFrame) -> DataFrame:
    """`addr_id`, `host_id` of each address whose typed host is not null, blank or in the list; -1 where no entry is meant.

    Repeated rows count once. The values are matched once each and joined back; rows of a very frequent value are
    split by Spark's skew join, as the other side has one row for it.
    """
    matched = match_values(addresses, "hostname", hosts, "host_id", "hostname")
    return addresses.select("addr_id", "hostname").join(matched, "hostname").select("addr_id", F.col("host_id")).dropDuplicates()
