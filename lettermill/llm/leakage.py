"""Evaluation texts that stand in training texts, by a distributed positional inverted index.

A passage counts if at least `least` words of an item stand in a document in their order and at most one word in
`one_in` is changed, added or dropped. Let a passage have m words that stand and E edits; E is at most m / (one_in - 1).
Then, without looking at every pair, the search is exact:

* The m words fall into at most E + 1 runs, so at least m - 2 (E + 1) of them begin three neighbouring words of the
  item that are neighbours in the document (`need` for the shortest passage, 6 of 16 words), and these begin within
  m + E words. `_span` has the proof that `need` of them always lie within `span` words. Postings are kept where that
  is so for words of any item, and around it as far as a passage reaches; no passage lies elsewhere.
* The longest run has at least m / (E + 1) words, more than one_in - 2 of them: with one edit in five, four. So every
  passage holds an exact phrase of four neighbouring words of the item; it is looked up from the rarest of the four.
* A passage of 2 * least words or more can be cut at one of these into two, and if neither were a passage, both had too
  many edits and so had the whole. So it is enough to find those of fewer words (`_reach`): with 16 words and one edit
  in five they have at most 31 words, 7 edits and 38 words of the item, and lie on 8 neighbouring diagonals (place in the
  document less place in the item).

The index has one posting list for each term and document: the positions of the term. The lists are written once and
come together by document; a phrase starts from the list of its rarest term, and the lists of its other terms, adjusted
by their offsets, are intersected with it one after the other, the rarest first. The exact test for passages then runs
on the lists around what is left, for the items left there. Items are taken in blocks of bounded size as they are read; each block is one pass over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lettermill.llm.wikitext import WORD, plain
from lettermill.session import materialise

#: Words of items in one block; bounds what is sent to every executor.
BLOCK_WORDS = 2_000_000


def words(text: str) -> list[str]:
    """Words of a text in lower case; markup, references, comments, punctuation and invisible characters do not count."""
    return WORD.findall(plain(text, quotes=True).lower().replace("’", "'"))


def _span(least: int, one_in: int) -> tuple[int, int]:
    """(need, span): every passage has `need` grams of three words that begin within `span` words.

    A passage of m words has t = ceil(m - 2 (m / (one_in - 1) + 1)) of them at least, within w = m one_in / (one_in - 1)
    words. If any `need` neighbours of these took more than `span` words, all would take more than
    span * ((t - 1) // (need - 1)) words; so a span of w over that number, for the m where it is largest, suffices.
    """
    edits = one_in - 1
    need = max(1, least - 2 * (least // edits + 1))
    if need == 1:
        return 1, 1
    span = 0
    for m in range(least, 2 * least):
        t = m - (2 * m) // edits - 2
        span = max(span, m * one_in // edits // max(1, (t - 1) // (need - 1)))
    return need, span


def _reach(least: int, one_in: int) -> tuple[int, int]:
    """(edits, words) that the shortest passages have at most: words of the item or of the document between their ends."""
    most = 2 * least - 1
    edits = most // (one_in - 1)
    return edits, most + edits


def gram_regions(positions: np.ndarray, starts: np.ndarray, need: int, span: int, margin: int) -> np.ndarray:
    """Which of the sorted `positions` lie within `margin` of a window of `need` of the sorted `starts` that spans at most `span` words."""
    keep = np.zeros(len(positions), bool)
    if len(starts) < need:
        return keep
    first = np.flatnonzero(starts[need - 1 :] - starts[: len(starts) - need + 1] <= span)
    if len(first):
        change = np.zeros(len(positions) + 1, np.int32)
        np.add.at(change, np.searchsorted(positions, starts[first] - margin, "left"), 1)
        np.add.at(change, np.searchsorted(positions, starts[first + need - 1] + margin, "right"), -1)
        keep = np.cumsum(change[:-1]) > 0
    return keep


def _bands(bits: dict[int, int], least: int, one_in: int) -> list[set[int]]:
    """Groups of neighbouring diagonals in which a passage can lie: where on some of the number that edits allow so many item words are hit as one has."""
    edits, most = _reach(least, one_in)
    needs = [(max(least, -(-length * (one_in - 1) // one_in)), (1 << length) - 1) for length in range(least, most + 1)]
    groups: list[set[int]] = []
    for line in sorted(bits):
        hits = 0
        for d in range(line, line + edits + 1):
            hits |= bits.get(d, 0)
        if hits.bit_count() < least:
            continue
        rest, low = hits, 0
        while rest.bit_count() >= least:
            step = (rest & -rest).bit_length() - 1
            rest, low = rest >> step, low + step
            if any((rest & mask).bit_count() >= need for need, mask in needs):
                band = {d for d in range(line, line + edits + 1) if d in bits}
                if groups and groups[-1] & band:
                    groups[-1] |= band
                else:
                    groups.append(band)
                break
            rest, low = rest >> 1, low + 1
    return groups


def holds_passage(where: dict[int, list[int]], terms: list[int], positions: list[int], least: int, one_in: int) -> bool:
    """Whether at least `least` words of an item stand in order among the postings, with at most one in `one_in` edits.

    `where` gives the offsets of each term in the item.
    """
    lines: dict[int, list[tuple[int, int]]] = defaultdict(list)
    bits: dict[int, int] = defaultdict(int)
    for t, p in zip(terms, positions, strict=True):
        for i in where.get(t, ()):
            lines[p - i].append((p, i))
            bits[p - i] |= 1 << i
    for band in _bands(bits, least, one_in):
        # On one diagonal: the common case, a passage with words changed but none added or dropped.
        for d in band:
            if len(lines[d]) >= least:
                hits = np.array([i for _, i in lines[d]])
                value = hits + 1 - one_in * (hits + 1 - np.arange(1, len(hits) + 1))
                best = np.minimum.accumulate(hits - one_in * (hits - np.arange(len(hits))))
                if (value[least - 1 :] >= best[: len(hits) - least + 1]).any():
                    return True
        if _chain(sorted(x for d in band for x in lines[d]), least, one_in):
            return True
    return False


def _chain(pairs: list[tuple[int, int]], least: int, one_in: int) -> bool:
    """Whether some chain of `least` pairs or more has item words enough for its edits. best[m] is the best sum of item words
    less one_in times edits over chains of m matches (the last slot: or more)."""
    gap = one_in + 3
    best = [[-(10**6)] * (least + 1) for _ in pairs]
    low = 0
    for k, (p, i) in enumerate(pairs):
        mine = best[k]
        mine[1] = 1
        while pairs[low][0] < p - gap:
            low += 1
        for q in range(low, k):
            pp, ii = pairs[q]
            di, dp = i - ii, p - pp
            if 0 < di <= gap and dp > 0:
                gain = di - one_in * max(di - 1, dp - 1)
                theirs = best[q]
                for m in range(1, least + 1):
                    if (v := theirs[m]) > -(10**5):
                        n = m + 1 if m < least else least
                        if v + gain > mine[n]:
                            mine[n] = v + gain
        if mine[least] >= 0:
            return True
    return False


class Grams:
    """Three neighbouring words of items as numbers: of all items, and of each."""

    def __init__(self, items: list[list[int]], least: int, one_in: int):
        self.base = 1 + max((max(ws) for ws in items), default=0)
        self.of = [np.unique(self._number(np.array(ws, np.int64))) for ws in items]
        self.all = np.unique(np.concatenate(self.of)) if self.of else np.zeros(0, np.int64)
        self.need, self.span = _span(least, one_in)

    def _number(self, terms: np.ndarray) -> np.ndarray:
        return (terms[:-2] * self.base + terms[1:-1]) * self.base + terms[2:]

    def starts(self, terms: np.ndarray, positions: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Positions at which grams of `mine` begin, among terms at sorted positions."""
        if len(terms) < 3 or not len(mine):
            return np.zeros(0, np.int64)
        terms, positions = terms.astype(np.int64), positions.astype(np.int64)
        together = positions[2:] - positions[:-2] == 2
        grams, at = self._number(terms)[together], positions[:-2][together]
        place = np.minimum(np.searchsorted(mine, grams), len(mine) - 1)
        return at[mine[place] == grams]

    def likely(self, terms: np.ndarray, positions: np.ndarray, some: list[int], margin: int) -> Iterator[tuple[int, np.ndarray]]:
        """Those of the items `some` of which enough grams begin near each other, with the postings around these."""
        for n in some:
            if self.need < 2:
                yield n, np.ones(len(terms), bool)
                continue
            near = gram_regions(positions, self.starts(terms, positions, self.of[n]), self.need, self.span, margin)
            if near.any():
                yield n, near


def _blocks(items: Iterator[tuple[object, list[str]]]) -> Iterator[list[tuple[object, list[str]]]]:
    block, size = [], 0
    for item in items:
        block.append(item)
        size += len(item[1])
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


#: A text of a document: repeated rows are one text, different ones under one key are several.
_DOCUMENT = ["_key", "_text"]


def positional_index(documents: DataFrame, key: str, text: str, vocabulary: dict[str, int], grams: Grams, margin: int) -> DataFrame:
    """Posting lists `_key`, `_text` (hash of the text), `term`, `positions` of the vocabulary, where passages can lie: one row for each term of a text."""
    schema = T.StructType([T.StructField("_key", documents.schema[key].dataType), T.StructField("_text", T.LongType()), T.StructField("term", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for batch in batches:
            at, terms, offsets, flat = [], [], [0], []
            for n, body in enumerate(batch.column(2).to_pylist()):
                every = np.array(list(map(find, words(body), repeat(-1))), np.int32)
                positions = np.flatnonzero(every >= 0)
                there = every[positions]
                if grams.need > 1:
                    keep = gram_regions(positions, grams.starts(there, positions, grams.all), grams.need, grams.span, margin)
                    there, positions = there[keep], positions[keep]
                if not len(there):
                    continue
                order = np.argsort(there, kind="stable")
                there, positions = there[order], positions[order]
                cuts = np.flatnonzero(np.diff(there, prepend=-1))
                at += [n] * len(cuts)
                terms += there[cuts].tolist()
                offsets += (offsets[-1] + np.append(cuts[1:], len(there))).tolist()
                flat.append(positions)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), pa.array(terms, pa.int32()), lists], names=schema.fieldNames())

    texts = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.xxhash64(text).alias("_text"), text)
    return texts.mapInArrow(run, schema).dropDuplicates([*_DOCUMENT, "term"])


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 16, one_in: int = 5
) -> DataFrame:
    """`doc_key`, `item_key`: each document and item where a passage of the item stands in the document, once.

    Null and empty texts hold nothing; items of fewer than `least` words cannot leak; rows without a key give no row. Repeated
    rows count once, different texts under one key each by itself. The items are a stated test set: the driver reads them one after the other and sends them
    out in blocks of BLOCK_WORDS words. Other columns are dropped.
    """
    spark = documents.sparkSession
    schema = T.StructType([documents.schema[doc_key], items.schema[item_key]])
    rows = items.select(item_key, item_text).where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).distinct().orderBy(item_key, item_text).toLocalIterator()
    long_enough = ((r[0], ws) for r in rows if len(ws := words(r[1])) >= least)
    found = [_block_leaks(documents, block, doc_key, doc_text, schema, least, one_in) for block in _blocks(long_enough)]
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found).dropDuplicates()


Phrase = tuple[int, int, list[tuple[int, int]]]


def phrases_from(ids: list[list[int]], df: dict[int, int], run: int) -> dict[int, list[Phrase]]:
    """For each term the phrases of `run` neighbouring words of which it is the rarest: item, place of the term, and the
    other terms with their places less that, the rarest first. A phrase with a term that no document has is left out."""
    seeds: dict[int, list[Phrase]] = defaultdict(list)
    for n, ws in enumerate(ids):
        for phrase in sorted({tuple(ws[low : low + run]) for low in range(len(ws) - run + 1)}):
            if all(t in df for t in phrase):
                first, *rest = sorted(range(run), key=lambda i: (df[phrase[i]], i))
                seeds[phrase[first]].append((n, first, [(phrase[i], i - first) for i in rest]))
    return dict(seeds)


def phrase_items(lists: dict[int, list[int]], seeds: dict[int, list[Phrase]]) -> set[int]:
    """Items of which a phrase stands in the document of these posting lists."""
    found: set[int] = set()
    sets: dict[int, set[int]] = {}
    for term, begin in lists.items():
        for n, _, others in seeds.get(term, ()):
            if n in found or others[0][0] not in lists:
                continue
            now = begin
            for other, by in others:
                if other not in lists:
                    now = ()
                    break
                if other not in sets:
                    sets[other] = set(lists[other])
                there = sets[other]
                now = [p for p in now if p + by in there]
                if not now:
                    break
            if now:
                found.add(n)
    return found


def _block_leaks(documents: DataFrame, block: list, doc_key: str, doc_text: str, schema: T.StructType, least: int, one_in: int) -> DataFrame:
    spark = documents.sparkSession
    vocabulary: dict[str, int] = {}
    keys = [k for k, _ in block]
    ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in ws] for _, ws in block]
    margin = _reach(least, one_in)[1]
    grams = Grams(ids, least, one_in)
    postings = materialise(positional_index(documents, doc_key, doc_text, vocabulary, grams, margin), "postings")

    # How many documents hold each term: at most one row for each word of the block.
    df = dict(postings.groupBy("term").agg(F.count("*").alias("n")).toPandas().itertuples(index=False, name=None))
    run = -(-least // (least // (one_in - 1) + 1))
    seeds = phrases_from(ids, df, run)
    offsets: list[dict[int, list[int]]] = []
    for ws in ids:
        at: dict[int, list[int]] = {}
        for i, t in enumerate(ws):
            at.setdefault(t, []).append(i)
        offsets.append(at)

    def held(lists: dict[int, list[int]]) -> Iterator[int]:
        some = sorted(phrase_items(lists, seeds))
        if not some:
            return
        terms = np.repeat(list(lists), [len(x) for x in lists.values()])
        positions = np.concatenate([np.asarray(x) for x in lists.values()])
        order = np.argsort(positions, kind="stable")
        terms, positions = terms[order], positions[order]
        for n, near in grams.likely(terms, positions, some, margin):
            if holds_passage(offsets[n], terms[near].tolist(), positions[near].tolist(), least, one_in):
                yield n

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, {}
        docs: list[object] = []
        items: list[object] = []

        def finish() -> None:
            for n in held(lists):
                docs.append(now[0])
                items.append(keys[n])

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(docs, kinds[0]), pa.array(items, kinds[1])], names=schema.fieldNames())
            docs.clear()
            items.clear()
            return out

        for batch in batches:
            for key, text, term, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, text) != now:
                    finish()
                    now, lists = (key, text), {}
                lists[term] = positions
            yield taken()
        finish()
        yield taken()

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    # Few bytes, much work for each: the number of tasks follows the cluster, not the bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(tasks, *_DOCUMENT).sortWithinPartitions(*_DOCUMENT).mapInArrow(verify, schema)
