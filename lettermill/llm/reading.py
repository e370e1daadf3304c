"""Reading level of documents by smoothed unigram language models, one for each band.

The models are trained on the documents that raters have labelled: at most `sample` of them, taken by a hash of
their id. A document gets the band whose model gives its prose the highest posterior likelihood.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.llm.wikitext import WORD, is_redirect, plain

# Frequent function words by language, without those that English shares.
ENGLISH = frozenset(
    "the of and to is was it for with as on by at from that this which are were has have had be been its they their there but not or an if when can you we he she his her will would who what some many most more into than then after before about between during".split()
)
FOREIGN = frozenset(
    (
        "der die das und ist ein eine einer eines im den dem des mit von auf nach aus zu wird wurde wurden hat etwa für bei sich auch nicht "
        "le la les des du un une et est dans en sur pour par avec au aux qui que sont été ses son cette il elle "
        "el los las una y es del con por para su como más fue al lo "
        "o os as um uma e do da dos das em no na nos nas com foi são ao à mais seu sua "
        "w z i na do się nie jest oraz od po jako przez który która które ma latach roku wieś "
        "и в на с по из от за не что как был была было были к у о его году году человек "
        "il di che è una gli nel della per sono het een van op te dat en och att som på av är och det"
    ).split()
) - ENGLISH
_ASIAN = range(0x3040, 0xD7B0)
#: A line counts as English if function words of English are more than those of other languages and this share of its words.
LEAST_SHARE = 0.08


def english_words(text: str | None, least: int = 80) -> list[str] | None:
    """The words of a text's English prose, or null if these are fewer than `least` or not most of its prose."""
    if not text or is_redirect(text):
        return None
    english, total = [], 0
    for line in plain(text, headings=False).lower().split("\n"):
        if line and not line.lstrip().startswith(("|", "!", "{|")):
            found = WORD.findall(line)
            if not found:
                continue
            own = sum(map(ENGLISH.__contains__, found))
            other = sum(map(FOREIGN.__contains__, found)) if own < 0.2 * len(found) else 0
            asian = sum(ord(c) in _ASIAN for c in line) if not line.isascii() and own < 0.05 * len(found) else 0
            total += len(found) + asian
            if own > other and own >= LEAST_SHARE * len(found) and not asian > len(found):
                english += found
    return english if len(english) >= least and 2 * len(english) > total else None


def _labelled(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Text and band of at most `sample` labelled documents: the median of the raters that gave a band; halves go down."""
    bands = labels.where(F.col("reading_band").between(1, 4)).groupBy("doc_id").agg(F.percentile_approx("reading_band", 0.5).alias("band"))
    chosen = bands.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers: a broadcast of proven size.
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "band")


def train_levels(documents: DataFrame, labels: DataFrame, sample: int = 20_000, smoothing: float = 0.5) -> tuple[dict[str, int], np.ndarray]:
    """Word to row, and the log-probabilities by band of each row; the last row is that of unknown words.

    Counts are made where the documents lie and added up by Spark. Every word of the labelled documents counts; their
    number, and with it the words that reach the driver, is bounded by `sample`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[int, Counter] = {}
            for text, band in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                if ws := english_words(text):
                    counts.setdefault(int(band), Counter()).update(ws)
            yield pd.DataFrame([(w, b, n) for b, c in counts.items() for w, n in c.items()], columns=["word", "band", "n"])

    counted = _labelled(documents, labels, sample).mapInPandas(run, "word string, band int, n bigint")
    by_word = counted.groupBy("word").agg(*(F.sum(F.when(F.col("band") == b, F.col("n")).otherwise(0)).alias(f"n{b}") for b in (1, 2, 3, 4)))
    rows = by_word.toPandas().sort_values("word", ignore_index=True)
    if rows.empty:
        return {}, np.zeros((1, 4))
    n = rows[["n1", "n2", "n3", "n4"]].to_numpy(float)
    n = np.vstack([n, np.zeros(4)]) + smoothing
    return {w: i for i, w in enumerate(rows["word"])}, np.log(n / n.sum(axis=0))


def reading_levels(documents: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 80) -> DataFrame:
    """`doc_id` and `reading_band` (1 to 4) of each document with at least `least` words of English prose.

    The prior over bands is flat. Null and empty texts, redirects, stubs and pages in other languages give no row;
    without any usable label nothing can be assigned and the result is empty. Repeated rows count once.
    """
    words_of, levels = train_levels(documents, labels, sample)
    schema = T.StructType([documents.schema["doc_id"], T.StructField("reading_band", T.IntegerType())])
    unknown = len(levels) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = words_of.get
        for batch in batches:
            out = []
            for k, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                if words_of and (ws := english_words(text, least)):
                    rows = np.fromiter((get(w, unknown) for w in ws), np.int64, len(ws))
                    # Words that no label has seen say nothing about the band.
                    score = levels[rows[rows != unknown]].sum(axis=0)
                    out.append((k, int(score.argmax()) + 1))
            yield pd.DataFrame(out, columns=schema.fieldNames()).astype({"reading_band": "int32"})

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, schema).dropDuplicates()
