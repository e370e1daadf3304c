"""Several values packed in one field: one row for each value, with its position.

The text is split on quote characters. Odd pieces are literals: their delimiters are masked. Even pieces are
code: they are split on delimiters, and array folds put the pieces together again and number the values. All of
it is built-in expressions, so it stays in the JVM, needs no shuffle and has no state across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that mean something in code and nothing in a literal, and what masks them (private use area).
_SPECIAL = ",;|@<>:() "
_MASKED = "".join(chr(0xE010 + i) for i in range(len(_SPECIAL)))
_ESC_QUOTE, _ESC_BACKSLASH = "\ue001", "\ue002"
#: A value: a URL as it stands, or local@host; both are written over masked text.
_URL = r"[Hh][Tt][Tt][Pp][Ss]?://[^\s<>,;|\"]+"
# A local part begins where a word begins and its loops don't go back, so that a word of any length is read once.
_ADDRESS = r"(?:\"[^\"]*+\"|(?<![^\s<>@,;|\"():])[^\s<>@,;|\"():]++)@(?:\[[^\]\s]*+\]|[^\s<>@,;|\"()]++)"


def split_literals(text: Column) -> Column:
    """`text` with what stands in quotes masked, so that a delimiter in it no longer splits.

    A literal that itself holds addresses and is neither followed by a bracket nor by `@` is a whole list that
    someone put in quotes; it is code. Unbalanced quotes: the last piece is code.
    """
    pieces = F.split(text, '"', -1)
    # Each piece with its neighbours; the last has none after it. Made once, not once for each piece.
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), pieces), pieces, F.slice(pieces, 2, 1 << 30))

    def piece(z: Column, i: Column) -> Column:
        before, p, after = z["0"], z["1"], z["2"]
        odd = (i % 2 == 1) & after.isNotNull()
        listed = p.contains("@") & after.rlike(r"^\s*(?:[,;|]|$)") & before.rlike(r"(?:^|[,;|:])\s*$")
        masked = F.concat(F.lit('"'), F.translate(p, _SPECIAL, _MASKED), F.lit('"'))
        return F.when(odd & ~listed, masked).otherwise(p)

    return F.array_join(F.transform(zipped, piece), "")


def _prepared(raw: Column) -> Column:
    text = F.regexp_replace(raw, r"\r?\n[ \t]*|\r", " ")
    text = F.regexp_replace(text, r"\\\\", _ESC_BACKSLASH)
    text = F.regexp_replace(text, r'\\"', _ESC_QUOTE)
    # Single quotes quote a name only where one begins, and before a bracket; elsewhere they are apostrophes. The pattern
    # looks for a name of up to 256 characters, so its work does not grow with the square of the text.
    text = F.regexp_replace(text, r"(^|[,;|>]\s*+)'([^\"<>@]{0,256}?)'(?=\s*+<)", '$1"$2"')
    # Comments go, but not what looks like one inside quotes.
    # The loops are possessive: others recurse in Java for each character of a comment.
    text = F.regexp_replace(text, r'("[^"]*+")|\((?:[^()"]++|"[^"]*+")*+\)', "$1")
    text = split_literals(text)
    # The name of a group and a route are no values.
    text = F.regexp_replace(text, r"(^|[,;|])[^,;|:@<>]*:(?!//)", "$1")
    return F.regexp_replace(text, r"<\s*@[^<>:]*:", "<")


def packed_values(raw: Column) -> Column:
    """array<string>: the values of one field, in order. Null gives null; a text without a value an empty array."""
    fragments = F.split(_prepared(raw), r"[,;|]+")

    def values(fragment: Column) -> Column:
        bracketed = F.regexp_extract_all(fragment, F.lit(rf"<\s*({_URL}|{_ADDRESS})\s*>"), F.lit(1))
        bare = F.regexp_extract_all(fragment, F.lit(rf"({_URL}|{_ADDRESS})"), F.lit(1))
        return F.when(F.size(bracketed) > 0, bracketed).otherwise(bare)

    clean = lambda v: F.when(v.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://"), v).otherwise(F.lower(v))
    unmask = lambda v: F.translate(
        F.replace(F.replace(v, F.lit(_ESC_QUOTE), F.lit('\\"')), F.lit(_ESC_BACKSLASH), F.lit("\\\\")), _MASKED, _SPECIAL
    )
    return F.transform(F.flatten(F.transform(fragments, values)), lambda v: unmask(clean(v)))


def explode_packed(
    df: DataFrame, raw: str, keys: list[str], value: str = "address", position: str = "vpos", least: int = 2
) -> DataFrame:
    """One row for each value of `raw` in the rows that hold at least `least` values: keys, position, value.

    Rows: null, empty and valueless texts give no row. Repeated input rows count once; equal values of one field
    keep their own positions. Other columns of `df` are dropped, so their names cannot clash.
    The rows are filtered by a cheap test before anything is parsed or shuffled; the only shuffle removes repeated
    rows and carries the keys and short texts alone.
    """
    text = F.col(raw)
    marks = F.length(text) - F.length(F.translate(text, "@", "")) + F.when(text.contains("://"), least).otherwise(0)
    once = df.where(text.isNotNull() & (marks >= least)).select(*keys, raw).dropDuplicates()
    # The array goes through a generator: a filter on it would else be pushed below and the values be made twice.
    found = once.select(*keys, F.explode(F.array(packed_values(text))).alias("_values")).where(F.size("_values") >= least)
    return found.select(*keys, F.posexplode("_values").alias(position, value))
