"""The kernels as SQL functions. The native ones are Columns and have no SQL name of their own; SQL says them directly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lettermill.kernels import address as K
from lettermill.kernels.encodedword import decode_words
from lettermill.types import ADDRESS, ADDRESS_LIST, PARSED

_FIELDS = [f.split()[0] for f in ADDRESS.split(", ")]


def register(spark: SparkSession) -> list[str]:
    """Register `mail_address`, `mail_address_list`, `mail_decode`, `mail_quote`, `mail_unquote`, `mail_ace_host` and `mail_parse`; returns the names."""
    from lettermill.functions.messages import _part
    from lettermill.kernels.scan import parse_message

    def address(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.parse(t) or (None,) * len(_FIELDS) for t in texts], columns=_FIELDS).astype(object)

    def address_list(texts: pd.Series) -> pd.DataFrame:
        found = [K.parse_discrete_list(t) for t in texts]
        return pd.DataFrame([([dict(zip(_FIELDS, a, strict=True)) for a in good], bad, error) for good, bad, error in found], columns=["parsed", "unparsed", "error"])

    def message(texts: pd.Series) -> pd.DataFrame:
        found = [parse_message(t) for t in texts]
        return pd.DataFrame([(None if rows is None else [_part(p) for p in rows], error, parser) for rows, error, parser in found], columns=["parts", "error", "parser"])

    def decode(values: pd.Series) -> pd.Series:
        return values.map(decode_words, na_action="ignore")

    def quote(values: pd.Series) -> pd.Series:
        return values.map(K.smart_quote, na_action="ignore")

    def unquote(values: pd.Series) -> pd.Series:
        return values.map(K.smart_unquote, na_action="ignore")

    def ace_host(values: pd.Series) -> pd.Series:
        return values.map(K.ace_host, na_action="ignore")

    made = {
        "mail_address": (address, ADDRESS), "mail_address_list": (address_list, ADDRESS_LIST), "mail_parse": (message, PARSED), "mail_decode": (decode, "string"),
        "mail_quote": (quote, "string"), "mail_unquote": (unquote, "string"), "mail_ace_host": (ace_host, "string"),
    }
    for name, (f, schema) in made.items():
        spark.udf.register(name, F.pandas_udf(f, schema))
    return list(made)
