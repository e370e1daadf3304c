"""Kernels as UDFs that are made when they are first used: a schema in text needs a running session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def kernel_udf(schema: str) -> Callable:
    """An Arrow-batched UDF with this schema."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap
