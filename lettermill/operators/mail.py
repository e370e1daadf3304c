"""Operators on tables of messages: parts, bodies, headers, bounces.

A message is read once, in the Arrow batch where it lies: its parts come out as columns, with their decoded bodies if
these are asked for, so the raw text is neither shuffled nor copied for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.functions import messages as M
from lettermill.functions._udf import kernel_udf
from lettermill.kernels.body import decode_body
from lettermill.kernels.bounce import BOUNCE_HEADERS, NO_REPORT, bounce_report
from lettermill.kernels.encodedword import to_text
from lettermill.kernels.scan import last_boundary, parse_message
from lettermill.types import PART

__all__ = ["BOUNCE_HEADERS", "apply_edits", "attached_message", "detect_bounces", "explode_bodies", "explode_parts"]

_TEXTS = pa.map_(pa.string(), pa.string())
_HEADER = pa.struct([("name", pa.string()), ("raw", pa.string()), ("value", pa.string()), ("params", _TEXTS)])
_ARROW = {
    "part_id": pa.int32(), "parent_id": pa.int32(), "path": pa.list_(pa.int32()), "depth": pa.int32(), "rel": pa.string(), "start": pa.int32(), "end": pa.int32(),
    "body_start": pa.int32(), "main": pa.string(), "sub": pa.string(), "params": _TEXTS, "disposition": pa.string(), "disposition_params": _TEXTS, "encoding": pa.string(),
    "headers": pa.list_(_HEADER), "size": pa.int64(), "text": pa.string(), "data": pa.binary(),
}
_FIELDS = [f for f in _ARROW if f not in ("size", "text", "data")]
#: Characters of raw text after which a batch of parts is given out.
_BATCH_CHARS = 16 << 20


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """The messages of a batch as text; their offsets count characters of it."""
    return (x if isinstance(x, str) else to_text(x) for x in batch.column(1).to_pylist())


def _cleaned(x: object) -> object:
    """Lone surrogates have no place in Arrow text."""
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) and not x.isascii() and any("\ud800" <= c <= "\udfff" for c in x) else x


def _maps(values: list[dict | None]) -> pa.Array:
    return pa.array([None if v is None else [(_cleaned(k), _cleaned(x)) for k, x in v.items()] for v in values], _TEXTS)


def _headers(values: list[list[tuple] | None]) -> pa.Array:
    offsets, flat = [0], []
    for hs in values:
        flat.extend(hs or ())
        offsets.append(len(flat))
    text = [pa.array([_cleaned(h[i]) for h in flat], pa.string()) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([*text, _maps([h[3] for h in flat])], fields=list(_HEADER)))


def _column(name: str, values: list) -> pa.Array:
    if name == "headers":
        return _headers(values)
    if name in ("params", "disposition_params"):
        return _maps(values)
    return pa.array([_cleaned(v) for v in values] if name in ("text", "disposition", "encoding") else values, _ARROW[name])


def _body(text: str, p: tuple) -> tuple[str | None, bytes | None]:
    """The decoded body of a part; multiparts and containers have none."""
    main, sub = p[8], p[9]
    if main == "multipart" or f"{main}/{sub}" in _NO_BODY:
        return None, None
    charset = p[10].get("charset", "ascii" if main == "text" else None)
    return decode_body(text[p[7] : p[6]], p[13], main, sub, charset.lower() if charset else None)


# Parts that hold a message or headers and so have no body of their own.
_NO_BODY = frozenset(["message/rfc822", "message/global", "message/news", "text/rfc822-headers", "message/feedback-report", "message/external-body", "message/disposition-notification"])


def _read(df: DataFrame, key: str, raw: str, fields: list[str], recover: bool, with_enclosed: bool, keep: Callable[[tuple], bool] | None = None) -> DataFrame:
    """key and `fields` of each part of each readable message, in one pass."""
    bodies = "text" in fields or "data" in fields
    wanted = frozenset(fields) | ({"body_start", "encoding"} if bodies else set())
    place = {f: i for i, f in enumerate(_FIELDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns, kept = [], [[] for _ in fields], 0
            for n, text in enumerate(_texts(batch)):
                found = parse_message(text, recover, wanted)[0]
                kept += len(text)
                hidden: set[int] = set()
                for p in found or ():
                    if p[4] == "headers" or p[1] in hidden or (p[4] == "enclosed" and not with_enclosed):
                        hidden.add(p[0])
                        continue
                    if keep is not None and not keep(p):
                        continue
                    body = _body(text, p) if bodies else None
                    at.append(n)
                    for f, column in zip(fields, columns, strict=True):
                        column.append(p[place[f]] if f in place else body[0] if f == "text" else body[1] if f == "data" else len(text[p[5] : p[6]].encode("utf-8", "replace")))
                if kept > _BATCH_CHARS:
                    yield give(batch, at, columns)
                    at, columns, kept = [], [[] for _ in fields], 0
            yield give(batch, at, columns)

    def give(batch: pa.RecordBatch, at: list[int], columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(_column(f, c) for f, c in zip(fields, columns, strict=True))], names=[key, *fields])

    kinds = {f.name: f.dataType for f in T._parse_datatype_string(f"struct<{PART},size:bigint,text:string,data:binary>").fields}
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(f, kinds[f]) for f in fields)])
    return df.select(key, raw).where(F.col(raw).isNotNull()).mapInArrow(run, schema)


def explode_parts(df: DataFrame, key: str, raw: str, recover: bool = False, with_self: bool = True, skip_enclosed: bool = False, fields: list[str] | None = None) -> DataFrame:
    """One row for each part of each message, parents before children: key and the fields of a part (those named in `fields`).

    A null message, or one that cannot be read, gives no row; `parse_errors` lists the latter. Children of headers-only parts
    are not parts. `skip_enclosed` leaves out what lies in enclosed messages. Other columns of `df` are dropped; repeated
    messages count each time. Ask for few fields: header sections are read only for those that need them. `size` is
    the number of bytes of a part as it is written.
    """
    return _read(df, key, raw, fields or _FIELDS, recover, not skip_enclosed, None if with_self else _has_parent)


def _has_parent(p: tuple) -> bool:
    return p[1] is not None


def explode_bodies(df: DataFrame, key: str, raw: str, fields: list[str] | None = None, recover: bool = False, keep: Callable[[tuple], bool] | None = None) -> DataFrame:
    """As `explode_parts`, with the decoded `text` (of text types) or `data` (of others) of each part, without a join.

    `keep` is a test on the tuple of a part's fields, in their order, that is made before its body is decoded.
    """
    return _read(df, key, raw, [*(fields or [f for f in _FIELDS if f != "headers"]), "text", "data"], recover, True, keep)


def parse_errors(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key and the error of each message that cannot be read."""
    return df.select(key, M.parse_mime(F.col(raw)).alias("_m")).where(F.col("_m.error").isNotNull()).select(key, F.col("_m.error").alias("error"))


def attached_message(parts: DataFrame, key: str) -> DataFrame:
    """The first part inside the first enclosed message (not news) of each message."""
    holder = parts.where((F.col("main") == "message") & F.col("sub").isin("rfc822", "global")).groupBy(key).agg(F.min("part_id").alias("parent_id"))
    first = parts.join(holder, [key, "parent_id"]).groupBy(key).agg(F.min("part_id").alias("part_id"))
    return parts.join(first, [key, "part_id"])


def detect_bounces(df: DataFrame, key: str, raw: str, probability: float = 0.3) -> DataFrame:
    """key, score, status, diagnostic_code, notification, is_bounce of each readable message.

    The score is the number of bounce headers found in parts, each name once for a part, and of all headers in the
    first three blocks of status reports, over eight; it may exceed one. Null and unreadable messages give no row,
    repeated ones count each time. Each message is read once, where it lies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for n, text in enumerate(_texts(batch)):
                parts = parse_message(text)[0]
                if parts is not None:
                    at.append(n)
                    found.append(bounce_report(text, [(p, _body(text, p)[0]) for p in parts if p[4] != "headers"]) if _may_speak(text) else NO_REPORT)
            columns = [pa.array([x[0] for x in found], pa.float64()), *(pa.array([_cleaned(x[i]) for x in found], pa.string()) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, "score", "status", "diagnostic_code", "notification"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("score", T.DoubleType()), *(T.StructField(c, T.StringType()) for c in ("status", "diagnostic_code", "notification"))])
    out = df.select(key, raw).where(F.col(raw).isNotNull()).mapInArrow(run, schema)
    return out.withColumn("is_bounce", F.col("score") > probability)


_SPEAKING = [f"{name.lower()}:" for name in BOUNCE_HEADERS]


def _may_speak(text: str) -> bool:
    """Whether any of the headers that the report reads can be there."""
    low = text.lower()
    return any(name in low for name in _SPEAKING) or "delivery-status" in low


def subtree_changed(parts: DataFrame, key: str, changed: str) -> DataFrame:
    """key, part_id, and whether the part or one below it has changed; status reports and headers-only parts answer for themselves.

    Each changed part names the parts above it by their paths; these are joined by equality, so no pairs of parts are made.
    """
    above = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    touched = parts.where(changed).select(key, F.explode(above).alias("path")).distinct().withColumn("_touched", F.lit(True))
    return parts.select(key, "part_id", "path").join(touched, [key, "path"], "left").select(key, "part_id", F.coalesce("_touched", F.lit(False)).alias("was_changed"))


def serialise(df: DataFrame, raw: str, prepended: str | None = None, out: str = "text") -> DataFrame:
    """Messages as text. Unchanged ones are their own text, with the headers of `prepended` (text) in front."""
    head = F.coalesce(F.col(prepended), F.lit("")) if prepended else F.lit("")
    return df.withColumn(out, F.concat(head, F.col(raw)))


def part_edits(parts: DataFrame, key: str, headers: str | None = None, body: str | None = None) -> DataFrame:
    """key, start, end, text: what replaces which slice of a message.

    Where the column `headers` (array of headers) is not null it takes the place of a part's headers, where `body`
    (encoded text) is not null that of its body. What is not replaced stays as it was written, to the letter.
    """
    found = []
    if headers:
        found.append(parts.where(F.col(headers).isNotNull()).select(key, "start", F.col("body_start").alias("end"), F.concat(M.headers_to_text(F.col(headers)), F.lit("\r\n")).alias("text")))
    if body:
        found.append(parts.where(F.col(body).isNotNull()).select(key, F.col("body_start").alias("start"), "end", F.col(body).alias("text")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def append_parts(df: DataFrame, key: str, raw: str, *parts: Column, out: str = "text") -> DataFrame:
    """key and each multipart message with parts (with their headers) behind its own; enclose a message by
    `build_message_container`. Messages that are null, cannot be read or are no multiparts stay as they are."""

    @kernel_udf("struct<at:int,line:string>")
    def last_line(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([last_boundary(t) for t in texts], columns=["at", "line"]).astype({"at": "Int32"})

    where = last_line(F.col(raw))
    held = df.select(key, raw, where.alias("_w"), F.array(*parts).alias("_parts"))
    more = F.array_join(F.transform("_parts", lambda p: F.concat(F.col("_w.line"), F.lit("\r\n"), p, F.lit("\r\n"))), "")
    at = F.col("_w.at")
    return held.select(key, F.when(at.isNull(), F.col(raw)).otherwise(F.concat(F.substr(F.col(raw), F.lit(1), at), more, F.substr(F.col(raw), at + 1, F.length(raw)))).alias(out))


def apply_edits(df: DataFrame, key: str, raw: str, edits: DataFrame, out: str = "text") -> DataFrame:
    """key and each message with its edits: a fold over the slices in order, in the JVM. Messages without edits are as they were; slices must not overlap."""
    by_message = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_edits"))
    joined = df.select(key, raw).join(by_message, key, "left")
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, e: F.struct(F.concat(acc["done"], M.part_text(F.col(raw), acc["at"], e["start"]), e["text"]).alias("done"), e["end"].alias("at"))
    whole = F.aggregate("_edits", begin, step, lambda acc: F.concat(acc["done"], F.substr(F.col(raw), acc["at"] + 1, F.length(raw))))
    return joined.select(key, F.when(F.col("_edits").isNull(), F.col(raw)).otherwise(whole).alias(out))
