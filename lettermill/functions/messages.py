"""Columns of messages, headers, parts and bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions._udf import kernel_udf
from lettermill.kernels import body as B
from lettermill.kernels import build as Z
from lettermill.kernels import headers as H
from lettermill.kernels.dkim import canonical_body as _canonical_body
from lettermill.kernels.dkim import dkim_signature, domainkey_signature
from lettermill.kernels.encodedword import decode_words
from lettermill.kernels.scan import parse_message
from lettermill.types import HEADER, PARSED

_PART = [f.split(":")[0] for f in "part_id: parent_id: path: depth: rel: start: end: body_start: main: sub: params: disposition: disposition_params: encoding: headers:".split(" ")]
_HEAD = ["name", "raw", "value", "params"]


def _part(p: tuple) -> dict:
    return dict(zip(_PART, p, strict=True)) | {"headers": [dict(zip(_HEAD, h, strict=True)) for h in p[-1]]}


def parse_mime(raw: Column, recover: bool = False) -> Column:
    """Struct of the parts of a message in pre-order, an error, and which parser read it. A bad message never fails the task."""

    @kernel_udf(PARSED)
    def kernel(texts: pd.Series) -> pd.DataFrame:
        found = [parse_message(t, recover) for t in texts]
        return pd.DataFrame([(None if rows is None else [_part(p) for p in rows], error, parser) for rows, error, parser in found], columns=["parts", "error", "parser"])

    return kernel(raw)


@kernel_udf(f"array<struct<{','.join(f.replace(' ', ':', 1) for f in HEADER.split(', '))}>>")
def _headers_kernel(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [dict(zip(_HEAD, h, strict=True)) for h in H.parse_headers(t)[0]] for t in texts], dtype=object)


def message_headers(raw: Column) -> Column:
    """The headers of a message; only the text before its first empty line goes to the kernel."""
    return _headers_kernel(F.regexp_extract(raw, r"^([\s\S]*?)(?:\r\n\r\n|\n\n|$(?![\s\S]))", 1))


# Ordered multi-map of headers: array<struct<name, raw, value, params>>


def normalize_name(name: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(name), "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "-")


def _key(name: Column | str) -> Column:
    return normalize_name(F.lit(name) if isinstance(name, str) else name)


def header_all(headers: Column, name: Column | str) -> Column:
    return F.transform(F.filter(headers, lambda h: h["name"] == _key(name)), lambda h: h["value"])


def header_get(headers: Column, name: Column | str) -> Column:
    """One value; of several the last."""
    return F.try_element_at(header_all(headers, name), F.lit(-1))


def header_get_raw(headers: Column, name: Column | str) -> Column:
    return F.try_element_at(F.transform(F.filter(headers, lambda h: h["name"] == _key(name)), lambda h: h["raw"]), F.lit(-1))


def header_has(headers: Column, name: Column | str) -> Column:
    return F.exists(headers, lambda h: h["name"] == _key(name))


def _new(name: Column | str, value: Column) -> Column:
    return F.array(F.struct(_key(name).alias("name"), value.alias("raw"), value.alias("value"), F.create_map().cast("map<string,string>").alias("params")))


def header_set(headers: Column, name: Column | str, value: Column) -> Column:
    """Replaces all values of the name, the new one last; a new name comes first."""
    rest = F.filter(headers, lambda h: h["name"] != _key(name))
    return F.when(header_has(headers, name), F.concat(rest, _new(name, value))).otherwise(F.concat(_new(name, value), headers))


def header_prepend(headers: Column, name: Column | str, value: Column) -> Column:
    return F.concat(_new(name, value), headers)


def header_delete(headers: Column, *names: str) -> Column:
    gone = [F.lit("-".join(p.capitalize() for p in n.lower().split("-"))) for n in names]
    return F.filter(headers, lambda h: ~h["name"].isin(gone))


def header_transform(headers: Column, f) -> Column:
    """`f` over the struct of each header."""
    return F.transform(headers, f)


def header_rows(df: DataFrame, key: str, headers: str) -> DataFrame:
    """key, pos, name, raw, value, params of each header of each row, in order."""
    return df.select(key, F.posexplode(headers).alias("pos", "h")).select(key, "pos", "h.*")


def headers_changed(old: Column, new: Column) -> Column:
    flat = lambda hs: F.transform(hs, lambda h: F.struct(h["name"], h["raw"], F.array_sort(F.map_entries(h["params"]))))
    return ~flat(old).eqNullSafe(flat(new))


@kernel_udf("string")
def _headers_text(lists: pd.Series) -> pd.Series:
    return pd.Series([None if hs is None else "".join(f"{h['name']}: {H.encode_header(h['name'], h['value'], dict(h['params'] or {}))}\r\n" for h in hs) for hs in lists], dtype=object)


def headers_to_text(headers: Column) -> Column:
    return _headers_text(headers)


def remove_newlines(s: Column) -> Column:
    return F.translate(s, "\r\n", "")


def unfold(s: Column) -> Column:
    return F.regexp_replace(s, r"\n\r?|\r\n?", "")


@kernel_udf("string")
def _decode_kernel(values: pd.Series) -> pd.Series:
    return values.map(decode_words, na_action="ignore")


def decode_header(value: Column) -> Column:
    """Encoded words decoded; values without one never leave the JVM."""
    coded = value.contains("=?")
    return F.when(coded, _decode_kernel(F.when(coded, value))).otherwise(unfold(value))


@kernel_udf("struct<value:string,params:map<string,string>>")
def _parametrised_kernel(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, {}) if v is None else H.parametrised(v) for v in values], columns=["value", "params"])


def parametrised(value: Column) -> Column:
    """`value; key=v` as a struct of the value in lower case and its parameters."""
    return _parametrised_kernel(value)


def is_parametrised(name: Column) -> Column:
    return name.isin(*H.PARAMETRISED)


def is_address_header(name: Column, value: Column) -> Column:
    return name.isin(*H.ADDRESS_HEADERS) & value.contains("@")


def encode_header(name: str, value: Column) -> Column:
    @kernel_udf("string")
    def kernel(values: pd.Series) -> pd.Series:
        return values.map(lambda v: H.encode_header(name, v), na_action="ignore")

    return kernel(value)


# Content types


def fix_content_type(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    pieces = F.split(low, "/")
    return (
        F.when(low == "", "text/plain").when(F.size(pieces) >= 2, F.concat_ws("/", pieces[0], pieces[1])).when(low == "text", "text/plain").when(low == "html", "text/html").otherwise("application/octet-stream")
    )


def is_multipart(main: Column) -> Column:
    return main == "multipart"


def is_message_container(main: Column, sub: Column) -> Column:
    return (main == "message") & sub.isin("rfc822", "global", "news")


def is_headers_container(main: Column, sub: Column) -> Column:
    return F.concat_ws("/", main, sub).isin("message/feedback-report", "text/rfc822-headers", "message/external-body", "message/disposition-notification")


def is_delivery_status(main: Column, sub: Column) -> Column:
    return (main == "message") & (sub == "delivery-status")


def is_feedback_report(main: Column, sub: Column) -> Column:
    return (main == "message") & (sub == "feedback-report")


def content_type_equals(main: Column, sub: Column, other: Column) -> Column:
    """Whether a content type is the one that a text `main/sub` names; parameters and case do not count."""
    return F.concat_ws("/", F.lower(main), F.lower(sub)) == F.lower(F.trim(F.substring_index(other, ";", 1)))


def is_singlepart(main: Column, sub: Column) -> Column:
    return ~main.isin("multipart", "message") & ~is_headers_container(main, sub)


def part_charset(main: Column, params: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(params, F.lit("charset")), F.when(main == "text", "ascii")))


def boundary_line(params: Column, final: bool = False) -> Column:
    return F.concat(F.lit("--"), F.try_element_at(params, F.lit("boundary")), F.lit("--" if final else ""))


def set_charset(params: Column, charset: Column) -> Column:
    return F.map_concat(F.map_filter(params, lambda k, _: k != "charset"), F.create_map(F.lit("charset"), F.lower(charset)))


# Message ids and subjects


def message_ids(value: Column) -> Column:
    """All valid ids in angle brackets: longer than 5 and shorter than 256 characters, with the form of an address."""
    found = F.regexp_extract_all(value, F.lit(r"<([^<>\r\n]+)>"), F.lit(1))
    atom = r"(?:[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~.]|[^\x00-\x7F])++"
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda i: (F.length(i) > 5) & (F.length(i) < 256) & i.rlike(rf'(?:^|\s)(?:{atom}|"[^"]*")@(?:{atom}|\[[^\]]*\])$'))


def message_id(value: Column) -> Column:
    return F.try_element_at(message_ids(value), F.lit(1))


def message_id_key(i: Column) -> Column:
    return F.translate(i, "\"'", "")


def references(references_: Column, in_reply_to: Column) -> Column:
    """Ids of References, or else the first of In-Reply-To, whole."""
    own = message_ids(references_)
    return F.when(F.size(own) > 0, own).otherwise(F.slice(message_ids(in_reply_to), 1, 1))


def generate_message_id(domain: str = "localhost") -> Column:
    """A fresh id each time it is computed."""
    return F.concat(F.lit("<"), F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(f"@{domain}>"))


def clean_subject(s: Column) -> Column:
    """Without reply and forward marks, wherever they stand."""
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"(?i)(?:(?:RE|FW|FWD|HA)(?:\[\d\])*+:\s*+)++", "")


# Parts


def detected_file_name(params: Column, disposition_params: Column) -> Column:
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    return decode_header(F.coalesce(of(disposition_params, "filename"), of(params, "filename"), of(params, "name"), F.lit("")))


def is_body(main: Column, file_name: Column) -> Column:
    return (F.coalesce(file_name, F.lit("")) == "") & main.isin("text", "message")


def is_attachment(disposition: Column) -> Column:
    return F.coalesce(disposition == "attachment", F.lit(False))


def is_inline(disposition: Column) -> Column:
    return F.coalesce(disposition == "inline", F.lit(False))


def is_delivery_notification(main: Column, sub: Column, params: Column) -> Column:
    return (main == "multipart") & (sub == "report") & F.coalesce(F.try_element_at(params, F.lit("report-type")) == "delivery-status", F.lit(False))


def part_text(raw: Column, start: Column, end: Column) -> Column:
    """A slice of the message as it stands."""
    return F.substr(raw, start + 1, end - start)


@kernel_udf("struct<text:string,data:binary>")
def _body_kernel(body: pd.Series, encoding: pd.Series, main: pd.Series, sub: pd.Series, charset: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([B.decode_body(*row) for row in zip(body, encoding, main, sub, charset, strict=True)], columns=["text", "data"])


def decode_body(body: Column, encoding: Column, main: Column, sub: Column, charset: Column) -> Column:
    """Struct of text (text types) and data (others). Unencoded ASCII text stays in the JVM."""
    plain = encoding.isin("7bit", "8bit", "binary") & (main == "text") & (sub != "html") & ~body.rlike(r"[^\x00-\x7F]")
    kernel = _body_kernel(F.when(plain, None).otherwise(body), encoding, main, sub, charset)
    return F.struct(F.when(plain, body).otherwise(kernel["text"]).alias("text"), kernel["data"].alias("data"))


def encode_body(body: Column, charset: Column, preferred: Column) -> Column:
    """Struct of the charset, the transfer encoding and the encoded text of a text body; null gives nulls. The preferred
    charset and encoding are taken where they serve."""

    @kernel_udf("struct<charset:string,encoding:string,text:string>")
    def kernel(bodies: pd.Series, charsets: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        found = [(None, None, None) if b is None else B.encode_body(b, "text", c, e) for b, c, e in zip(bodies, charsets, encodings, strict=True)]
        return pd.DataFrame(found, columns=["charset", "encoding", "text"])

    return kernel(body, charset, preferred)


def detect_content_type(main: Column, sub: Column, file_name: Column, body: Column | None = None) -> Column:
    """Better type of octet streams by file name, of images and sounds by their first bytes."""
    from lettermill.kernels.build import MAGIC

    guess = {"pdf": "application/pdf", "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "doc": "application/msword", "xls": "application/vnd.ms-excel", "ics": "text/calendar", "mp3": "audio/mpeg", "wav": "audio/x-wav", "mp4": "video/mp4", "json": "application/json", "xml": "text/xml", "bz2": "application/x-bzip2", "gz": "application/x-gzip"}
    table = F.create_map(*[F.lit(x) for kv in guess.items() for x in kv])
    by_name = F.try_element_at(table, F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1)))
    own = F.concat_ws("/", main, sub)
    out = F.when(own == "application/octet-stream", F.coalesce(by_name, own)).otherwise(own)
    if body is not None:
        head = F.hex(F.substring(body, 1, 16))
        for at, magic, (m, s) in MAGIC:
            out = F.when((main == m) & F.substring(head, 2 * at + 1, 2 * len(magic)).eqNullSafe(F.lit(magic.hex().upper())), f"{m}/{s}").otherwise(out)
    return out


def has_long_lines(text: Column, longest: int = 599) -> Column:
    return F.exists(F.split(text, r"\r\n|\n|\r", -1), lambda x: F.octet_length(x) >= longest)


def choose_text_encoding(charset: Column, preferred: Column, text: Column) -> Column:
    weight = lambda e: F.when(e == "7bit", 0).when(e.isin("quoted-printable", "base64"), 1).when(e == "8bit", 3).otherwise(-1)
    qp = F.when(weight(preferred) > 1, preferred).otherwise("quoted-printable")
    return F.when(charset.isin("ascii", "us-ascii", "iso-8859-1") & ~has_long_lines(text), preferred).otherwise(qp)


# Building and signing


def build_text(subtype: str, body: Column, charset: str | None = None) -> Column:
    @kernel_udf("string")
    def kernel(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: Z.leaf(f"text/{subtype}", b, charset=charset), na_action="ignore")

    return kernel(body)


def build_attachment(content_type: Column, body: Column, file_name: Column) -> Column:
    @kernel_udf("string")
    def kernel(types: pd.Series, bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else Z.leaf(t, b if isinstance(b, str) else bytes(b), n, "attachment") for t, b, n in zip(types, bodies, names, strict=True)], dtype=object)

    return kernel(content_type, body, file_name)


def build_multipart(subtype: str, key: Column, *parts: Column) -> Column:
    """Native: the boundary comes from the key, so that the same input gives the same message."""
    b = F.concat(F.lit("=_"), F.substring(F.sha2(key.cast("string"), 256), 1, 32))
    body = [F.concat(F.lit("--"), b, F.lit("\r\n"), p, F.lit("\r\n")) for p in parts]
    return F.concat(F.lit(f'Content-Type: multipart/{subtype}; boundary="'), b, F.lit('"\r\n\r\n'), *body, F.lit("--"), b, F.lit("--\r\n"))


def build_message_container(message: Column) -> Column:
    return F.concat(F.lit("Content-Type: message/rfc822\r\nContent-Disposition: attachment\r\n\r\n"), message)


#: Line ends at the end; the loop is possessive and begins where the run begins.
_LAST_ENDS = r"(?<!\n)(?:\r?\n)++\z"


def canonical_body(body: Column, form: str = "relaxed") -> Column:
    """The bytes of a text body in a canonical form. `simple` and `nofws` are native; null gives null."""
    if form == "simple":
        return F.encode(F.concat(F.regexp_replace(body, _LAST_ENDS, ""), F.lit("\r\n")), "utf-8")
    if form == "nofws":
        return F.encode(F.concat(F.regexp_replace(F.regexp_replace(body, r"[ \t\x0b\x0c]+", ""), r"(?<![\r\n])[\r\n]++\z", ""), F.lit("\r\n")), "utf-8")

    @kernel_udf("binary")
    def kernel(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: _canonical_body(b.encode() if isinstance(b, str) else bytes(b), form), na_action="ignore")

    return kernel(body)


def body_hash(body: Column) -> Column:
    """Hash of the body in the simple canonical form, native."""
    return F.base64(F.unhex(F.sha2(canonical_body(body, "simple"), 256)))


def sign_dkim(message: Column, pem: bytes, selector: str, domain: str, now: int, **options) -> Column:
    @kernel_udf("string")
    def kernel(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: dkim_signature(m.encode() if isinstance(m, str) else bytes(m), pem, selector, domain, now=now, **options).decode(), na_action="ignore")

    return kernel(message)


def sign_domainkey(message: Column, pem: bytes, selector: str, domain: str) -> Column:
    @kernel_udf("string")
    def kernel(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: domainkey_signature(m.encode() if isinstance(m, str) else bytes(m), pem, selector, domain).decode(), na_action="ignore")

    return kernel(message)


