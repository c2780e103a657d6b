"""Text canonicalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch import params as P


def _may_be_blank(char: Column) -> Column:
    code = F.ascii(char)
    return (code <= 32) | (code > 126)


def strip(col: Column) -> Column:
    """Trim every Unicode blank; Spark's own trim removes the space character only.

    Text whose first and last characters are plain ASCII, nearly all of it, skips the pattern.
    """
    edges = _may_be_blank(F.substring(col, 1, 1)) | _may_be_blank(F.substring(col, -1, 1))
    return F.when(edges, F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(col)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(col: Column, ascii_only: bool = False) -> Column:
    """NFKC form. ASCII text is unchanged by it, so ``ascii_only`` sources stay in the JVM."""
    if ascii_only:
        return col
    return F.when(col.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(col.rlike(r"[^\x00-\x7F]"), col))).otherwise(col)


def client_id(col: Column, ascii_only: bool = False) -> Column:
    return nfkc(strip(col), ascii_only)


def identity_usable(col: Column, dash_is_missing: bool) -> Column:
    text = strip(F.coalesce(col, F.lit("")))
    usable = text != ""
    return usable & (text != P.MISSING_FIELD) if dash_is_missing else usable


def token(col: Column, missing: str, ascii_only: bool = False) -> Column:
    text = strip(col)
    blank = text.isNull() | (text == "") | (text == P.MISSING_FIELD)
    return F.when(blank, F.lit(missing)).otherwise(nfkc(F.upper(text), ascii_only))


def flow_event_type(proto: Column, service: Column, ascii_only: bool = False) -> Column:
    return F.concat_ws(
        "::", token(proto, P.MISSING_PROTOCOL, ascii_only), token(service, P.MISSING_SERVICE, ascii_only)
    )


def protocol_group(columns: list[str]) -> Column:
    """First protocol, in fixed order, that has a column with a real payload in the row."""
    groups = []
    for prefix in P.PROTOCOL_PREFIXES:
        members = [F.col(f"`{c}`") for c in columns if c.startswith(prefix)]
        if not members:
            continue
        present = F.lit(False)
        for m in members:
            present = present | F.coalesce(~strip(m).isin(*P.UNRESOLVED_PAYLOADS), F.lit(False))
        groups.append(F.when(present, F.lit(prefix[:-1])))
    return F.coalesce(*groups, F.lit(P.UNKNOWN_GROUP))


def protocol_event_type(group: Column, ascii_only: bool = False) -> Column:
    text = strip(group)
    known = (text != "") & (text != P.UNKNOWN_GROUP)
    name = F.when(known, nfkc(F.upper(text), ascii_only)).otherwise(F.lit(P.UNKNOWN_GROUP))
    return F.concat(F.lit("PROTOCOL::"), name)


def counts_in_epoch(group: Column) -> Column:
    text = strip(group)
    return (text != "") & (text != P.UNKNOWN_GROUP)


def hash64(text: Column) -> Column:
    """First eight SHA-256 bytes as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_bucket(text: Column, buckets: int) -> Column:
    return (hash64(text) % F.lit(buckets)).cast("int")


def hash_uniform(text: Column) -> Column:
    """Reproducible number in [0, 1) from the first four SHA-256 bytes."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
