"""Opaque paging cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifflens.functions.columns import bind
from tarifflens.functions.text import iso_millis, strip_ends

CURSOR_FIELDS = "struct<detectedAt:string,id:string>"


def _swap(value: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def encode_cursor(detected_at: Column, row_id: Column) -> Column:
    """base64url of ``{"detectedAt": ISO time, "id": key}``."""
    body = F.to_json(F.struct(iso_millis(detected_at).alias("detectedAt"), row_id.cast("string").alias("id")))
    return _swap(F.regexp_replace(F.base64(F.encode(body, "UTF-8")), "[=\\r\\n]", ""), {"+": "-", "/": "_"})


def decode_cursor(cursor: Column) -> Column:
    """``struct<detected_at timestamp_ntz, id string>`` or NULL when unusable.

    A plain ISO time is the older form and has no id.
    """
    trimmed = strip_ends(cursor)
    padded = F.rpad(
        _swap(trimmed, {"-": "+", "_": "/"}),
        (F.ceil(F.length(trimmed) / 4) * 4).cast("int"),
        F.lit("="),
    )
    json = F.call_function("try_to_binary", padded, F.lit("base64"))
    parsed = F.from_json(json.cast("string"), CURSOR_FIELDS)
    instant = lambda text: F.try_to_timestamp(text).cast("timestamp_ntz")

    def choose(p: Column) -> Column:
        full = F.when(
            p["id"].isNotNull(), F.struct(instant(p["detectedAt"]).alias("detected_at"), p["id"].alias("id"))
        )
        plain = F.struct(instant(trimmed).alias("detected_at"), F.lit(None).cast("string").alias("id"))
        made = F.when(p["detectedAt"].isNotNull(), full).otherwise(plain)
        return bind(made, lambda m: F.when(m["detected_at"].isNotNull(), m))

    return bind(parsed, choose)
