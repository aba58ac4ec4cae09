"""Flat string encoding of events on the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import iso_millis

# The fields of a stream entry.
TEXT_FIELDS = ("event_id", "event_type", "source", "timestamp")
JSON_FIELDS = ("payload", "metadata")


def encode_events(events: DataFrame) -> DataFrame:
    """One row per event with six string fields; time as ISO text, objects as JSON."""
    return events.select(
        "seq",
        "event_id",
        "event_type",
        "source",
        iso_millis(F.col("timestamp")).alias("timestamp"),
        F.coalesce("payload", F.lit("{}")).alias("payload"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )


def as_entries(encoded: DataFrame) -> DataFrame:
    """Pack the six fields into the ``fields`` map a log entry carries."""
    pairs = [c for f in TEXT_FIELDS + JSON_FIELDS for c in (F.lit(f), F.col(f))]
    return encoded.select("seq", F.create_map(*pairs).alias("fields"))


def write_log(events: DataFrame, path: str) -> None:
    """Append events to the log: files of JSON lines, one entry per line."""
    as_entries(encode_events(events)).write.mode("append").json(path)


def decode_events(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Read ``fields`` back; an absent text field is '' and an absent object '{}'. Columns in ``keep`` stay.

    ``malformed`` marks entries whose JSON does not parse; the reader of the log
    parks those instead of failing the batch.
    """
    def field(name: str, default: str):
        return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(default)).alias(name)

    flat = entries.select(
        "seq",
        *keep,
        *[field(f, "") for f in TEXT_FIELDS],
        *[field(f, "{}") for f in JSON_FIELDS],
    )
    bad = [F.try_parse_json(F.col(f)).isNull() for f in JSON_FIELDS]
    return flat.withColumn("malformed", bad[0] | bad[1])
