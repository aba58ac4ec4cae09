"""Notification outbox: one row per anomaly and channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import iso_millis

# Channel settings where none are given.
DEFAULT_CHANNELS = {
    "websocket": {"enabled": True},
    "slack": {"enabled": False, "webhook_url": ""},
    "email": {"enabled": False, "smtp_host": "", "recipients": []},
}


def merge_channels(config: dict | None) -> dict:
    """Given settings over the defaults; a value of the wrong type is ignored."""
    merged = {}
    for channel, defaults in DEFAULT_CHANNELS.items():
        given = (config or {}).get(channel) or {}
        merged[channel] = {
            k: given[k] if isinstance(given.get(k), type(v)) else v for k, v in defaults.items()
        }
    return merged


def _status(channel: str, settings: dict) -> str:
    if not settings["enabled"]:
        return "skipped_disabled"
    if channel == "slack" and not settings["webhook_url"]:
        return "skipped_no_url"
    return "pending"


def notification_message(anomalies: DataFrame) -> DataFrame:
    """The JSON message published per anomaly."""
    body = F.to_json(F.struct(
        "anomaly_id", "rule_id", "severity", "message", iso_millis(F.col("detected_at")).alias("detected_at")
    ))
    return anomalies.select(body.alias("message"))


def _bodies(detected: Column) -> dict[str, Column]:
    chat = F.concat(
        F.lit("*["), F.upper("severity"), F.lit("]* Anomaly detected\n>"), F.col("message"),
        F.lit("\nRule: `"), F.col("rule_id"), F.lit("` | Detected: "), detected,
    )
    return {
        "websocket": F.to_json(F.struct(
            F.lit("anomaly").alias("type"), "severity", "message", detected.alias("detected_at"),
            "anomaly_id", "rule_id",
        )),
        "slack": F.to_json(F.struct(chat.alias("text"))),
        "email": F.to_json(F.struct(
            "anomaly_id", "rule_id", "severity", "message", detected.alias("detected_at")
        )),
    }


def notification_outbox(anomalies: DataFrame, config: dict | None = None) -> DataFrame:
    """Fan each anomaly out to the channels. Channels are independent: one that is
    off or lacks its address is marked as skipped and does not affect the others. The
    address of the chat channel is a secret: its rows name the setting that holds it."""
    detected = iso_millis(F.col("detected_at"))
    bodies = _bodies(detected)
    rows = F.array(*[
        F.struct(
            F.lit(channel).alias("channel"),
            F.lit(_status(channel, settings)).alias("status"),
            F.lit(",".join(settings.get("recipients", []))
                  or (f"{channel}.webhook_url" if settings.get("webhook_url") else "")).alias("target"),
            bodies[channel].alias("body"),
        )
        for channel, settings in merge_channels(config).items()
    ])
    return anomalies.withColumn("_c", F.explode(rows)).select("anomaly_id", "rule_id", "severity", "_c.*")


def outbox_from_messages(messages: DataFrame, config: dict | None = None) -> DataFrame:
    """Fan-out on the receiving side: published JSON texts, malformed ones dropped."""
    from .validate import valid_notifications

    parsed = valid_notifications(messages).withColumn("detected_at", F.try_to_timestamp("detected_at"))
    return notification_outbox(parsed, config)
