"""Validation as columns: each check yields an ``issues`` array, empty when clean."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import utf16_length

# Limits and allowed words of the event and rule formats.
MAX_TEXT = 255
OPERATORS = (">", ">=", "<", "<=", "==", "!=")
RULE_SEVERITIES = ("critical", "warning", "info")
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?Z$"


# Fixed value: whole numbers of a rule are stored in 32 bits.
INT_MAX = 2_147_483_647


def _collect(checks: list[Column]) -> Column:
    """Keep the issues that were raised, in the order of the checks.

    Joined and split rather than filtered with a lambda, which would leave
    generated code.
    """
    raised = F.concat_ws("\n", *checks)
    return F.when(raised == "", F.array().cast("array<string>")).otherwise(F.split(raised, "\n"))


class _Body:
    """The parsed JSON body: per field its type word and typed values, as columns.

    The parse sits in a one-element explode, so that a filter on the issues is not
    pushed below it; the field reads are plain columns used by several checks each.
    """

    def __init__(self, texts: list[str] = (), numbers: list[str] = (), others: list[str] = ()):
        self.texts, self.numbers, self.others = list(texts), list(numbers), list(others)

    def read(self, requests: DataFrame) -> DataFrame:
        paths = [*self.texts, *self.numbers, *self.others]
        rows = requests.withColumn("_v", F.explode(F.array(F.try_parse_json("body"))))
        # One struct of variants per object level, outermost first.
        level = {"": "_v"}
        for prefix in sorted({p.rpartition(".")[0] for p in paths}, key=len):
            names = [p.rpartition(".")[2] for p in paths if p.rpartition(".")[0] == prefix]
            shape = ", ".join(f"`{n}`: variant" for n in names)
            rows = rows.withColumn(
                f"_object_{prefix}", F.try_variant_get(level[prefix], "$", f"struct<{shape}>")
            )
            level.update({f"{prefix}.{n}".lstrip("."): f"`_object_{prefix}`.`{n}`" for n in names})
        fields = [F.schema_of_variant(level[p]).alias(self._name("kind", p)) for p in paths]
        for typed, kind in ((self.texts, "string"), (self.numbers, "double")):
            fields += [F.try_variant_get(level[p], "$", kind).alias(self._name(kind, p)) for p in typed]
        return rows.select("*", *fields)

    @staticmethod
    def _name(kind: str, path: str) -> str:
        return f"_{kind}_{path.replace('.', '_')}"

    def is_root_object(self) -> Column:
        return F.col("_object_").isNotNull()

    def kind(self, path: str) -> Column:
        """Type word of a field; null when the field is absent, VOID for JSON null."""
        return F.col(self._name("kind", path))

    def absent(self, path: str) -> Column:
        return self.kind(path).isNull()

    def text(self, path: str) -> Column:
        return F.col(self._name("string", path))

    def number(self, path: str) -> Column:
        return F.col(self._name("double", path))

    def is_number(self, path: str) -> Column:
        k = self.kind(path)
        return (k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL")

    def is_object(self, path: str) -> Column:
        return F.coalesce(self.kind(path).startswith("OBJECT"), F.lit(False))


def _issue(label: str, code: str) -> Column:
    return F.lit(f"{label}: {code}")


def _text_check(b: _Body, name: str, required: bool, longest: int | None = MAX_TEXT) -> Column:
    n = utf16_length(b.text(name))
    check = F.when(b.absent(name), _issue(name, "required") if required else F.lit(None))
    check = check.when(b.kind(name) != "STRING", _issue(name, "invalid_type")).when(n < 1, _issue(name, "too_small"))
    return check if longest is None else check.when(n > longest, _issue(name, "too_big"))


def _object_check(b: _Body, name: str) -> Column:
    return F.when(~b.absent(name) & ~b.is_object(name), _issue(name, "invalid_type"))


def _int_check(b: _Body, name: str, least: int, required: bool) -> Column:
    x = b.number(name)
    return (
        F.when(b.absent(name), _issue(name, "required") if required else F.lit(None))
        .when(~b.is_number(name), _issue(name, "invalid_type"))
        .when(x != F.floor(x), _issue(name, "not_integer"))
        .when(x < least, _issue(name, "too_small"))
        .when(x > INT_MAX, _issue(name, "too_big"))
    )


def _word_check(b: _Body, name: str, words: tuple[str, ...], required: bool) -> Column:
    return (
        F.when(b.absent(name), _issue(name, "required") if required else F.lit(None))
        .when(b.kind(name) != "STRING", _issue(name, "invalid_type"))
        .when(~b.text(name).isin(*words), _issue(name, "invalid_enum"))
    )


def _bool_check(b: _Body, name: str, required: bool) -> Column:
    return F.when(b.absent(name), _issue(name, "required") if required else F.lit(None)).when(
        b.kind(name) != "BOOLEAN", _issue(name, "invalid_type")
    )


def _with_issues(requests: DataFrame, body: _Body, checks: list[Column]) -> DataFrame:
    """Evaluate ``checks`` on bodies that are JSON objects; others get one issue.

    The one-element explode makes the result a column that later filters test, in
    place of copies of all checks in each filter.
    """
    issues = F.when(body.is_root_object(), _collect(checks)).otherwise(F.array(_issue("body", "invalid_type")))
    return body.read(requests).withColumn("issues", F.explode(F.array(issues)))


def validate_events(requests: DataFrame) -> DataFrame:
    """Check JSON ``body`` texts of inbound events and unpack their fields.

    Adds ``issues`` and the event fields as text; objects default to ``{}``.
    """
    b = _Body(texts=["event_id", "event_type", "source", "timestamp"], others=["payload", "metadata"])
    stamp = b.text("timestamp")
    checks = [
        F.when(b.kind("event_id") != "STRING", _issue("event_id", "invalid_type")).when(
            ~b.text("event_id").rlike(UUID), _issue("event_id", "invalid_uuid")
        ),
        _text_check(b, "event_type", True),
        _text_check(b, "source", True),
        F.when(b.absent("timestamp"), _issue("timestamp", "required"))
        .when(b.kind("timestamp") != "STRING", _issue("timestamp", "invalid_type"))
        .when(
            ~stamp.rlike(DATETIME) | F.try_to_timestamp(F.substring(stamp, 1, 19)).isNull(),
            _issue("timestamp", "invalid_datetime"),
        ),
        _object_check(b, "payload"),
        _object_check(b, "metadata"),
    ]
    texts = [b.text(f).alias(f) for f in b.texts]
    objects = [
        F.coalesce(F.to_json(F.try_variant_get("_v", f"$.{f}", "variant")), F.lit("{}")).alias(f) for f in b.others
    ]
    return _with_issues(requests, b, checks).select(*requests.columns, *texts, *objects, "issues")


RULE_FIELDS = ("name", "enabled", "severity", "window_seconds", "cooldown_seconds", "condition")


def _rule_body() -> _Body:
    return _Body(
        texts=[
            "name", "severity", "condition.type", "condition.metric", "condition.operator",
            "condition.filters.event_type", "condition.filters.source",
        ],
        numbers=["window_seconds", "cooldown_seconds", "condition.value"],
        others=["enabled", "condition", "condition.filters"],
    )


def _condition_checks(b: _Body, required: bool) -> list[Column]:
    value = b.number("condition.value")
    inside = [
        _word_check(b, "condition.type", ("threshold",), True),
        _word_check(b, "condition.metric", ("count",), True),
        _object_check(b, "condition.filters"),
        _text_check(b, "condition.filters.event_type", False, None),
        _text_check(b, "condition.filters.source", False, None),
        _word_check(b, "condition.operator", OPERATORS, True),
        F.when(b.absent("condition.value"), _issue("condition.value", "required"))
        .when(~b.is_number("condition.value"), _issue("condition.value", "invalid_type"))
        .when(F.isnan(value) | (F.abs(value) == float("inf")), _issue("condition.value", "not_finite")),
    ]
    whole = F.when(b.absent("condition"), _issue("condition", "required") if required else F.lit(None)).when(
        ~b.is_object("condition"), _issue("condition", "invalid_type")
    )
    return [whole, *[F.when(b.is_object("condition"), check) for check in inside]]


def _rule_checks(b: _Body, required: set[str]) -> list[Column]:
    return [
        _text_check(b, "name", "name" in required),
        _bool_check(b, "enabled", "enabled" in required),
        _word_check(b, "severity", RULE_SEVERITIES, "severity" in required),
        _int_check(b, "window_seconds", 1, "window_seconds" in required),
        _int_check(b, "cooldown_seconds", 0, "cooldown_seconds" in required),
        *_condition_checks(b, "condition" in required),
    ]


def _checked_rules(
    requests: DataFrame, required: set[str], defaults: bool = False, at_least_one: bool = False
) -> DataFrame:
    """Check bodies and unpack the fields of clean ones; with ``defaults``, absent
    optional fields get their value."""
    b = _rule_body()
    checks = _rule_checks(b, required)
    if at_least_one:
        none = reduce(and_, [b.absent(f) for f in RULE_FIELDS])
        checks.append(F.when(none, _issue("body", "no_fields")))
    enabled = F.try_variant_get("_v", "$.enabled", "boolean")
    cooldown = b.number("cooldown_seconds").try_cast("int")
    condition = F.when(
        b.is_object("condition"),
        F.struct(
            b.text("condition.type").alias("type"),
            b.text("condition.metric").alias("metric"),
            F.struct(
                b.text("condition.filters.event_type").alias("event_type"),
                b.text("condition.filters.source").alias("source"),
            ).alias("filters"),
            b.text("condition.operator").alias("operator"),
            b.number("condition.value").alias("value"),
        ),
    )
    fields = {
        "name": b.text("name"),
        "enabled": F.coalesce(enabled, F.lit(True)) if defaults else enabled,
        "severity": b.text("severity"),
        "window_seconds": b.number("window_seconds").try_cast("int"),
        "cooldown_seconds": F.coalesce(cooldown, F.lit(0)) if defaults else cooldown,
        "condition": condition,
    }
    clean = F.size("issues") == 0
    return _with_issues(requests, b, checks).select(
        *requests.columns, *[F.when(clean, x).alias(name) for name, x in fields.items()], "issues"
    )


def validate_rules_create(requests: DataFrame) -> DataFrame:
    """All fields but ``enabled`` (true) and ``cooldown_seconds`` (0) are required."""
    return _checked_rules(requests, set(RULE_FIELDS) - {"enabled", "cooldown_seconds"}, defaults=True)


def validate_rules_replace(requests: DataFrame) -> DataFrame:
    """Every field is required; nothing is defaulted."""
    return _checked_rules(requests, set(RULE_FIELDS))


def validate_rules_patch(requests: DataFrame) -> DataFrame:
    """Every field is optional, but at least one must be there."""
    return _checked_rules(requests, set(), at_least_one=True)


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Issues per statistical profile; detectors use the clean rows only."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    size, n, z, wait = (
        F.col(c) for c in ("bucket_seconds", "baseline_buckets", "z_threshold", "cooldown_seconds")
    )
    checks = [
        F.when(F.coalesce("id", F.lit("")) == "", _issue("id", "required")),
        F.when(~(finite(size) & (size > 0)), _issue("bucket_seconds", "invalid")),
        F.when(~(finite(n) & (n == F.floor(n)) & (n >= 2)), _issue("baseline_buckets", "invalid")),
        F.when(~(finite(z) & (z > 0)), _issue("z_threshold", "invalid")),
        F.when(wait.isNotNull() & ~(finite(wait) & (wait >= 0)), _issue("cooldown_seconds", "invalid")),
    ]
    return profiles.withColumn("issues", _collect(checks))


NOTIFICATION_FIELDS = ("anomaly_id", "rule_id", "severity", "message", "detected_at")


def valid_notifications(messages: DataFrame) -> DataFrame:
    """Parse JSON ``message`` texts; drop those that do not parse or lack an
    anomaly id, rule id or severity."""
    parsed = messages.withColumn("_v", F.explode(F.array(F.try_parse_json("message"))))
    fields = [F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in NOTIFICATION_FIELDS]
    return parsed.select(*[c for c in messages.columns if c != "message"], *fields).filter(
        " AND ".join(f"coalesce({f}, '') <> ''" for f in ("anomaly_id", "rule_id", "severity"))
    )
