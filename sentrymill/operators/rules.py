"""The rule table as the latest state of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import iso_millis, uuid_text
from ..schemas import RULES
from ..session import checkpointed, delete_folder, folder_exists
from .joins import with_group_values

FIELDS = ("name", "enabled", "severity", "window_seconds", "cooldown_seconds", "condition")


CHANGE_COLUMNS = ("rule_id", "seq", "at", "reason", *FIELDS)


def as_changes(requests: DataFrame, reason: str) -> DataFrame:
    """Turn requests with their arrival number ``seq`` and time ``at`` into changes.

    Creates, updates and patches come from the rule validators, and those with
    issues drop out. A create gets an id fixed by its number and name; the other
    kinds carry ``rule_id``. A delete needs no more than that.
    """
    if reason != "delete":
        requests = requests.filter(F.size("issues") == 0)
    if reason == "create":
        requests = requests.withColumn("rule_id", uuid_text(F.md5(F.concat_ws("|", F.col("seq").cast("string"), "name"))))
    types = {f.name: f.dataType for f in RULES}
    fields = [
        F.col(f) if f in requests.columns else F.lit(None).cast(types[f]).alias(f) for f in FIELDS
    ]
    return requests.select("rule_id", "seq", "at", F.lit(reason).alias("reason"), *fields)


def change_messages(changes: DataFrame) -> DataFrame:
    """The message published per change: when, why, which rule."""
    body = F.to_json(F.struct(iso_millis(F.col("at")).alias("ts"), "reason", "rule_id"))
    return changes.select(body.alias("message"))


# Versions of the rule table that stay for readers that began with them.
KEPT_VERSIONS = 3
_STORED = T.StructType([*[T.StructField(f.name, f.dataType) for f in RULES], T.StructField("version", T.LongType())])


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """All stored rows, and the versions that are whole, oldest first: those with their closing row, which has no id."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], _STORED), []
    rows = spark.read.schema(_STORED).parquet(path)
    return rows, sorted(r.version for r in rows.filter("rule_id IS NULL").select("version").distinct().collect())


def write_rules(rules: DataFrame, path: str) -> None:
    """Append a new version of the rule table, closed by a row of its own. Readers take the newest
    closed one, so none ever sees a table that is half written. One writer at a time."""
    spark = rules.sparkSession
    before = _stored(spark, path)[1]
    version = before[-1] + 1 if before else 0
    delete_folder(spark, f"{path}/version={version}")  # what a write that was cut short left
    closing = spark.createDataFrame([(None,) * len(RULES)], T.StructType(_STORED.fields[:-1]))
    for rows in (checkpointed(rules.select(*RULES.fieldNames())), closing):
        rows.withColumn("version", F.lit(version).cast("bigint")).write.mode("append").partitionBy("version").parquet(path)
    for old in before[:-(KEPT_VERSIONS - 1)]:
        delete_folder(spark, f"{path}/version={old}")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version; an error where there is none."""
    rows, versions = _stored(spark, path)
    if not versions:
        raise FileNotFoundError(f"no rule table in {path}")
    return rows.filter((F.col("version") == versions[-1]) & F.col("rule_id").isNotNull()).drop("version")


def apply_rule_changes(changes: DataFrame) -> DataFrame:
    """Fold ordered changes per rule into the current rules.

    ``changes`` has ``rule_id, seq, at, reason`` (create, update, patch, delete) and
    the rule fields, null where a patch leaves them alone. A rule lives from the
    first create after its last delete; another create of a living rule conflicts
    with its key and is refused; changes to an absent rule have no effect.

    Everything is a mergeable aggregate, so a rule changed very often is reduced
    before the shuffle and never gathered as a list.
    """
    reason = F.col("reason")
    last_delete = F.max(F.when(reason == "delete", F.col("seq")))
    since = with_group_values(changes, "rule_id", {"_deleted": last_delete}, {"_deleted": F.max}).filter(
        F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted"))
    )
    is_create, is_edit = reason == "create", reason.isin("update", "patch")

    # The latest edit that sets a field, as (seq, value); max of a struct compares seq first.
    latest = [
        F.max(F.when(is_edit & F.col(f).isNotNull(), F.struct("seq", F.col(f).alias("value")))).alias(f"_{f}")
        for f in FIELDS
    ]
    state = since.groupBy("rule_id").agg(
        F.min(F.when(is_create, F.struct("seq", "at", *FIELDS))).alias("_born"),
        F.max(F.when(is_edit, F.struct("seq", "at"))).alias("_edited"),
        *latest,
    )

    def current(f: str):
        edit, born = F.col(f"_{f}"), F.col("_born")
        return F.when(edit["seq"] > born["seq"], edit["value"]).otherwise(born[f]).alias(f)

    born, edited = F.col("_born"), F.col("_edited")
    return state.filter(born.isNotNull()).select(
        "rule_id",
        *[current(f) for f in FIELDS],
        born["at"].alias("created_at"),
        F.when(edited["seq"] > born["seq"], edited["at"]).otherwise(born["at"]).alias("updated_at"),
    )


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled")


def get_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("rule_id") == rule_id).limit(1)
