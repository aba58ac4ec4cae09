"""The rule table kept by a stream: changes are folded as they come, never from the start again.

The state of a rule is what it is now. Each micro-batch gives one row per rule it touches; the
rule table is the newest row of each rule. Changes of a rule must come in the order of ``seq``,
those within a micro-batch in any order. They come to the state in packs, a row for many changes
of a rule, since the state operator handles row by row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import FIELDS
from ..schemas import RULES

# Changes packed at a time, by rule.
PACK_ROWS = 100_000
PACKS = "rule_id string, seq array<bigint>, at_us array<bigint>, reason array<string>, fields array<string>"
STATES = "rule_id string, seq long, alive boolean, created_us long, updated_us long, fields string"


def pack_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of changes of one rule, each a list per column. What comes before a delete of the same rule is left out:
    it has no effect whatever else there is."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield from _packed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from _packed(pa.Table.from_batches(held))


def _packed(changes: pa.Table) -> Iterator[pa.RecordBatch]:
    rule = changes.column("rule_id").combine_chunks().dictionary_encode()
    code = rule.indices.fill_null(len(rule.dictionary)).to_numpy(zero_copy_only=False)
    seq = changes.column("seq").to_numpy()
    deletes = changes.column("reason").to_numpy() == "delete"
    last = np.full(len(rule.dictionary) + 1, np.iinfo("int64").min)
    np.maximum.at(last, code[deletes], seq[deletes])
    columns = [c for c in changes.column_names if c != "rule_id"]
    packs = changes.filter(pa.array(seq >= last[code])).group_by("rule_id", use_threads=False).aggregate([(c, "list") for c in columns])
    return iter(packs.rename_columns({f"{c}_list": c for c in columns}).select(["rule_id", *columns]).to_batches())


class RuleState(StatefulProcessor):
    """A rule lives from the first create after its last delete; a create of a living rule is
    refused, changes to an absent one have no effect, and edits set the fields they name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rule = handle.getValueState("rule", "created_us long, updated_us long, fields string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changes = sorted(
            (change for pack in rows for change in zip(pack.seq, pack.at_us, pack.reason, pack.fields)), key=itemgetter(0))
        state = self.rule.get() if self.rule.exists() else None
        rule = None if state is None else (state[0], state[1], json.loads(state[2]))
        left = changes
        deleted = [k for k, change in enumerate(changes) if change[2] == "delete"]
        if deleted:
            rule, left = None, changes[deleted[-1] + 1:]
        if rule is None:
            born = next((k for k, change in enumerate(left) if change[2] == "create"), len(left))
            for _, at_us, _, fields in left[born:born + 1]:
                rule = (at_us, at_us, json.loads(fields))
            left = left[born + 1:]
        edits = [change for change in left if change[2] in ("update", "patch")]
        if rule is not None and edits:
            rule = (rule[0], edits[-1][1], rule[2] | _newest([change[3] for change in edits]))
        if rule is None:
            self.rule.clear()
        else:
            self.rule.update((rule[0], rule[1], json.dumps(rule[2])))
        created, updated, fields = rule or (0, 0, {})
        yield Row(
            rule_id=key[0], seq=changes[-1][0], alive=rule is not None, created_us=created, updated_us=updated,
            fields=json.dumps(fields))


def _newest(texts: list[str]) -> dict:
    """The newest value of each field that any of the edits sets."""
    fields: dict = {}
    for text in reversed(texts):
        fields = json.loads(text) | fields
        if len(fields) == len(FIELDS):
            break
    return fields


def rule_states(changes: DataFrame) -> DataFrame:
    """A stream of changes (``rule_id, seq, at, reason`` and the rule fields) as states of the rules it touches."""
    slim = changes.select(
        "rule_id", "seq", F.unix_micros("at").alias("at_us"), "reason", F.to_json(F.struct(*FIELDS)).alias("fields"))
    return slim.mapInArrow(pack_changes, PACKS).groupBy("rule_id").transformWithState(RuleState(), STATES, "Append", "None")


def current_rules(states: DataFrame) -> DataFrame:
    """The rule table: the newest state of each living rule."""
    newest = states.groupBy("rule_id").agg(F.max(F.struct("seq", "alive", "created_us", "updated_us", "fields")).alias("now"))
    types = T.StructType([RULES[f] for f in FIELDS])
    return newest.filter("now.alive").select(
        "rule_id", F.from_json("now.fields", types).alias("f"), "now.created_us", "now.updated_us",
    ).select(
        "rule_id", "f.*", F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("updated_us").alias("updated_at"))
