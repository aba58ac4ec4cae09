"""How filters interact: what each removes at each place of each order.

Every document fails some of the filters; per part, the numbers of documents by failed filters are
a 2x2x..x2 contingency tensor with an axis a filter. Each figure of each step of each order is a
contraction of it: along an axis it takes those that pass, those that fail, or all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from operator import add
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed, scratch, tables_in
from .text import written

# The limits of the filters.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"

# Parts contracted at a time.
PARTS = 32
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (many capitals), D (symbols)."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        F.regexp_like(text, F.lit(SYMBOLS)),
    ]


def document_failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, failed) per row; bit k of ``failed`` is set if it fails filter k.

    Texts are equal if their SHA-256 is. The first of equal texts is found by an aggregate that
    collapses copies before the shuffle, and met again by its digest and id, so rows of a
    text that many rows share are not gathered.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"),
    ).select(
        "doc_id", "part", _mask(text_failures(F.col("text"))).alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(firsts, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.col("failed").bitwiseOR(F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))


def _mask(failures: list[Column]) -> Column:
    return reduce(add, [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures)])


def lost_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, good, toxic): 1 where any row of the id says quality 1, or toxic 1; else 0."""
    return labels.groupBy(F.col(id_col).alias("doc_id")).agg(*[
        F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))])


def step_selectors(n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of n filters, and for each figure (order and step, axis, pass or fail) what it takes."""
    orders = list(permutations(range(n)))
    taken = {name: np.empty((len(orders) * n, n, 2), np.int64) for name in ("kept", "removed", "failed", "alone")}
    for row, (order, step) in enumerate((o, s) for o in orders for s in range(n)):
        for place, axis in enumerate(order):
            own = place == step
            taken["kept"][row, axis] = PASS if place <= step else ALL
            taken["removed"][row, axis] = FAIL if own else PASS if place < step else ALL
            taken["failed"][row, axis] = FAIL if own else ALL
            taken["alone"][row, axis] = FAIL if own else PASS
    return orders, taken


def contract(tensor: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """(.., 2, .., 2) counts by (rows, axis, 2) choices: (.., rows)."""
    n = taken.shape[1]
    axes = list(range(n))
    operands = [x for k in axes for x in (taken[:, k], [n, k])]
    return np.einsum(tensor, [..., *axes], *operands, [..., n])


def audited(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Figures per part, order of the filters and step.

    ``counts`` has part, failed (bits by filter), n, good, toxic: numbers of documents. A part has
    at most 2 ** len(filters) rows of it; the rows of other parts don't matter to it.
    """
    n = len(filters)
    orders, taken = step_selectors(n)
    own = np.array([order[step] for order in orders for step in range(n)])
    names = pa.array(["".join(filters[k] for k in order) for order in orders for _ in range(n)])
    steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                yield figures(batch.slice(at, PARTS))

    def figures(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = batch.num_rows
        cells = batch.column("cells")
        flat = cells.flatten()
        part = np.repeat(np.arange(parts), cells.value_lengths().to_numpy(zero_copy_only=False))
        cell = flat.field("failed").to_numpy(zero_copy_only=False)
        tensor = np.zeros((parts, 3, 1 << n), np.int64)
        for k, name in enumerate(("n", "good", "toxic")):
            tensor[part, k, cell] = flat.field(name).to_numpy(zero_copy_only=False)
        # Bit 0 is the fastest axis of the flat cell number, hence the last one.
        tensor = tensor.reshape(parts, 3, *[2] * n).transpose(0, 1, *range(n + 1, 1, -1))
        lost = contract(tensor, taken["removed"])
        everything = tensor[:, 0]
        removed = lost[:, 0]
        shares = np.stack([removed[:, own == k].sum(axis=1) for k in range(n)], axis=1)
        found = {
            "kept": contract(everything, taken["kept"]),
            "removed": removed,
            "redundant": contract(everything, taken["failed"]) - removed,
            "unique_fails": contract(everything, taken["alone"]),
            "good_lost": lost[:, 1],
            "toxic_lost": lost[:, 2],
            "shapley": shares[:, own],
        }
        return pa.RecordBatch.from_pydict({
            "part": batch.column("part").take(pa.array(np.repeat(np.arange(parts), len(own)))),
            "filter_order": names.take(pa.array(np.tile(np.arange(len(own)), parts))),
            "step": np.tile(steps, parts),
            **{name: found[name].reshape(-1) for name in COUNTS},
        })

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return cells.mapInArrow(run, schema)


def filter_interactions(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """The audit of the filters A to E: a row per part, order and step, zeros included.

    Null text counts as empty, a null part as empty text. Repeated rows count each; those with the
    id of the first of their text are not later copies, nor is a row without an id. A row without
    an id or a label counts as neither good nor toxic; an id labelled more than once is good (or
    toxic) if any of its labels says so. An empty table has no parts and gives no row. Only the
    named columns are read. A text is held whole in one task, its words in an array.
    """
    spark = docs.sparkSession
    with scratch(spark):
        failures = document_failures(docs, id_col, text_col, part_col)
        marked = failures.join(lost_labels(labels), "doc_id", "left").fillna(0, ["good", "toxic"])
        counts = marked.groupBy("part", "failed").agg(
            F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        with tables_in(None):  # these few rows stay
            counts = written(counts, "filter-audit")
    return audited(counts)
