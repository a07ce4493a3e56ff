"""Checks of the constraints a relational store would enforce, all in one pass.

Every table is scanned once, whatever the number of rules on it. A row becomes a
tagged key for each rule it matters to: its own key for uniqueness, the key it
names or offers for a reference, no key for a broken row rule. The tags of all
tables are summed per (rule, key) in one shuffle, combined per task first, so a key
that very many rows share is one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIQUE, ROW, REFERENCE = "unique", "row", "reference"


@dataclass(frozen=True, eq=False)
class Tag:
    """What a table's rows say to a rule: the key, when it counts, and whether it is a parent's key."""

    rows: DataFrame
    key: Column
    counts: Column
    parent: bool = False


@dataclass(frozen=True, eq=False)
class Rule:
    table: str
    name: str
    kind: str
    tags: tuple[Tag, ...]


def _key(*names: str) -> tuple[Column, Column]:
    """A key as a string, and whether all of it is there."""
    present = reduce(Column.__and__, [F.col(name).isNotNull() for name in names])
    value = F.col(names[0]).cast("string") if len(names) == 1 else F.to_json(F.array(*[F.col(n).cast("string") for n in names]))
    return value, present


def unique(rows: DataFrame, table: str, *key: str) -> list[Rule]:
    """Rows beyond the first of every non-null key."""
    return [Rule(table, f"unique({', '.join(key)})", UNIQUE, (Tag(rows, *_key(*key)),))]


def row_rules(rows: DataFrame, table: str, not_null: list[str] = (), max_length: dict[str, int] | None = None) -> list[Rule]:
    """NOT NULL and VARCHAR(n) rules of one table."""
    rules = {f"not_null({name})": F.col(name).isNull() for name in not_null}
    rules |= {f"length({name}) <= {n}": F.length(name) > n for name, n in (max_length or {}).items()}
    nothing = F.lit(None).cast("string")
    return [Rule(table, name, ROW, (Tag(rows, nothing, broken),)) for name, broken in rules.items()]


def references(rows: DataFrame, table: str, key: str, parents: DataFrame, parent_key: str = "id") -> list[Rule]:
    """Rows whose non-null key names no parent."""
    tags = Tag(rows, *_key(key)), Tag(parents, *_key(parent_key), parent=True)
    return [Rule(table, f"foreign key({key})", REFERENCE, tags)]


def audit(*rules: list[Rule]) -> DataFrame:
    """(table_name, constraint_name, violations) of every rule; zero where nothing breaks it."""
    every = [rule for group in rules for rule in group]
    scans: dict[int, tuple[DataFrame, list[Column]]] = {}
    for number, rule in enumerate(every):
        for tag in rule.tags:
            said = F.struct(
                F.lit(number).alias("rule"), F.lit(rule.kind).alias("kind"), tag.key.alias("key"), F.lit(tag.parent).alias("parent")
            )
            scans.setdefault(id(tag.rows), (tag.rows, []))[1].append(F.when(tag.counts, said))
    tagged = [rows.select(F.inline(F.array_compact(F.array(*said)))) for rows, said in scans.values()]
    keys = reduce(DataFrame.unionByName, tagged).groupBy("rule", "kind", "key").agg(
        F.count_if(~F.col("parent")).alias("n"), F.max("parent").alias("known")
    )
    broken = (
        F.when(F.col("kind") == UNIQUE, F.col("n") - 1)
        .when((F.col("kind") == REFERENCE) & F.col("known"), 0)
        .otherwise(F.col("n"))
    )
    sums = keys.groupBy("rule").agg(F.sum(broken).alias("violations"))
    spark = sums.sparkSession
    named = spark.createDataFrame(
        [(number, rule.table, rule.name) for number, rule in enumerate(every)], "rule int, table_name string, constraint_name string"
    )
    # one row per rule
    return named.join(F.broadcast(sums), "rule", "left").select(
        "table_name", "constraint_name", F.coalesce("violations", F.lit(0)).cast("long").alias("violations")
    )
