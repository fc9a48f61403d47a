"""A gated ingest: rows are checked while they are put into a store, by the same job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.gates import consistency_rules, rule_facts
from .store import PanelStore

REPORT = "dataset string, rule string, n long, first_date date"


def checked_upsert(store: PanelStore, dataset: str, rows: DataFrame, order: list[str] | None = None, batch: tuple[str, int] | None = None) -> tuple[int, DataFrame]:
    """Puts the rows in and returns how many keys were put, and the warnings: a row a rule that some rows break.

    The rules are counted by an observation of the write, so that the rows are read once. Contradictions don't keep rows out.
    A batch that the store has already is neither written nor counted.
    """
    rules = consistency_rules(rows.columns)
    watch = Observation()
    seen = rows.observe(watch, F.count(F.lit(1)).alias("rows"), *rule_facts(rules))
    old = store._manifest(dataset)
    again = old and batch and old["batches"].get(batch[0], -1) >= batch[1]
    put = 0 if again else store.upsert(dataset, seen, order, batch)
    facts = {} if again else watch.get
    found = [(dataset, k, facts[k], facts[f"{k}_first"]) for k in rules if facts.get(k)]
    return put, rows.sparkSession.createDataFrame(found, REPORT)
