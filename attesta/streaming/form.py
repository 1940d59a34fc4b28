"""The form of each document kept up to date as scans of its sides and corrections arrive, in any order.

State is held by document in the state store, so a micro-batch touches only
the documents that it names, and writes only the fields that it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: An arrival: a scan of a side with its facts, or, where side is null, a correction of one field.
ARRIVALS = "doc_id long, at long, side string, attempt long, facts array<struct<field: string, value: string, confidence: double, source: string>>, field string, value string"
FORM = "doc_id long, field string, value string, confidence double, source string"
#: Sides in the order in which equal confidences are settled, and the least confidence that fills a field.
SIDES, FLOOR = ("front", "back"), 35.0
#: The state store that keyed state of several kinds needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def best_facts(facts: dict[str, dict[str, tuple]]) -> dict[str, tuple]:
    """{field: (value, confidence, source)} of both sides: the most confident one, the front's of equal ones."""
    best: dict[str, tuple] = {}
    for side in SIDES:
        for field, fact in facts.get(side, {}).items():
            if fact[0] and fact[1] is not None and fact[1] >= FLOOR and (field not in best or fact[1] > best[field][1]):
                best[field] = fact
    return best


class FormKeeper(StatefulProcessor):
    """One document's form.

    A newer attempt replaces a side's facts. Then all fields take the metadata
    of the two sides' facts merged anew, and none where the merge has no such
    field; values change only where the merge has one, so that what an earlier
    attempt read stays. A correction sets a value and clears its metadata. Each
    value has the time of the scan or correction that set it, and none older
    replaces it: a scan that a newer attempt of its side has overtaken only
    fills fields that have no newer value. Of one attempt the first arrival counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getMapState("attempts", "side string", "attempt long, at long")
        self.facts = handle.getMapState("facts", "side string, field string", "value string, confidence double, source string")
        self.form = handle.getMapState("form", "field string", "value string, confidence double, source string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = {k[0]: tuple(v) for k, v in self.form.iterator()}
        form = dict(before)
        attempts = {k[0]: tuple(v) for k, v in self.attempts.iterator()}
        facts: dict[str, dict[str, tuple]] = {}
        for (side, field), fact in self.facts.iterator():
            facts.setdefault(side, {})[field] = tuple(fact)
        order = lambda r: (r["at"] is not None, r["at"] or 0, r["side"] is not None, r["side"] or "", r["attempt"] or 0, r["field"] or "", r["value"] or "")
        renewed = set()
        for r in sorted(rows, key=order):
            at = r["at"] or 0
            if r["side"] is None:
                if r["field"] is not None and at >= form.get(r["field"], (None, None, None, at))[3]:
                    form[r["field"]] = (r["value"] or "", None, None, at)
                continue
            read = {f["field"]: (f["value"], f["confidence"], f["source"]) for f in r["facts"] or []}
            attempt = r["attempt"] or 0
            if r["side"] in attempts and attempt <= attempts[r["side"]][0]:
                if attempt < attempts[r["side"]][0]:
                    for field, fact in best_facts({SIDES[0]: read}).items():
                        if field not in form or at > form[field][3]:
                            form[field] = (fact[0], *form.get(field, (None, None, None))[1:3], at)
                continue
            attempts[r["side"]], facts[r["side"]] = (attempt, at), read
            renewed.add(r["side"])
            merged, latest = best_facts(facts), max(a for _, a in attempts.values())
            # a correction newer than both scans keeps its field
            form = {f: (v[0], None, None, v[3]) for f, v in form.items()} | {f: (*fact, latest) for f, fact in merged.items() if latest >= form.get(f, (0, 0, 0, latest))[3]}
        for side in renewed:
            self.attempts.updateValue((side,), attempts[side])
            for held in [k for k in self.facts.keys() if k[0] == side]:
                self.facts.removeKey(tuple(held))
            for field, fact in facts[side].items():
                self.facts.updateValue((side, field), fact)
        for field, v in form.items():
            if before.get(field) != v:
                self.form.updateValue((field,), v)
                if before.get(field, (None,) * 4)[:3] != v[:3]:
                    yield Row(doc_id=key[0], field=field, value=v[0], confidence=v[1], source=v[2])

    def close(self) -> None:
        pass


def form_changes(arrivals: DataFrame) -> DataFrame:
    """A stream of the form's fields (FORM) as they change, from a stream of ARRIVALS. Arrivals without a document are left out."""
    arrivals.sparkSession.conf.set(*PROVIDER)
    known = arrivals.where("doc_id is not null")
    return known.groupBy("doc_id").transformWithState(FormKeeper(), FORM, "Update", "None")


def write_form(changes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch's changes in a folder of their own, which a repeated batch overwrites. path and checkpoint are shared folders."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_form(spark: SparkSession, path: str) -> DataFrame:
    """The form as it is now: of each document's field the latest change."""
    rows = spark.read.schema(f"{FORM}, batch long").parquet(path)
    last = rows.groupBy("doc_id", "field").agg(F.max_by(F.struct("value", "confidence", "source"), "batch").alias("v"))
    return last.select("doc_id", "field", "v.*")
