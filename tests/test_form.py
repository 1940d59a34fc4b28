"""The form as a stream: scans in turn and out of order, corrections, a restart, and only changed documents written."""

import json
from itertools import permutations

import pytest

from attesta.streaming import form


def scan(doc, at, side, attempt, **facts):
    return {"doc_id": doc, "at": at, "side": side, "attempt": attempt, "facts": [{"field": f, "value": v, "confidence": c, "source": "layout"} for f, (v, c) in facts.items()]}


def edit(doc, at, field, value):
    return {"doc_id": doc, "at": at, "field": field, "value": value}


class Runs:
    """Micro-batches: each call writes a file and runs the stream over it until nothing is left, from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def __call__(self, *rows):
        (self.folder / f"in/{self.n:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        self.n += 1
        stream = self.spark.readStream.schema(form.ARRIVALS).json(str(self.folder / "in"))
        q = form.write_form(form.form_changes(stream), str(self.folder / "out"), str(self.folder / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive
        return {(r.doc_id, r.field): (r.value, r.confidence, r.source) for r in form.read_form(self.spark, str(self.folder / "out")).collect()}

    def written(self):
        """Documents that each batch wrote."""
        rows = self.spark.read.parquet(str(self.folder / "out")).select("batch", "doc_id").distinct().collect()
        return {b: {r.doc_id for r in rows if r.batch == b} for b in {r.batch for r in rows}}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_scans_corrections_and_restarts(spark, tmp_path):
    run = Runs(spark, tmp_path)
    got = run(scan(1, 1, "front", 1, sex=("M", 80.0), name=("A", 90.0), low=("x", 34.0)), scan(2, 1, "front", 1, name=("B", 50.0)))
    assert got == {(1, "sex"): ("M", 80.0, "layout"), (1, "name"): ("A", 90.0, "layout"), (2, "name"): ("B", 50.0, "layout")}
    # each call starts the stream anew from its checkpoint: the front is still known when the back arrives
    got = run(scan(1, 2, "back", 1, sex=("F", 80.0), name=("Z", 95.0), tax=("7", 60.0)))
    assert got[1, "sex"] == ("M", 80.0, "layout") and got[1, "name"] == ("Z", 95.0, "layout") and got[1, "tax"] == ("7", 60.0, "layout")
    got = run(edit(1, 3, "sex", "F"), edit(1, 4, "own", "text"))
    assert got[1, "sex"] == ("F", None, None) and got[1, "own"] == ("text", None, None)
    # a scan anew: metadata is all of the new merge, values of fields that it lacks stay
    got = run(scan(1, 5, "back", 2, tax=("8", 70.0)))
    assert got[1, "name"] == ("A", 90.0, "layout") and got[1, "tax"] == ("8", 70.0, "layout") and got[1, "sex"] == ("M", 80.0, "layout") and got[1, "own"] == ("text", None, None)
    got = run(scan(1, 6, "front", 2))
    assert got[1, "name"] == ("A", None, None) and got[1, "sex"] == ("M", None, None) and got[1, "tax"] == ("8", 70.0, "layout")
    # an attempt that was overtaken changes nothing that is known
    assert run(scan(1, 1, "front", 1, sex=("Q", 99.0))) == got
    assert run({"doc_id": None, "at": 1, "side": "front", "attempt": 1}) == got
    assert {2} not in list(run.written().values())[1:] and all(2 not in docs for b, docs in run.written().items() if b > 0)


def test_any_order_gives_one_form(spark, tmp_path):
    events = [scan(9, 1, "front", 1, a=("old", 90.0), b=("kept", 80.0)), scan(9, 2, "back", 1, a=("back", 60.0), c=("c", 50.0)), edit(9, 3, "c", "mended"), scan(9, 4, "front", 2, a=("new", 70.0))]
    want = {(9, "a"): ("new", 70.0, "layout"), (9, "b"): ("kept", None, None), (9, "c"): ("c", 50.0, "layout")}
    orders = list(permutations(events))
    for i, order in enumerate([orders[0], orders[7], orders[-1]]):
        folder = tmp_path / str(i)
        folder.mkdir()
        run = Runs(spark, folder)
        for event in order:
            got = run(event)
        assert got == want, i
    folder = tmp_path / "one"
    folder.mkdir()
    assert Runs(spark, folder)(*reversed(events)) == want  # in one batch


class Held(dict):
    """A map state in memory."""

    def iterator(self):
        return iter(list(self.items()))

    def keys(self):
        return list(dict.keys(self))

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def getMapState(self, *_):
        return Held()


def form_after(events):
    keeper, now = form.FormKeeper(), {}
    keeper.init(Handle())
    full = {"side": None, "attempt": None, "facts": None, "field": None, "value": None}
    for e in events:
        for r in keeper.handleInputRows((e["doc_id"],), iter([full | e]), None):
            now[r["field"]] = (r["value"], r["confidence"], r["source"])
    return now


def test_every_order_of_arrival():
    events = [
        scan(9, 1, "front", 1, a=("old", 90.0), b=("kept", 80.0), e=("scan", 70.0)), scan(9, 2, "back", 1, a=("back", 60.0), c=("c", 50.0)), edit(9, 3, "c", "mended"),
        scan(9, 4, "front", 2, a=("new", 70.0)), edit(9, 5, "e", "typed"),
    ]
    want = form_after(events)
    assert want == {"a": ("new", 70.0, "layout"), "b": ("kept", None, None), "c": ("c", 50.0, "layout"), "e": ("typed", None, None)}
    for order in permutations(events):
        assert form_after(order) == want
