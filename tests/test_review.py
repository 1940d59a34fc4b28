"""What a review of larger tables found: one small case for each finding."""

from attesta.operators import layout, names


def test_equal_zone_reads_fall_to_the_first(spark):
    rows = [(k, 1, 0, seq, 2, 50) for k in range(40) for seq in (7, 3, 9, 5)]
    reads = spark.createDataFrame(rows, "k int, turn int, area int, seq int, score int, confidence int")
    got = layout.best_zone_read(reads, ["k"]).collect()
    assert len(got) == 40 and {r.seq for r in got} == {3}


LINE = "doc_id long, side string, seq int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def test_names_that_hold_a_label_word_are_names(spark):
    texts = ["САФАНИШОНА", "НИШОНОВ", "НИШОН", "НИШОНӢ", "НИШОНИ ДОИМӢ", "САФА НИШОНИ"]
    lines = spark.createDataFrame([(1, "front", i, t, 80.0, 0.0, 100.0 * i, 300.0, 100.0 * i + 40) for i, t in enumerate(texts)], LINE)
    assert {r.text for r in names.script_lines(lines, "cyrillic").collect()} == {"САФАНИШОНА", "НИШОНОВ"}


def test_lines_that_both_scripts_confirm_are_not_bent_to_a_machine_read_name(spark):
    # with a hook flipped МУРХААА comes within 0.3 of the machine-read surname
    rows = [(d, "front", i, c, l, 80.0, 0.0, 200.0 * i, 300.0, 200.0 * i + 40) for d, tail, other in ((1, "ХААА", "KHAAA"), (2, "ХААААА", "KHAAAAA")) for i, (c, l) in enumerate((("САФА" + tail, "SAFA" + other), ("ДАВ" + tail, "DAV" + other), ("МУР" + tail, "MUR" + other)))]
    pairs = spark.createDataFrame(rows, "doc_id long, side string, seq int, cyrillic string, latin string, confidence double, x0 double, y0 double, x1 double, y1 double")
    none = spark.createDataFrame([], "doc_id long, side string, field string, cyrillic string, latin string, confidence double, x0 double, y0 double, x1 double, y1 double")
    labelled = spark.createDataFrame([], "doc_id long, side string, field string, value string, confidence double")
    machine = spark.createDataFrame([(1, "back", "surname", "MHAAA"), (2, "back", "surname", "MHAAAAA"), (1, "back", "givenNames", "NHAAA")], "doc_id long, side string, field string, value string")
    got = {(r.doc_id, r.field): r.value for r in names.resolve_names(pairs, none, labelled, machine).collect()}
    assert got == {(d, f): h + t for d, t in ((1, "ХААА"), (2, "ХААААА")) for f, h in (("surname", "САФА"), ("givenNames", "ДАВ"), ("fatherName", "МУР"))}


def test_places_of_a_front_need_no_shuffle(spark):
    from attesta.plans import page_queries, zones

    pages = page_queries.front_pages(spark, "/root/testdata/sf0.001")
    before = pages._jdf.queryExecution().executedPlan().toString().count("Exchange")
    found = zones.locate_front_zones(pages, ["doc_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == before and "Join" not in plan


def test_tables_are_dealt_to_more_tasks_as_they_grow(spark):
    from attesta.sources.tables import dealt

    rows = spark.range(5000).withColumnRenamed("id", "k")
    assert [dealt(rows, "k", n).rdd.getNumPartitions() for n in (5000, 500, 100)] == [4, 10, 50]


def test_zones_are_parsed_after_rows_are_dealt(spark):
    from attesta.plans import queries

    for query in (queries.mrz_roundtrip_fields, queries.fields_pivot_wide):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "transform" in plan and "transform" not in plan.split("RepartitionByExpression")[1]
    assert "RepartitionByExpression" in queries.name_alignment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_dealt_before_their_cells_are_made(spark):
    from attesta.plans import page_queries

    plan = page_queries.page_tilt(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # both ways of summing read the pages twice, for their cells and for their sizes
    assert plan.count("RepartitionByExpression") == plan.count("Relation [") > 0


def test_area_mean_takes_one_exchange(spark):
    from attesta.operators import fit

    cells = spark.range(100).selectExpr("id % 3 AS k", "id AS y", "id AS x", "1D AS value")
    assert fit.area_mean(cells, ["k"], 2, 4)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_merged_pages_are_worked_out_once(spark):
    from attesta.plans import page_queries

    plan = page_queries.label_overlay_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "map_from_entries" in line]


def test_texts_are_dealt_compressed_and_come_back_in_order(spark, monkeypatch):
    import hashlib

    import pyarrow as pa

    from attesta.llm import fingerprint

    texts = ["", None, "a", "ӣ 漢 😀 " * 40, "word " * 3000, "\x00 x", "b" * 70, "ab"]
    rows = [(None if i % 9 == 0 else i // 2 * 3, texts[i * 5 % 8]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # batches are cut by the bytes of their texts
    monkeypatch.setattr(fingerprint, "UNPACKED_BYTES", 100)
    known = [t or "" for t in texts]
    packed = next(fingerprint._packed(iter([pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(known)], ["raw", "t"])])))
    keys = [pa.array([0] * 8), pa.array([False] * 8), pa.array(range(8))]
    back = list(fingerprint._unpacked(iter([pa.RecordBatch.from_arrays([*keys, *packed.columns], ["range", "guest", "id", "raw", "size", "z"])])))
    assert [b.num_rows for b in back] == [3, 1, 1, 3] and [t for b in back for t in b.column(4).to_pylist()] == known and max(packed.column(1).to_pylist()) == 15_000
    found = fingerprint.document_fingerprints(docs)
    dealt = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
    assert "_packed" in dealt
    # by falling id, null last, then by text; the last one meets the first
    order = sorted(((-1 if i is None else i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1].encode()))
    want = sorted((i, len(t), hashlib.sha256(fingerprint.edited(t, order[(k + 1) % 60][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in found.collect()) == want


def test_tables_of_a_search_are_never_broadcast(spark):
    from attesta.llm import fingerprint

    some = spark.createDataFrame([("0f" * 32,), ("f0" * 32,)], "fingerprint string")
    found = fingerprint.find_near(some, some)
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("0f" * 32, "0f" * 32, 0), ("f0" * 32, "f0" * 32, 0)]


def test_lines_of_an_order_meet_without_a_window(spark):
    from attesta.plans import page_queries

    for query in (page_queries.page_segments, page_queries.label_overlay_pages):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # one sort, that of each order's array; words are made before they are collected
        assert "Window" not in plan and plan.count("collect_list(s#") == plan.count("sort_array") == 1


def test_single_words_bits_are_added_as_bytes():
    import tracemalloc

    from attesta.llm import fingerprint

    text = " ".join(f"w{i}" for i in range(20_000))
    tracemalloc.start()
    try:
        fingerprint.fingerprint(text, fingerprint.WordHashes())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # a block of 8,160 words' bits as doubles is 16.7 MB
    assert peak < 12e6


def test_edited_texts_take_over_the_votes_of_both_texts(monkeypatch):
    import random

    import numpy as np

    from attesta.llm import fingerprint

    rng, known = random.Random(5), fingerprint.WordHashes()
    parts = ["a", "b", "aB", "Ä", "漢", " ", "  ", "\n", "\t ", "\x0b", "\x0c", "\x1c", "\x85", "　", "word", "😀", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.choice((0, 1, 2, 3, 6, 12, 40)))) for _ in range(1500)]
    texts += ["same text"] * 3 + [" ".join(str(rng.randrange(v)) for _ in range(n)) for v in (3, 1000, 10**9) for n in (680, 2039, 2041, 9000)]
    first, at = None, 0
    while at < len(texts):
        docs, pairs = [], []
        for t in texts[at : at + rng.choice((1, 2, 20))]:
            docs.append(fingerprint.Doc(t))
            pairs += [(first, docs[-1])] if first else []
            first = docs[-1] if rng.random() < 0.9 else None
        at += len(docs)
        new = fingerprint.fingerprint_all(docs, pairs, known)
        assert [d.fingerprint for d in docs] == [fingerprint.fingerprint(d.text, known) for d in docs]
        assert new == [fingerprint.fingerprint(fingerprint.edited(a.text, b.text), known) for a, b in pairs]
    # a term of a document is hashed once for it and the edited texts that have it
    unpacked = []
    monkeypatch.setattr(fingerprint.np, "unpackbits", lambda x, unpack=np.unpackbits, **more: unpacked.append(x.size // 32) or unpack(x, **more))
    docs = [fingerprint.Doc(" ".join(str(rng.randrange(10**9)) for _ in range(500))) for _ in range(40)]
    fingerprint.fingerprint_all(docs, list(zip(docs, docs[1:])), known)
    assert sum(unpacked) < 1.1 * 40 * 3 * 500


def test_missing_zones_need_no_join(spark):
    from attesta.functions import tables as T
    from attesta.plans import queries, zones

    reads = spark.createDataFrame([(1, "front"), (1, "front"), (2, "back"), (3, "front"), (4, "front"), (None, "front")], "doc_id long, side string")
    found = spark.createDataFrame([(1, f) for f, *_ in T.FIXED_ZONES[1:]] + [(2, "sex"), (3, "sex"), (3, None), (5, "sex"), (None, "expiryDate")], "doc_id long, field string")
    got = zones.missing_zones(reads, found)
    want = {(d, f, *r) for d, n in ((1, 1), (3, 5), (4, 5), (None, 5)) for f, *r in T.FIXED_ZONES[:n]}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and got.columns == ["doc_id", "field", "x", "y", "width", "height"]
    # facts that are joined are broadcast by the driver, at any size
    assert "Join" not in queries.missing_zone_fallback(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
