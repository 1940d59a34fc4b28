"""The one-row plans of zone reads and of page layout against compositions of the operators, on random input."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import tables as T
from attesta.functions import text as X
from attesta.operators import layout, votes
from attesta.operators import pages as nested
from attesta.plans import zones
from attesta.sources.tables import PAGE, page_lines


def random_reads(seed):
    rng = random.Random(seed)
    raws = {
        "sex": ["M", "F", "?", " f"], "citizenship": ["TJK", "тҷк", "x"], "birthDate": ["01.02.1990", "01021990", "03.04.1991", "no"], "issueDate": ["05.06.2015", "05.06.2016", ""],
        "documentNumber": ["A12345678", "a12345678", "B12345678", "zz"], "nationalIdNumber": ["1234567890123", "1234567890124", "12"], "surname": ["САФАРОВ"],
    }
    rows = []
    for doc in range(60):
        for field, some in raws.items():
            for zone in range(rng.randrange(6)):
                x = rng.choice([0.0, 4.0, 8.0, 9.0, 100.0, 200.0])
                fixed = rng.random() < 0.25
                for pad in range(rng.randrange(1, 4)):
                    rows.append((doc, "front", field, "value", None, zone, pad, fixed, rng.choice([*some, None]), rng.choice([10.0, 39.0, 40.0, 60.0, 90.0, 97.4, 99.0]), x, 0.0, x + 50, 30.0))
    return rows


def test_front_facts_match_the_operators(spark):
    df = spark.createDataFrame(random_reads(1), zones.READS)
    keys = ["doc_id", "side", "field"]
    some = zones.parsed_front(zones.distinct_zones(df.where("not fixed")), 2024).where(~F.col("field").isin(T.NAME_FIELDS))
    by_vote = F.col("kind").isin("date", "digits13", "documentNumber")
    found = zones._facts(votes.first_read(some.where(~by_vote), keys, float("-inf")), "value", F.lit(zones.SHAPE_CONFIDENCE)).unionByName(zones._voted(some.where(by_vote), keys))
    rest = zones.parsed_front(df.where("fixed"), 2024).where(by_vote).join(found.select(*keys), keys, "left_anti")
    want = sorted(map(tuple, found.unionByName(zones._voted(rest, keys)).collect()))
    got = sorted(map(tuple, zones.front_zone_facts(df, 2024).collect()))
    assert len(want) > 150 and got == want


def test_front_facts_take_one_exchange(spark):
    facts = zones.front_zone_facts(spark.createDataFrame(random_reads(2), zones.READS), 2024)
    assert facts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def random_pages(seed):
    rng = random.Random(seed)
    some = ["Surname:", "Насаб/", "Document No.", "A1234567", "Sex", "M", "F", "Date of birth", "01/02/1990", "31.12.2001", "Nationality", "TJK", "САФАР", "x", "", " | ", "Place of birth", "National ID", "1234567890123", "Date of expiry"]
    word = lambda text, x, y: (text, rng.choice([10.0, 39.0, 40.0, 77.5, 95.0]), (float(x), float(y), float(x + rng.choice([20, 60])), float(y + 20)))
    pages = []
    for doc in range(200):
        lines = []
        for _ in range(rng.randrange(12)):
            x, y = rng.choice([0, 0, 150]), rng.choice([0, 15, 30, 60, 90])
            shown = " ".join(rng.choice(some) for _ in range(rng.randrange(4))).split(" ")
            words = [word(t, x + 70 * i, y) for i, t in enumerate(shown)]
            lines.append((" ".join(w[0] for w in words), rng.choice([24.0, 40.0, 80.0, 80.0, 91.0]), (float(x), float(y), float(x + 70 * max(1, len(words))), float(y + 20)), words))
        pages.append((doc, "front", [([(lines[:4],), (lines[4:],)],)]))
    return pages


def joined_layout(lines):
    """The layout fields by joins of labels with the words and lines of their page."""
    page = ["doc_id", "side"]
    hits = F.array(*[F.when(layout._labels(F.lit(f), F.col("text")), F.lit(f)) for f in T.FIELD_LABELS])
    h = lines.select(*page, "at", F.col("confidence").alias("seen"), F.col("bbox").alias("own"), "text", "words", F.explode(F.filter(hits, lambda f: f.isNotNull())).alias("field"))
    spans = F.filter(layout._spans(F.col("words")), lambda s: layout._labels(F.col("field"), s["text"]))
    h = h.withColumn("box", F.coalesce(layout._around(F.get(spans, F.lit(0))["words"]), F.col("own"))).withColumn("h", F.greatest(F.lit(1.0), F.col("box.y1") - F.col("box.y0")))
    keys = [*page, "at", "field"]
    beside = h.select(*keys, F.lit(0).alias("way"), F.lit(0.0).alias("far"), F.col("at").alias("i"), F.lit(0).alias("n"), layout._without_label(F.col("field"), F.col("text")).alias("raw"), F.col("seen").alias("c"))
    w = lines.select(*page, F.col("at").alias("i"), F.posexplode("words").alias("n", "w"))
    gap = F.col("w.bbox.y0") - F.col("box.y1")
    aside = F.abs((F.col("w.bbox.x0") + F.col("w.bbox.x1") - F.col("box.x0") - F.col("box.x1")) / 2)
    words = h.drop("words", "text").join(w, page).where((F.col("w.confidence") >= 40) & gap.between(-0.2 * F.col("h"), 3.5 * F.col("h")) & (aside <= F.greatest(F.col("box.x1") - F.col("box.x0"), 3 * F.col("h"))))
    words = words.select(*keys, F.lit(1).alias("way"), (F.greatest(F.lit(0.0), gap) + 0.25 * aside).alias("far"), "i", "n", F.col("w.text").alias("raw"), F.least("seen", "w.confidence").alias("c"))
    o = lines.select(*page, F.col("at").alias("i"), F.col("text").alias("raw"), F.col("confidence").alias("oc"), F.col("bbox").alias("ob")).where((F.col("oc") >= 40) & ~F.col("raw").rlike(X.label(T.LINE_LABELS)))
    drop = F.col("ob.y0") - F.col("box.y1")
    below = h.drop("words", "text").join(o, page).where((F.col("i") != F.col("at")) & drop.between(-0.25 * F.col("h"), 3.5 * F.col("h")) & (F.col("ob.x1") >= F.col("own.x0") - F.col("h")) & (F.col("ob.x0") <= F.col("own.x1") + 5 * F.col("h")))
    below = below.select(*keys, F.lit(2).alias("way"), (F.greatest(F.lit(0.0), drop) + 0.2 * F.abs(F.col("ob.x0") - F.col("own.x0"))).alias("far"), "i", F.lit(0).alias("n"), "raw", F.least("seen", "oc").alias("c"))
    every = beside.unionByName(words).unionByName(below).withColumn("value", X.validate_field(F.col("field"), F.col("raw"))).where("value is not null")
    best = every.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("way", "far", "i", "n"))).where("r = 1").withColumn("confidence", F.floor(F.col("c") + 0.5).cast("double"))
    top = Window.partitionBy(*page, "field").orderBy(F.col("confidence").desc(), "at")
    return best.withColumn("r", F.row_number().over(top)).where("r = 1").select(*page, "field", "value", "confidence")


def test_layout_fields_match_joins(spark):
    lines = page_lines(spark.createDataFrame(random_pages(3), PAGE))
    want = sorted(map(tuple, joined_layout(layout.clean_lines(lines)).collect()))
    got = sorted(map(tuple, layout.layout_fields(lines).collect()))
    assert len(want) > 60 and got == want


def joined_back(reads):
    """The back's facts by votes and merges over rows."""
    keys = ["doc_id", "side", "field"]
    parsed = reads.select(*zones.VALUE, "line", F.col("padding_seq").alias("seq"), X.parse_back_read(F.col("field"), F.col("part"), F.col("raw")).alias("value"), "confidence")
    of = lambda *fields: parsed.where(F.col("field").isin(*fields))
    best = votes.best_read(of("address"), [*keys, "line"], floor=zones.ADDRESS_FLOOR).select(*keys, "line", F.col("value").alias("text"), "confidence")
    lines = of("address").select(*keys, "line").distinct().join(best, [*keys, "line"], "left")
    address = zones._facts(votes.joined_lines(votes.take_while(lines, keys, "line", F.col("text").isNotNull()), keys, "line"), "value", F.col("confidence"))
    authority = zones._facts(votes.best_read(of("authority"), keys, floor=zones.AUTHORITY_FLOOR), "value", X.clamp(F.col("confidence"), 50, 90))
    part = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
    status = votes.first_read(of("maritalStatus"), zones.VALUE, 0.0).groupBy(*keys).agg(part("cyrillic").alias("c"), part("latin").alias("l"))
    marital = zones._facts(status, F.coalesce("c", "l"), F.when(F.col("c").isNull(), 60).when(F.col("l").isNotNull(), 90).otherwise(65))
    return address.unionByName(authority).unionByName(marital).unionByName(zones._voted(of("bloodGroup", "taxId"), keys))


def test_back_facts_match_the_operators_in_one_exchange(spark):
    rng = random.Random(3)
    raws = {
        "address": ["ш. Душанбе,", "к. Лоҳутӣ (2) -", "12", "дигар", "x"], "authority": ["ШВКД", "ШВКД ноҳияи 7", "ВКД ДАР ХАТЛОН", "1"], "maritalStatus": ["оиладор/", "/MARIED", "x", "МУҶАРРАД/SINGLE"],
        "bloodGroup": ["A(II)Rh-", "b(iii) rh+", "B(III)Rh+", "n/a", "?"], "taxId": ["123456789", "123456780", "12", "1234-56789"], "surname": ["САФАРОВ"],
    }
    rows = []
    for doc in range(120):
        for field, some in raws.items():
            for part in ("cyrillic", "latin", "value") if field == "maritalStatus" else ("value",):
                for line in rng.choice([[0], [0, 1, 2], [1, 2], [None], [None, 0]]) if field == "address" else (None,):
                    for pad in rng.sample(range(9), rng.randrange(5)):
                        rows.append((doc, "back", field, part, line, 0, pad, False, rng.choice([*some, *some, None]), rng.choice([None, -1.0, 0.0, 10.0, 39.0, 40.0, 50.0, 60.4, 92.0, 97.4, 99.0]), 0.0, 0.0, 50.0, 30.0))
    df = spark.createDataFrame(rows, zones.READS)
    key = lambda r: tuple(map(str, r))
    want, got = sorted(map(key, joined_back(df).collect())), sorted(map(key, zones.back_zone_facts(df).collect()))
    assert len(want) > 250 and got == want
    plan = zones.back_zone_facts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan


def test_what_several_tests_read_is_worked_out_once(spark):
    from attesta.functions import mrz
    from attesta.operators import names

    df = spark.createDataFrame([(1, "x", "x", "x", [])], "doc_id long, field string, part string, raw string, l array<string>")
    c = F.col
    plan = lambda column: df.select(column.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(X.parse_zone_read(c("field"), c("part"), c("raw"), 2024)).count("upper(") == 1
    assert plan(X.parse_back_read(c("field"), c("part"), c("raw"))).count("upper(") == 4  # one a branch
    assert plan(mrz.facts(F.struct(*[c("raw").alias(n) for n in "abc"]), 2024)).count("aggregate(") == 4
    assert plan(X.validate_text(c("raw"))).count("trim(") == 1
    # a page's lines are put in order once, however many places read them
    pages = spark.createDataFrame([], PAGE)
    lines = layout.cleaned(nested.lines_of(c("blocks")))
    found = pages.select(layout.page_fields(lines).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("array_sort(") + found.count("arraysort(") == 1
    # facts are exploded before those that are null go, so no filter works them out once more
    reads = spark.createDataFrame([], zones.READS)
    for facts in (zones.front_zone_facts(reads, 2024), zones.back_zone_facts(reads)):
        kept = [x for x in facts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
        assert not [x for x in kept if "transform(" in x]
    assert "CASE WHEN (size(l" in plan(names.hook_repair(c("raw"), c("l")))
