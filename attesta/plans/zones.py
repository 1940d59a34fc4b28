"""Plans from reads of known places on a card, front and back, to facts.

Reads are rows (doc_id, side, field, part, line, zone_seq, padding_seq, fixed,
raw, confidence, x0, y0, x1, y1): one recognised crop of one rectangle.
`fixed` marks the rectangles that stand at the same share of every card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import tables as T
from attesta.functions import text as X
from attesta.operators import fit, names, spatial, votes
from attesta.operators import pages as nested

READS = (
    "doc_id long, side string, field string, part string, line int, zone_seq int, padding_seq int, fixed boolean, raw string, confidence double, "
    "x0 double, y0 double, x1 double, y1 double"
)
#: Rectangles tried for one value, and how near two of them are that count as one.
MAX_ZONES, SAME_ZONE = 3, 8.0
#: Confidence of a value whose shape alone settles it.
SHAPE_CONFIDENCE = 85.0
#: Least confidence of an address line, of an authority and of a value read once.
ADDRESS_FLOOR, AUTHORITY_FLOOR, SHAPED_FLOOR, ZONE_FLOOR = 40.0, 50.0, 40.0, 60.0
VALUE = ["doc_id", "side", "field", "part"]
BOX = ["x0", "y0", "x1", "y1"]


def distinct_zones(reads: DataFrame) -> DataFrame:
    """Reads of the first MAX_ZONES rectangles of each value; one within SAME_ZONE pixels of an earlier one that stays is left out."""
    zones = reads.groupBy(*VALUE, "zone_seq").agg(*[F.first(b).alias(b) for b in BOX])
    near = lambda a, b: F.forall(F.array(*[F.abs(a[c] - b[c]) for c in BOX]), lambda d: d <= SAME_ZONE)
    every = zones.groupBy(*VALUE).agg(F.sort_array(F.collect_list(F.struct("zone_seq", *BOX))).alias("z"))
    kept = F.aggregate("z", F.slice("z", 1, 0), lambda acc, z: F.when(F.exists(acc, lambda k: near(k, z)), acc).otherwise(F.concat(acc, F.array(z))))
    chosen = every.select(*VALUE, F.explode(F.slice(kept, 1, MAX_ZONES)["zone_seq"]).alias("zone_seq"))
    return reads.join(chosen, [*VALUE, "zone_seq"], "left_semi")


def _facts(df: DataFrame, value: Column | str, confidence: Column) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.select("doc_id", "side", "field", v.alias("value"), confidence.cast("double").alias("confidence"), F.lit("layout").alias("source"))


def _of_groups(rows: DataFrame, fact: Column) -> DataFrame:
    """The facts struct<value, confidence> of rows (doc_id, side, field, …), without those that are null.

    These go after facts are exploded: a filter on the fact itself would be
    pushed below and work it out once more.
    """
    found = rows.select("doc_id", "side", "field", F.explode_outer(F.array(fact)).alias("f")).where("f is not null")
    return found.select("doc_id", "side", "field", "f.*", F.lit("layout").alias("source"))


def _voted(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Shaped values by vote: two equal reads, or one of enough confidence; between 86 and 97."""
    won = votes.first_to_two(reads, keys)
    floor = F.when(F.col("field").isin("nationalIdNumber", "documentNumber", "bloodGroup", "taxId"), SHAPED_FLOOR).otherwise(ZONE_FLOOR)
    return _facts(won.where((F.col("votes") >= 2) | (F.col("confidence") >= floor)), "value", X.clamp(F.col("confidence"), 86, 97))


def parsed_front(reads: DataFrame, as_of_year: int) -> DataFrame:
    """Front reads with their parsed value, kind and order; reads that do not parse have no value."""
    order = (F.col("zone_seq") * 100 + F.col("padding_seq")).alias("seq")
    value = X.parse_zone_read(F.col("field"), F.col("part"), F.col("raw"), as_of_year)
    return reads.select(*VALUE, order, value.alias("value"), X.zone_kind(F.col("field"), F.col("part")).alias("kind"), "confidence", *BOX)


def front_name_reads(reads: DataFrame, as_of_year: int) -> DataFrame:
    """(doc_id, side, field, part, seq, value, confidence, box): the first two different reads of each name in each script."""
    parsed = parsed_front(distinct_zones(reads.where(~F.col("fixed") & F.col("field").isin(T.NAME_FIELDS))), as_of_year)
    some = votes.distinct_reads(parsed, VALUE, 2, first_confidence=True)
    return some.join(parsed.select(*VALUE, "seq", *BOX), [*VALUE, "seq"]).drop("place")


def _settled(reads: Column) -> Column:
    """struct<value, votes, confidence> of reads (value, confidence) in order: the first value to come twice, else the most confident one; as votes.first_to_two."""

    def of(some: Column) -> Column:
        again = lambda r, i: X.let(F.array_position(F.transform(some, lambda x: x["value"]), r["value"]), lambda first: F.when(first < i + 1, F.struct(i.alias("i"), first.cast("int").alias("first"))))
        twice = F.array_min(F.filter(F.transform(some, again), lambda x: x.isNotNull()))
        at = lambda i: F.get(some, i)
        agreed = lambda t: F.struct(at(t["i"])["value"].alias("value"), F.lit(2).alias("votes"), F.greatest(at(t["i"])["confidence"], at(t["first"] - 1)["confidence"]).alias("confidence"))
        surest = X.let(F.array_min(F.transform(some, lambda r, i: F.struct(F.coalesce(-r["confidence"], F.lit(float("inf"))).alias("k"), i.alias("i"))))["i"], lambda i: F.when(i.isNotNull(), F.struct(at(i)["value"].alias("value"), F.lit(1).alias("votes"), at(i)["confidence"].alias("confidence"))))
        return X.let(twice, lambda t: F.when(t.isNotNull(), agreed(t)).otherwise(surest))

    return X.let(F.filter(reads, lambda r: r["value"].isNotNull()), of)


def front_zone_facts(reads: DataFrame, as_of_year: int) -> DataFrame:
    """(doc_id, side, field, value, confidence, source) of the front's values, names apart.

    Rectangles under a label go first; a field that they leave empty is taken
    from the fixed ones. Each read is parsed once; the reads of a field meet in
    one row, where rectangles are told apart, votes counted and floors applied.
    """
    value = X.parse_zone_read(F.col("field"), F.col("part"), F.col("raw"), as_of_year)
    parsed = reads.where(~F.col("field").isin(T.NAME_FIELDS)).select(*VALUE, "zone_seq", "padding_seq", "fixed", value.alias("value"), "confidence", *BOX)
    # the kind of a value follows from its field: parts are told apart for names only
    row = F.struct("zone_seq", "padding_seq", "part", "fixed", "value", "confidence", *BOX)
    rows = parsed.groupBy("doc_id", "side", "field").agg(F.sort_array(F.collect_list(row)).alias("r"), F.bool_or(X.zone_kind(F.col("field"), F.col("part")).isin("date", "digits13", "documentNumber")).alias("by_vote"))
    near = lambda a, z: F.forall(F.array(*[F.abs(a[c] - z[c]) for c in BOX]), lambda d: d <= SAME_ZONE)
    same = lambda kept, r: F.filter(kept, lambda k: k["part"] == r["part"])
    opens = lambda kept, r: X.let(same(kept, r), lambda k: ~F.exists(k, lambda z: z["zone_seq"] == r["zone_seq"]) & ~F.exists(k, lambda z: near(z, r)) & (F.size(k) < MAX_ZONES))
    seen = lambda tried, r: F.exists(tried, lambda z: (z["part"] == r["part"]) & (z["zone_seq"] == r["zone_seq"]))
    # a rectangle is judged by its first read: those that stay, and all that were judged
    label_reads = F.filter("r", lambda r: ~r["fixed"])
    firsts = lambda rs: F.filter(F.transform(rs, lambda r, i: F.when(~seen(F.slice(rs, 1, i), r), r)), lambda r: r.isNotNull())
    kept = F.aggregate(firsts(F.col("u")), F.slice("u", 1, 0), lambda acc, r: F.when(opens(acc, r), F.concat(acc, F.array(r))).otherwise(acc))
    some = rows.withColumn("u", label_reads).withColumn("k", kept)
    chosen = F.filter("u", lambda r: seen(F.col("k"), r))
    floor = F.when(F.col("field").isin("nationalIdNumber", "documentNumber", "bloodGroup", "taxId"), SHAPED_FLOOR).otherwise(ZONE_FLOOR)
    voted = lambda rs: X.let(_settled(rs), lambda w: F.when((w["votes"] >= 2) | (w["confidence"] >= floor), F.struct(w["value"].alias("value"), X.clamp(w["confidence"], 86, 97).cast("double").alias("confidence"))))
    shaped = X.let(F.get(F.filter(chosen, lambda r: r["value"].isNotNull() & r["confidence"].isNotNull()), F.lit(0))["value"], lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(SHAPE_CONFIDENCE).alias("confidence"))))
    fact = F.when(F.col("by_vote"), F.coalesce(voted(chosen), voted(F.filter("r", lambda r: r["fixed"])))).otherwise(shaped)
    return _of_groups(some, fact)


def _best(reads: Column, floor: float, enough: float = 92.0) -> Column:
    """Of reads (seq, value, confidence) the one that votes.best_read takes, or NULL."""
    some = F.filter(reads, lambda r: r["value"].isNotNull() & (r["confidence"] >= floor))
    ranked = lambda r: X.let(r["confidence"] >= enough, lambda early: F.struct((~early).alias("late"), F.when(early, r["seq"]).alias("first"), (-r["confidence"]).alias("k"), r["seq"].alias("seq"), r["value"].alias("value"), r["confidence"].alias("confidence")))
    return F.array_min(F.transform(some, ranked))


def _elected(reads: Column) -> Column:
    """struct<votes, confidence, value> of reads (seq, value, confidence), in the order of seq, that votes.first_to_two takes, or NULL."""

    def of(some: Column) -> Column:
        stop = F.array_min(F.transform(some, lambda r, i: F.when(F.exists(F.slice(some, 1, i), lambda x: x["value"] == r["value"]), r["seq"])))
        taken = X.let(stop, lambda at: F.filter(some, lambda r: at.isNull() | (r["seq"] <= at)))

        def counted(rs: Column) -> Column:
            def key(v: Column) -> Column:
                same = F.filter(rs, lambda r: r["value"] == v)
                most = lambda s: X.let(F.array_max(F.transform(s, lambda r: r["confidence"])), lambda c: F.struct((-F.size(s)).alias("k"), F.coalesce(-c, F.lit(float("inf"))).alias("far"), F.array_min(F.transform(s, lambda r: r["seq"])).alias("seq"), v.alias("value"), F.size(s).alias("votes"), c.alias("confidence")))
                return X.let(same, most)

            return F.array_min(F.transform(F.array_distinct(F.transform(rs, lambda r: r["value"])), key))

        return X.let(taken, counted)

    return X.let(F.filter(reads, lambda r: r["value"].isNotNull()), of)


def _address(reads: Column) -> Column:
    """struct<value, confidence> of the lines of an address up to the first that no read shows, by the best read of each."""
    lines = F.array_sort(F.array_distinct(F.transform(reads, lambda r: F.coalesce(r["line"], F.lit(-(1 << 31))))))
    shown = F.transform(lines, lambda n: _best(F.filter(reads, lambda r: r["line"] == n), ADDRESS_FLOOR))

    def joined(ls: Column) -> Column:
        upto = F.slice(ls, 1, X.let(F.array_position(F.transform(ls, lambda l: l.isNull()), F.lit(True)).cast("int"), lambda gap: F.when(gap > 0, gap - 1).otherwise(F.size(ls))))
        mean = lambda some: F.aggregate(some, F.lit(0.0), lambda t, l: t + l["confidence"]) / F.size(some)
        return X.let(upto, lambda some: F.when(F.size(some) > 0, F.struct(F.array_join(F.transform(some, lambda l: l["value"]), ", ").alias("value"), X.clamp(mean(some), 50, 90).cast("double").alias("confidence"))))

    return X.let(shown, joined)


def back_zone_facts(reads: DataFrame) -> DataFrame:
    """(doc_id, side, field, value, confidence, source) of the back's values: address, authority, marital status, blood group, tax number.

    Each read is parsed once. The reads of a field meet in one row, where lines
    are put together, votes counted and floors applied.
    """
    fields = ("address", "authority", "maritalStatus", "bloodGroup", "taxId")
    value = X.parse_back_read(F.col("field"), F.col("part"), F.col("raw"))
    parsed = reads.where(F.col("field").isin(*fields)).select(*VALUE, "line", F.col("padding_seq").alias("seq"), value.alias("value"), "confidence")
    rows = parsed.groupBy("doc_id", "side", "field").agg(F.sort_array(F.collect_list(F.struct("seq", "line", "part", "value", "confidence"))).alias("r"))
    fact = lambda v, confidence: F.struct(v.alias("value"), confidence.cast("double").alias("confidence"))
    authority = X.let(_best(F.col("r"), AUTHORITY_FLOOR), lambda b: F.when(b.isNotNull(), fact(b["value"], X.clamp(b["confidence"], 50, 90))))
    # the first read of each part
    first = lambda rs, part: F.get(F.filter(rs, lambda r: r["part"] == part), F.lit(0))["value"]
    status = lambda s: F.when(s["some"], fact(F.coalesce(s["c"], s["l"]), F.when(s["c"].isNull(), 60).when(s["l"].isNotNull(), 90).otherwise(65)))
    marital = X.let(F.filter("r", lambda r: r["value"].isNotNull() & (r["confidence"] >= 0)), lambda rs: X.let(F.struct((F.size(rs) > 0).alias("some"), first(rs, "cyrillic").alias("c"), first(rs, "latin").alias("l")), status))
    elected = X.let(_elected(F.col("r")), lambda w: F.when((w["votes"] >= 2) | (w["confidence"] >= SHAPED_FLOOR), fact(w["value"], X.clamp(w["confidence"], 86, 97))))
    field = F.col("field")
    found = F.when(field == "address", _address(F.col("r"))).when(field == "authority", authority).when(field == "maritalStatus", marital).otherwise(elected)
    return _of_groups(rows, found)


def missing_zones(reads: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, field, x, y, width, height) of the fixed rectangles whose field was not read.

    A document's reads and facts meet in one aggregate of a few flags. Joined,
    the facts would be broadcast: their size is told from the keys alone, not
    from the many rows that each of them stands for.
    """
    flags = [F.bool_or(F.col("field") == f).alias(f) for f, *_ in T.FIXED_ZONES]
    front = reads.where("side = 'front'").select("doc_id", F.lit(None).cast("string").alias("field"), F.lit(True).alias("read"))
    both = front.unionByName(found.where("doc_id is not null").select("doc_id", "field", F.lit(False).alias("read")))
    docs = both.groupBy("doc_id").agg(F.bool_or("read").alias("read"), *flags).where("read")
    zone = lambda f, r: F.when(~F.coalesce(F.col(f), F.lit(False)), F.struct(F.lit(f).alias("field"), *[F.lit(float(v)).alias(c) for v, c in zip(r, ("x", "y", "width", "height"))]))
    missing = F.filter(F.array(*[zone(f, r) for f, *r in T.FIXED_ZONES]), lambda z: z.isNotNull())
    return docs.select("doc_id", F.inline(missing))


def locate_front_zones(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, part, line, box): where the values of a front stand, by the labels that both language models read on it.

    pages: (keys, tajik, english, width, height), the first two the blocks of
    the pages, null where a model read none. A page of which too few labels
    agree has no rows. Keys are unique.
    """
    none = F.array().cast("array<struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>>>")
    found = pages.select(*keys, "width", "height", *[F.coalesce(nested.segments(F.col(c)), none).alias(c) for c in ("tajik", "english")])
    fits = found.select(*keys, "width", "height", fit.axes_of(nested.anchor_points(F.col("tajik"), F.col("english"))).alias("f")).where("f.sx is not null").select(*keys, "width", "height", "f.*")
    return spatial.place(fits, [(f, p, None, *box) for f, p, *box in T.FRONT_BOXES]).select(*keys, "field", "part", "line", *BOX)


def back_template() -> list[tuple]:
    """(field, part, line, x0, y0, x1, y1) of the back: the lines of the address, then the other values."""
    a = T.BACK_ADDRESS
    lines = [("address", "value", n, a["left"], a["top"] + n * a["pitch"], a["right"], a["top"] + n * a["pitch"] + a["height"]) for n in range(a["lines"])]
    return lines + [(f, p, None, *box) for f, p, *box in T.BACK_BOXES]


def locate_back_zones(lines: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, part, line, box) of a back: by its three machine-readable lines, else by the image's size.

    lines: (keys, seq, x0, y0, x1, y1); images: (keys, width, height), one row a key, also of those without lines.
    """
    whole = images.select(*keys, "width", "height")
    fits = fit.register_by_lines(lines.join(whole, keys), keys, T.BACK_MRZ, T.BACK_SIZE)
    by_size = [(F.col("width") / T.BACK_SIZE[0]).alias("bx"), (F.col("height") / T.BACK_SIZE[1]).alias("by")]
    known = whole.select("*", *by_size).join(fits.drop("width", "height"), keys, "left")
    every = known.select(*keys, "width", "height", F.coalesce("sx", "bx").alias("sx"), F.coalesce("tx", F.lit(0.0)).alias("tx"), F.coalesce("sy", "by").alias("sy"), F.coalesce("ty", F.lit(0.0)).alias("ty"))
    return spatial.place(every, back_template()).select(*keys, "field", "part", "line", *BOX)


def anchored_names(reads: DataFrame, as_of_year: int) -> DataFrame:
    """One pair of scripts for each name read under its label."""
    return names.closest_reads(front_name_reads(reads, as_of_year))
