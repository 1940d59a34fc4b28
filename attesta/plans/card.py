"""Whole plans: machine-readable zones to facts, a side's sources to its facts, and both sides to one wide row per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import card_text, mrz
from attesta.functions import tables as T
from attesta.operators import layout, names, votes
from attesta.operators import pages as nested
from attesta.plans import zones
from attesta.sources.tables import written

AS_OF_YEAR = 2024
FACT = ["doc_id", "side", "field", "value", "confidence", "source"]
#: Names that the machine-readable zone gives, by the field they belong to.
MACHINE_NAMES = {"mrzSurname": "surname", "mrzGivenNames": "givenNames"}


def mrz_facts(texts: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """(doc_id, field, value, confidence, source) from (doc_id, text) rows."""
    return _each_fact(texts.select("doc_id", mrz.parse(F.col("text"), as_of_year).alias("best")), as_of_year)


def _each_fact(best: DataFrame, as_of_year: int) -> DataFrame:
    """(doc_id, field, value, confidence, source) of (doc_id, best) rows.

    Rows without facts go after they are exploded: a filter on what parsing
    gives would be pushed below it, parse all once more, and that before rows
    are dealt to tasks.
    """
    found = best.select("doc_id", F.explode_outer(mrz.facts(F.col("best"), as_of_year)).alias("f"))
    return found.where("f is not null").select("doc_id", "f.*", F.lit("mrz").alias("source"))


def text_facts(texts: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """Facts of (doc_id, side, text) rows by the text alone."""
    return card_text.text_facts(texts, as_of_year)


def layout_facts(lines: DataFrame) -> DataFrame:
    """Facts of page lines by their layout, without values that are labels."""
    return layout.drop_label_values(layout.layout_fields(lines)).select(*FACT[:-1], F.lit("layout").alias("source"))


def side_facts(zone: DataFrame, machine: DataFrame, layout_: DataFrame, text: DataFrame) -> DataFrame:
    """One side's facts: validated zone and machine reads before guesses from layout and text, in this order among equals."""
    ranked = [x.select(*FACT, F.lit(t).alias("tier"), F.lit(r).alias("src_rank")) for r, (x, t) in enumerate(((zone, 0), (machine, 0), (layout_, 1), (text, 1)))]
    return votes.tiered_merge(reduce(DataFrame.unionByName, ranked), ["doc_id", "side", "field"])


def label_names(layout_: DataFrame, text: DataFrame) -> DataFrame:
    """(doc_id, side, field, value, confidence) of the names that label parsers found: the better of layout and text."""
    both = layout_.select(*FACT, F.lit(0).alias("src_rank")).unionByName(text.select(*FACT, F.lit(1).alias("src_rank")))
    return votes.merge_facts(both.where(F.col("field").isin(T.NAME_FIELDS)), ["doc_id", "side", "field"]).select(*FACT[:-1])


def chosen_sides(pages: DataFrame, english: DataFrame) -> DataFrame:
    """(doc_id, side, blocks, english, text): the best page of each side, overlaid with the English page of the same variant.

    pages: (doc_id, side, seq, confidence, text, blocks), a row for each
    variant; english: (doc_id, side, seq, blocks). A page is as good as its
    confidence and three for each field that its layout gives; of equally good
    ones the first counts. Scores are worked out where pages are read, and the
    losers dropped before the shuffle as far as a task sees them.
    """
    lines = layout.cleaned(nested.lines_of(F.col("blocks")))
    score = F.coalesce(F.col("confidence"), F.lit(0.0)) + 3 * F.coalesce(F.size(F.coalesce(layout.page_fields(lines), F.array())), F.lit(0))
    mine = pages.select("doc_id", "side", "seq", score.alias("score"), "text", "blocks", F.lit(None).cast(pages.schema["blocks"].dataType).alias("e"))
    theirs = english.select("doc_id", "side", "seq", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(pages.schema["blocks"].dataType).alias("blocks"), F.col("blocks").alias("e"))
    best = F.max_by(F.struct("seq", "text", "blocks"), F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("seq"))))
    others = F.collect_list(F.when(F.col("score").isNull(), F.struct("seq", "e")))
    both = mine.unionByName(theirs).groupBy("doc_id", "side").agg(best.alias("b"), others.alias("o")).where("b is not null")
    read = F.get(F.filter("o", lambda o: o["seq"] == F.col("b.seq")), F.lit(0))["e"]
    found = both.select("doc_id", "side", F.col("b.blocks").alias("blocks"), read.alias("english"), F.col("b.text").alias("text"))
    return found.select("doc_id", "side", nested.merge_labels(F.col("blocks"), F.col("english")).alias("blocks"), "english", "text")


def chosen_zone_facts(zone_texts: DataFrame, as_of_year: int) -> DataFrame:
    """(doc_id, field, value, confidence, source) of the best read of each document's machine-readable zone.

    zone_texts: (doc_id, turn, area, confidence, text); turns count from 1,
    areas from 0. The best read has most check points, ten times counted, and
    confidence; of equal ones the earlier. Where a second area was tried, it
    counts on the first turn only.
    """
    parsed = zone_texts.select("doc_id", "turn", "area", "confidence", mrz.parse(F.col("text"), as_of_year).alias("best"))
    reads = parsed.groupBy("doc_id").agg(F.collect_list(F.struct("turn", "area", "confidence", "best")).alias("r"), F.max("area").alias("areas"))
    tried = F.filter("r", lambda x: (x["turn"] == 1) | (F.col("areas") == 0) | (x["area"] != 1))
    ranked = F.transform(tried, lambda x: F.struct((-(F.coalesce(x["best"]["score"], F.lit(0)) * 10 + x["confidence"])).alias("k"), x["turn"].alias("turn"), x["area"].alias("area"), x["best"].alias("best")))
    return _each_fact(reads.select("doc_id", F.array_min(ranked)["best"].alias("best")), as_of_year)


def recognized_cards(pages: DataFrame, english: DataFrame, zone_texts: DataFrame, zone_reads: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """One wide row per document from all that was read of its two sides.

    pages, english: see chosen_sides; zone_texts: reads of the machine-readable
    zone on the back, see chosen_zone_facts; zone_reads: see zones. What is
    validated, that is reads of known places and the machine-readable zone,
    goes before what layout and text let guess. Names are resolved across
    sides; other fields are merged side by side, the front before the back.

    What several steps read, that is the chosen sides, the zone's facts, the
    guesses and the parsed reads of names, is written once in the shared folder.
    """
    sides = written(chosen_sides(pages, english), "sides")
    lines = nested.lines_of(F.col("blocks"))
    # exploding only what is not empty would search each page once more, in a filter
    by_layout = sides.select("doc_id", "side", F.explode_outer(layout.page_fields(layout.cleaned(lines))).alias("f")).where("f is not null").select("doc_id", "side", "f.*")
    by_layout = layout.drop_label_values(by_layout).select(*FACT[:-1], F.lit("layout").alias("source"))
    by_text = text_facts(sides.select("doc_id", "side", nested.page_text(F.col("blocks"), F.col("text")).alias("text")), as_of_year)
    guesses = written(by_layout.withColumn("way", F.lit("layout")).unionByName(by_text.withColumn("way", F.lit("text"))), "guesses")
    by_layout, by_text = [guesses.where(F.col("way") == w).drop("way") for w in ("layout", "text")]
    machine = written(chosen_zone_facts(zone_texts, as_of_year).withColumn("side", F.lit("back")), "machine")
    front, back = zone_reads.where("side = 'front'"), zone_reads.where("side = 'back'")
    zone = written(zones.front_zone_facts(front, as_of_year).unionByName(zones.back_zone_facts(back)), "zones")
    facts = side_facts(zone, machine.where(~F.col("field").isin(list(MACHINE_NAMES))).select(*FACT), by_layout, by_text)
    own = F.create_map(*[F.lit(x) for kv in MACHINE_NAMES.items() for x in kv])
    machine_names = machine.where(F.col("field").isin(list(MACHINE_NAMES))).withColumn("field", own[F.col("field")])
    flat = lambda blocks: sides.select("doc_id", "side", F.posexplode(nested.lines_of(F.col(blocks))).alias("seq", "l")).select("doc_id", "side", F.col("seq").cast("long").alias("seq"), names_text(F.col("l.words")).alias("text"), "l.confidence", "l.bbox.*")
    pairs = written(names.line_pairs(flat("blocks"), flat("english")), "pairs")
    anchored = written(zones.anchored_names(front, as_of_year), "anchored")
    named = names.resolve_names(pairs, anchored, label_names(by_layout, by_text), machine_names)
    return card(facts, named)


def names_text(words):
    """The text of a line's confident words; a line of which none is sure stays, with an empty text."""
    return F.array_join(F.transform(F.filter(words, lambda w: w["confidence"] >= 25), lambda w: w["text"]), " ")


def card(facts: DataFrame, named: DataFrame) -> DataFrame:
    """The wide row of each document: names as resolved, the rest merged flat, the front before the back."""
    name = named.select("doc_id", "field", "value", "confidence", F.lit(-1).alias("src_rank"))
    rest = facts.where(~F.col("field").isin(T.NAME_FIELDS)).select("doc_id", "field", "value", "confidence", F.when(F.col("side") == "front", 0).otherwise(1).alias("src_rank"))
    return votes.wide(votes.merge_facts(name.unionByName(rest), ["doc_id", "field"]), ["doc_id"], T.FIELDS)
