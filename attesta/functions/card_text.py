"""Fields of a card from its text alone, as expressions over the array of its lines: no shuffle. NULL means not found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import tables as T
from attesta.functions import text as X

Test = Callable[[Column], Column]
DATE = r"\d{1,2}[./]\d{1,2}[./]\d{2,4}"


def some(*patterns: str) -> Test:
    """Whether one of several patterns is found, in any case."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return lambda v: v.rlike(f"(?iu){joined}")


def line_array(text: Column) -> Column:
    """Trimmed lines that are not empty, with their dates in normal form."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: X.normal_dates(F.regexp_replace(x, f"^{X.S}+|{X.S}+\\z", "")))
    return F.filter(trimmed, lambda x: x != "")


def first_index(lines: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Index of the first line that passes test(line, index), or NULL."""
    return F.get(F.filter(F.transform(lines, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()), F.lit(0))


def first_value(lines: Column, value: Callable[[Column, Column], Column]) -> Column:
    """The first value(line, index) that is not NULL."""
    return F.get(F.filter(F.transform(lines, value), lambda v: v.isNotNull()), F.lit(0))


def known_label(line: Column) -> Column:
    return some(*T.TEXT_LABEL_LINES)(line)


def card_text(text: Column) -> Column:
    """Whether a text is that of a card: a marker, or two lines of the machine-readable alphabet."""
    return some(*T.CARD_MARKERS)(text) | (F.size(zone_text_lines(F.split(text, "\n"))) >= 2)


def birth_row_header(line: Column) -> Column:
    """A header over sex and birth date or over birth date and place: no label of a place by itself."""
    x = X.homoglyphs(line)
    sex, dob, pob = x.rlike(rf"(?i){X.AB}sex{X.AB}"), x.rlike(r"(?i)date\s*of\s*birth"), x.rlike(r"(?i)place\s*of\s*birth")
    return (sex & dob) | (dob & pob)


def labelled(lines: Column, patterns: list[str], ok: Test = X.inline_value, skip: Test | None = None) -> Column:
    """What the first label line yields that yields something: the rest of it, else the next line, else the one after a very short next line."""
    whole = some(*patterns)

    def value(line: Column, i: Column) -> Column:
        rest = line
        for p in patterns:
            rest = X.remove_first(rest, f"(?iu){p}")
        rest = F.trim(F.regexp_replace(rest, r"^[\s:/|.,-]+|[\s:/|.,]+\z", ""))
        next_, after = F.trim(F.get(lines, i + 1)), F.trim(F.get(lines, i + 2))
        good = lambda v: v.isNotNull() & (v != "") & ~known_label(v) & X.looks_like_value(v)
        short = (next_ != "") & (F.length(next_) <= 2) & ~known_label(next_)
        found = F.when((rest != "") & ok(rest), rest).when(good(next_), next_).when(short & good(after), after)
        return F.when(whole(line) & (~skip(line) if skip else F.lit(True)), found)

    return first_value(lines, value)


CYRILLIC_WORD, LATIN_WORD = f"^[{T.CAPITALS}]{{2,}}\\z", r"^[A-Z]{2,}\z"


def _twice(cyrillic: Column, latin: Column) -> Column:
    return cyrillic.rlike(CYRILLIC_WORD) & latin.rlike(LATIN_WORD) & X.names_agree(cyrillic, latin)


def word_below(lines: Column, pattern: str) -> Column:
    """The Cyrillic word under the first label line below which the same name stands in both scripts."""
    return first_value(lines, lambda x, i: F.when(some(pattern)(x) & _twice(F.coalesce(F.get(lines, i + 1), F.lit("")), F.coalesce(F.get(lines, i + 2), F.lit(""))), F.get(lines, i + 1)))


def stacked_names(lines: Column) -> Column:
    """Cyrillic words whose next line spells them in Latin letters."""
    return F.filter(F.transform(lines, lambda x, i: F.when(_twice(x, F.coalesce(F.get(lines, i + 1), F.lit(""))), x)), lambda x: x.isNotNull())


def row_below(lines: Column, header: Test) -> Column:
    """The tokens of the line below the first header line."""
    at = first_index(lines, lambda x, i: header(x))
    return F.filter(F.split(F.coalesce(F.get(lines, at + 1), F.lit("")), r"\s+"), lambda t: t != "")


def zone_text_lines(lines: Column) -> Column:
    """Lines of the machine-readable alphabet with a filler, 20 to 32 characters, look-alikes and blanks put right."""
    return F.filter(F.transform(lines, lambda x: X.homoglyphs(F.regexp_replace(x, X.S, ""))), lambda x: x.rlike(r"^[A-Z0-9<]{20,32}\z") & F.contains(x, F.lit("<")))


def zone_text_date(chars: Column, as_of_year: int) -> Column:
    """dd.mm.yyyy of six digits, without a calendar check; years more than one ahead are of the last century."""
    d = F.regexp_replace(chars, "(?i)o", "0")
    year = F.when(F.substring(d, 1, 2).try_cast("int") > as_of_year % 100 + 1, "19").otherwise("20")
    return F.when(d.rlike(r"^\d{6}\z"), F.concat(F.substring(d, 5, 2), F.lit("."), F.substring(d, 3, 2), F.lit("."), year, F.substring(d, 1, 2)))


def zone_text_fields(found: Column, as_of_year: int) -> dict[str, Column]:
    """Fields of a text's machine-readable lines, at fixed places and without check digits; needs two such lines."""
    line = lambda i: F.when(F.size(found) >= 2, F.get(found, F.lit(i)))
    a, b, c = line(0), line(1), line(2)
    number = F.nullif(F.replace(F.substring(a, 6, 9), F.lit("<")), F.lit(""))
    sex = F.substring(b, 8, 1)
    tidy = lambda v: F.nullif(F.trim(F.replace(v, F.lit("<"), F.lit(" "))), F.lit(""))
    return {
        "documentNumber": X.number_digits(number), "birthDate": zone_text_date(F.substring(b, 1, 6), as_of_year), "sex": F.when(sex.isin("M", "F"), sex),
        "expiryDate": zone_text_date(F.substring(b, 9, 6), as_of_year), "surname": tidy(F.get(F.split(c, "<<"), F.lit(0))), "givenNames": tidy(F.get(F.split(c, "<<"), F.lit(1))),
    }


def _dates(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({DATE})"), F.lit(1))


def ordered_dates(text: Column) -> Column:
    """Different dates of a text, by year and then as first seen."""
    keyed = F.transform(F.array_distinct(_dates(text)), lambda d, i: F.struct(F.regexp_extract(d, r"(\d{2,4})$", 1).cast("int").alias("y"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda s: s["d"])


def _registered(line: Column) -> Column:
    """A line with the year of registration at an address: its date is none of the card's."""
    return some("сол")(line)


NUMBER_SHAPE = r"^[A-ZА-ЯЁ][0-9OОDЗзSЅбВBIlІ]{6,9}\z"


def whole_number(compact: Column, raw: Column) -> Column:
    """A document number with its tail put back where that stands alone on the next line."""
    tail = F.get(compact, F.array_position(compact, raw).cast("int"))
    fits = (F.length(raw) < 9) & (F.array_position(compact, raw) > 0) & tail.rlike(r"^[0-9OОЗ]+\z") & (F.length(raw) + F.length(tail) == 9)
    return X.number_digits(F.when(F.coalesce(fits, F.lit(False)), F.concat(raw, tail)).otherwise(raw))


def with_text_fields(docs: DataFrame, as_of_year: int) -> DataFrame:
    """Add a column for each of TEXT_FIELDS to rows with an array `lines`.

    Labels go before the machine-readable lines, and shapes found anywhere fill
    what is still open. Each step is a projection, so nothing is worked out twice.
    """
    blank = lambda v: F.nullif(v, F.lit(""))
    c, lines = F.col, F.col("lines")
    plain = lambda v: v.rlike(r"^[\p{L}\s'-]{2,}\z") & X.looks_like_value(v)
    own = docs.withColumns({
        "_zone": zone_text_lines(lines), "_surname": word_below(lines, T.SURNAME_LABEL), "_givenNames": word_below(lines, T.GIVEN_LABEL), "_fatherName": blank(labelled(lines, T.FATHER_LABELS, plain)),
        "_place": blank(labelled(lines, T.PLACE_LABELS, skip=birth_row_header)), "_number": blank(labelled(lines, T.NUMBER_LABELS)), "_stacked": stacked_names(lines), "_birth": row_below(lines, birth_row_header),
        "_valid": row_below(lines, lambda x: x.rlike(r"(?i)date\s*of\s*issue") & x.rlike(r"(?i)date\s*of\s*expiry")),
        "_dated": F.transform(lines, lambda x: F.struct(_dates(x).alias("d"), _registered(x).alias("r"))),
        "_sexes": first_value(lines, lambda x, i: F.when(X.homoglyphs(x).rlike(DATE) & X.homoglyphs(x).rlike(rf"{X.AB}[MF]{{1,2}}{X.AB}"), X.homoglyphs(x))),
        "_compact": F.transform(lines, lambda x: F.regexp_replace(x, X.S, "")), "_long": first_value(lines, lambda x, i: blank(F.regexp_extract(x, rf"{X.AB}(\d{{12,14}}){X.AB}", 1))),
    })
    zone = {f"z_{f}": v for f, v in zone_text_fields(c("_zone"), as_of_year).items()}
    key = X.same_name_key
    taken = F.array_compact(F.array(*[key(c(f"_{f}")) for f in T.NAME_FIELDS]))
    some = own.withColumns(zone | {"_taken": taken}).withColumns({
        "_spare": F.filter("_stacked", lambda p: ~F.array_contains(c("_taken"), key(p))),
        "_issue": blank(F.get("_valid", F.lit(0))), "_expiry": F.coalesce(blank(F.get("_valid", F.lit(1))), c("z_expiryDate")), "_two": F.get(F.filter("_dated", lambda x: F.size(x["d"]) >= 2), F.lit(0))["d"],
        "_birthDate": F.coalesce(blank(F.regexp_extract(F.get(F.filter("_birth", lambda t: t.rlike(DATE)), F.lit(0)), f"({DATE})", 1)), c("z_birthDate")),
        "_raw": F.coalesce(F.when(F.coalesce(c("_number"), c("z_documentNumber")).rlike(NUMBER_SHAPE), F.coalesce(c("_number"), c("z_documentNumber"))), F.get(F.filter("_compact", lambda x: x.rlike(NUMBER_SHAPE)), F.lit(0))),
    })
    differs = lambda d, x: F.coalesce(d != x, F.lit(True))
    first = F.transform(F.filter("_dated", lambda x: ~x["r"]), lambda x: F.get(x["d"], F.lit(0)))
    early = F.get(F.filter(first, lambda d: d.isNotNull() & differs(d, c("_issue")) & differs(d, c("_expiry"))), F.lit(0))
    born = some.withColumn("birthDate", F.coalesce("_birthDate", early))
    year = lambda d: F.right(d, F.lit(4)).try_cast("int")
    free = F.filter(F.array_distinct(F.flatten(F.transform(F.filter("_dated", lambda x: ~x["r"]), lambda x: x["d"]))), lambda d: differs(d, c("birthDate")) & (year(d) > 2000))
    dated = born.withColumn("_free", F.transform(F.array_sort(F.transform(free, lambda d, i: F.struct(year(d).alias("y"), i.alias("i"), d.alias("d")))), lambda s: s["d"]))
    several = lambda v: F.when(F.size("_free") >= 2, v)
    names, before = {}, F.lit(0)
    for f in T.NAME_FIELDS:  # what is still open takes the pairs left, in order
        v = F.coalesce(c(f"_{f}"), F.get("_spare", before), c(f"z_{f}") if f"z_{f}" in zone else F.lit(None))
        names[f] = F.when(X.plausible_name(v), v)
        before = before + c(f"_{f}").isNull().cast("int")
    sex_token = F.get(F.filter(F.transform("_birth", X.homoglyphs), lambda t: t.rlike(r"^[MF]+\z")), F.lit(0))
    return dated.select(*docs.columns, *[v.alias(f) for f, v in names.items()],
        F.coalesce(F.substring(sex_token, 1, 1), c("z_sex"), blank(F.regexp_extract("_sexes", rf"{X.AB}([MF])\1?{X.AB}", 1))).alias("sex"), c("_place").alias("birthPlace"),
        whole_number(c("_compact"), c("_raw")).alias("documentNumber"), F.coalesce(blank(F.get("_valid", F.lit(2))), c("_long")).alias("nationalIdNumber"), "birthDate",
        F.coalesce(c("_issue"), F.get("_two", F.lit(0)), several(F.get("_free", F.lit(0)))).alias("issueDate"), F.coalesce(c("_expiry"), F.get("_two", F.lit(1)), several(F.element_at("_free", -1))).alias("expiryDate"),
    )


TEXT_FIELDS = ["surname", "givenNames", "fatherName", "sex", "birthPlace", "documentNumber", "nationalIdNumber", "birthDate", "issueDate", "expiryDate"]


def text_facts(texts: DataFrame, as_of_year: int, confidence: float = 80.0) -> DataFrame:
    """Facts (doc_id, side, field, value, confidence, source) of (doc_id, side, text) rows, without values that are English labels.

    A null text gives none; repeated rows give repeated facts.
    """
    read = with_text_fields(texts.select("doc_id", "side", line_array(F.coalesce("text", F.lit(""))).alias("lines")), as_of_year)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(f).alias("value")) for f in TEXT_FIELDS]))
    found = read.select("doc_id", "side", rows.alias("f")).select("doc_id", "side", "f.*").where((F.col("value") != "") & ~X.english_label_text(F.col("value")))
    return found.select("*", F.lit(confidence).alias("confidence"), F.lit("layout").alias("source"))
