"""Machine-readable zones of the TD1 kind (public layout of ICAO Doc 9303), as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import tables as T
from attesta.functions.text import accept, let

WIDTH = 30
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def part(line: Column, start: int, stop: int) -> Column:
    return F.substring(line, start + 1, stop - start)


def check_sum(v: Column, length: int) -> Column:
    """The check digit of the first `length` characters: values 0-9, A-Z as 10-35 and filler as 0, with weights 7, 3, 1."""
    return let(v, lambda x: _digit(x, length))


def _digit(x: Column, length: int) -> Column:
    places = F.sequence(F.lit(1), F.lit(length))
    term = lambda i: F.greatest(F.call_function("instr", F.lit(VALUES), F.substring(x, i, F.lit(1))) - 1, F.lit(0)) * F.get(F.array(F.lit(7), F.lit(3), F.lit(1)), (i - 1) % 3)
    return (F.aggregate(places, F.lit(0), lambda s, i: s + term(i)) % 10).cast("string")


def digits_in(line: Column, start: int, stop: int) -> Column:
    """Letters read for digits, in a range of places only."""
    return F.concat(part(line, 0, start), F.translate(part(line, start, stop), *T.MRZ_DIGITS), F.substring(line, stop + 1, 100))


def snap_state(code: Column) -> Column:
    wrong = lambda x: sum((F.substring(x, i + 1, 1) != c).cast("int") for i, c in enumerate(T.STATE))
    return let(F.translate(code, *T.MRZ_LETTERS), lambda x: F.when(wrong(x) <= 1, T.STATE).otherwise(x))


def repair_first(line: Column) -> Column:
    return let(digits_in(line, 6, 15), lambda x: F.concat(part(x, 0, 2), snap_state(part(x, 2, 5)), F.substring(x, 6, 100)))


def repair_second(line: Column) -> Column:
    both = F.concat(F.translate(part(line, 0, 7), *T.MRZ_DIGITS), part(line, 7, 8), F.translate(part(line, 8, 15), *T.MRZ_DIGITS), F.substring(line, 16, 100))
    return let(both, lambda x: F.concat(part(x, 0, 7), F.translate(part(x, 7, 8), *T.MRZ_SEX), part(x, 8, 15), snap_state(part(x, 15, 18)), F.substring(x, 19, 100)))


def repair_third(line: Column) -> Column:
    """Letters wedged between fillers and a tail of filler look-alikes become fillers; 30 characters."""
    f = T.FILLERS
    wedged = F.regexp_replace(line, f"(?<=<[{f}]{{0,40}})[{f}](?=[{f}]{{0,40}}<)", "<")
    tail = lambda x: F.when(x.rlike(f"[{f}<]{{4,}}\\z"), F.rpad(F.regexp_replace(x, f"[{f}<]+\\z", ""), F.length(x), F.lit("<"))).otherwise(x)
    return F.rpad(F.substring(let(wedged, tail), 1, WIDTH), WIDTH, "<")


def _points(*tests: tuple[int, Column]) -> Column:
    return sum((F.when(t, n).otherwise(0) for n, t in tests), F.lit(0))


def score_first(x: Column) -> Column:
    number = part(x, 5, 14)
    return _points((4, check_sum(number, 9) == part(x, 14, 15)), (1, x.rlike("^[ACI][A-Z<]")), (1, part(x, 2, 5).rlike("^[A-Z]{3}\\z")), (2, part(x, 2, 5) == T.STATE), (1, number.rlike("^[A-Z][0-9]{8}\\z")))


def dated(x: Column, start: int) -> Column:
    """Six digits from start with a good check digit behind them."""
    d = part(x, start, start + 6)
    return d.rlike("^[0-9]{6}\\z") & (check_sum(d, 6) == part(x, start + 6, start + 7))


def score_second(x: Column) -> Column:
    return _points((4, dated(x, 0)), (1, part(x, 7, 8).rlike("^[MF<]\\z")), (4, dated(x, 8)), (1, part(x, 15, 18).rlike("^[A-Z]{3}\\z")), (2, part(x, 15, 18) == T.STATE))


def candidates(line: Column) -> Column:
    """All ways to bring a line to 30 characters with up to two fillers put in or characters left out; else cut or filled up."""
    n = F.length(line)
    cut = lambda x, i: F.concat(F.substring(x, F.lit(1), i), F.substring(x, i + 2, F.lit(100)))
    put = lambda x, i: F.concat(F.substring(x, F.lit(1), i), F.lit("<"), F.substring(x, i + 1, F.lit(100)))
    places = F.sequence(F.lit(0), n)
    one_in = F.transform(places, lambda i: put(line, i))
    two_in = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(i, n), lambda j: put(put(line, i), j + 1))))
    inner = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    one_out = F.transform(inner, lambda i: cut(line, i))
    two_out = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.transform(F.sequence(i, F.greatest(n - 2, i)), lambda j: cut(cut(line, i), j))))
    return F.array_distinct(
        F.when(n == 30, F.array(line)).when(n == 29, one_in).when(n == 28, two_in).when(n == 31, one_out).when(n == 32, two_out).otherwise(F.array(F.rpad(F.substring(line, 1, WIDTH), WIDTH, "<")))
    )


def best_alignment(line: Column, repair: Callable[[Column], Column], score: Callable[[Column], Column]) -> Column:
    """struct(score, order, line): the repaired candidate with the highest score, the first of equal ones."""
    tried = let(line, lambda x: F.transform(candidates(x), lambda c, i: F.struct(repair(c).alias("line"), i.alias("i"))))
    return F.array_max(F.transform(tried, lambda t: F.struct(score(t["line"]).alias("score"), (-t["i"]).alias("order"), t["line"].alias("line"))))


def clean_lines(text: Column) -> Column:
    """Lines of a zone's text: 24 to 36 of its characters, or one of 84 to 96 cut in three."""
    kept = F.filter(F.transform(F.split(F.upper(text), "\n"), lambda x: F.regexp_replace(x, "[^A-Z0-9<]", "")), lambda x: F.length(x) >= 24)

    def choose(k: Column) -> Column:
        first = F.get(k, F.lit(0))
        thirds = F.transform(F.array(*[F.lit(i) for i in (0, 30, 60)]), lambda i: F.substring(first, i + 1, F.lit(30)))
        return F.when((F.size(k) == 1) & F.length(first).between(84, 96), thirds).otherwise(F.filter(k, lambda x: F.length(x) <= 36))

    return let(kept, choose)


def date_of(digits: Column, expiry: bool, as_of_year: int) -> Column:
    yy = F.substring(digits, 1, 2)
    century = F.lit("20") if expiry else F.when(yy > f"{as_of_year % 100:02d}", "19").otherwise("20")
    whole = F.concat(century, yy, F.substring(digits, 3, 4))
    ok = digits.rlike("^[0-9]{6}\\z") & F.try_to_date(whole, "yyyyMMdd").isNotNull()
    return accept(F.concat_ws(".", F.substring(whole, 7, 2), F.substring(whole, 5, 2), F.substring(whole, 1, 4)), ok)


def cleaned_name(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, "[<\\s]+", " "))


def parse(text: Column, as_of_year: int) -> Column:
    """struct of the fields of a zone's text and how far each is to be trusted; NULL without three lines.

    Of every three lines in a row the best-scoring alignment is taken, the
    first of equal ones. Fields behind check digits need a second passing one,
    or the composite digit; the others inherit trust from how much passed.
    """

    def best(lines: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(lines) - 3, F.lit(0))),
            lambda i: F.struct(best_alignment(F.get(lines, i), repair_first, score_first).alias("a"), best_alignment(F.get(lines, i + 1), repair_second, score_second).alias("b"), repair_third(F.get(lines, i + 2)).alias("c"), i.alias("i")),
        )
        row = lambda w: F.struct((w["a"]["score"] + w["b"]["score"]).alias("score"), (-w["i"]).alias("order"), w["a"]["line"].alias("a"), w["b"]["line"].alias("b"), w["c"].alias("c"))
        return F.when(F.size(lines) >= 3, F.array_max(F.transform(windows, row)))

    return let(clean_lines(text), best)


def facts(best: Column, as_of_year: int) -> Column:
    """array of struct(field, value, confidence) from the best alignment of a zone."""
    return let(best, lambda x: let(_checks(x["a"], x["b"]), lambda ok: _facts(x["a"], x["b"], x["c"], ok, as_of_year)))


def _checks(a: Column, b: Column) -> Column:
    """struct(number, birth, expiry, whole) of a zone's check digits: each is worked out once and read by many fields."""
    composite = F.concat(F.substring(a, 6, 25), part(b, 0, 7), part(b, 8, 15), part(b, 18, 29))
    return F.struct((check_sum(part(a, 5, 14), 9) == part(a, 14, 15)).alias("number"), dated(b, 0).alias("birth"), dated(b, 8).alias("expiry"), (check_sum(composite, 50) == part(b, 29, 30)).alias("whole"))


def _facts(a: Column, b: Column, c: Column, ok: Column, as_of_year: int) -> Column:
    number_ok, birth_ok, expiry_ok, whole_ok = [ok[n] for n in ("number", "birth", "expiry", "whole")]
    passed = number_ok.cast("int") + birth_ok.cast("int") + expiry_ok.cast("int")
    trusted = (passed >= 2) | whole_ok
    checked = F.when(whole_ok | (passed == 3), 98.0).otherwise(92.0)
    unchecked = F.when(whole_ok, 92.0).when(passed >= 2, 82.0).otherwise(65.0)
    number = F.regexp_replace(part(a, 5, 14), "<", "")
    optional = F.translate(part(a, 15, 28), *T.MRZ_DIGITS)
    surname, given = cleaned_name(F.regexp_extract(c, "^(.*?)<<", 1)), cleaned_name(F.regexp_extract(c, "^.*?<<(.*)\\z", 1))
    name = lambda v: accept(v, v.rlike("^[A-Z][A-Z -]{1,}\\z"))
    found = [
        ("documentNumber", accept(number, trusted & number_ok & number.rlike("^[A-Z0-9]{6,9}\\z")), checked),
        ("birthDate", F.when(trusted & birth_ok, date_of(part(b, 0, 6), False, as_of_year)), checked),
        ("expiryDate", F.when(trusted & expiry_ok, date_of(part(b, 8, 14), True, as_of_year)), checked),
        ("sex", accept(part(b, 7, 8), part(b, 7, 8).isin("M", "F")), unchecked),
        ("citizenship", accept(part(b, 15, 18), part(b, 15, 18).rlike("^[A-Z]{3}\\z")), unchecked),
        ("nationalIdNumber", accept(optional, (number_ok | whole_ok) & optional.rlike("^[0-9]{13}\\z")), unchecked),
        ("mrzSurname", name(surname), unchecked), ("mrzGivenNames", name(given), unchecked),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value"), conf.alias("confidence")) for k, v, conf in found])
    return F.when(passed > 0, F.filter(rows, lambda r: r["value"].isNotNull())).otherwise(F.filter(rows, lambda r: F.lit(False)))
