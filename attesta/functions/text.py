"""Cleaning, look-alikes, validators and similarity as Column -> Column functions. NULL means not accepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import tables as T

#: A word boundary between ASCII word characters only.
AB = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space, no-break space and byte-order mark.
S = r"[\s\x{00A0}\x{FEFF}]"


def label(pattern: str) -> str:
    """A label pattern as a Java one: case folded in every script, AB as the ASCII boundary."""
    return "(?iu)" + pattern.replace("AB", AB)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: a lambda variable in place of a repeated expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def accept(value: Column, test: Column) -> Column:
    return F.when(test, value)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(x + F.lit(0.5))))


# --- cleaning ------------------------------------------------------------------------------------------------------


def clean_text(text: Column) -> Column:
    """Collapse blanks in lines and runs of blank lines, and unwrap lines that go on in lower case."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), f"^{S}+|{S}+\\z", ""))
    joined = let(lines, lambda ls: F.array_join(F.filter(ls, lambda x, i: (x != "") | ((i > 0) & (F.get(ls, i - 1) != ""))), "\n"))
    unwrapped = F.regexp_replace(joined, r"([^.!?:;\n])\n(?=[a-zа-яёӣӯқғҳҷ])", "$1 ")
    return F.regexp_replace(F.regexp_replace(unwrapped, "\n{3,}", "\n\n"), f"^{S}+|{S}+\\z", "")


def clean_value(v: Column) -> Column:
    ends = r"[\s\x{00A0}\x{FEFF}:;/|.,-]+"
    return F.trim(F.regexp_replace(F.regexp_replace(v, f"^{ends}|{ends}\\z", ""), f"{S}+", " "))


def remove_first(v: Column, pattern: str) -> Column:
    return F.regexp_replace(v, f"^([\\s\\S]*?)(?:{pattern})", "$1")


def homoglyphs(v: Column) -> Column:
    return F.translate(v, *T.HOMOGLYPHS)


def number_digits(v: Column) -> Column:
    """One letter, then digits only: what is no digit becomes the one that it looks like, or 0."""
    tail = F.regexp_replace(F.translate(F.substring(v, 2, 1 << 20), *T.NUMBER_DIGITS), "[^0-9]", "0")
    return F.when(F.length(v) < 2, v).otherwise(F.concat(homoglyphs(F.substring(v, 1, 1)), tail))


def compose(v: Column) -> Column:
    """Canonical composition of the letters of this alphabet that have one."""
    for base, mark, whole in (("И", "̄", "Ӣ"), ("и", "̄", "ӣ"), ("У", "̄", "Ӯ"), ("у", "̄", "ӯ"), ("И", "̆", "Й"), ("и", "̆", "й"), ("Е", "̈", "Ё"), ("е", "̈", "ё")):
        v = F.replace(v, F.lit(base + mark), F.lit(whole))
    return v


def name_line(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(compose(v)), r"^[^\p{L}]+|[^\p{L}]+\z", ""), f"{S}+", " ")


def drop_single_letters(v: Column) -> Column:
    """Words of a name without one-letter ones, unless all are."""
    words = F.filter(F.split(F.regexp_replace(v, r"^[^\p{L}]+|[^\p{L}]+\z", ""), f"{S}+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_join(F.when(F.size(long) > 0, long).otherwise(words), " ")


def normal_dates(v: Column) -> Column:
    """Dates written with blanks or commas, and days that begin with a misread 0."""
    v = F.regexp_replace(v, r"(\d{1,2})\s*[.,]\s*(\d{1,2})\s*[.,]\s*(\d{4})", "$1.$2.$3")
    return F.regexp_replace(v, rf"{AB}[4-9](\d)\.(\d{{2}})\.(\d{{4}}){AB}", "0$1.$2.$3")


def same_name_key(v: Column) -> Column:
    return F.translate(F.lower(v), "қ", "к")


# --- predicates ----------------------------------------------------------------------------------------------------


def looks_like_value(v: Column) -> Column:
    return ~v.rlike('[|«»"\\[\\]]') & ~v.rlike(r"\s/\s") & (F.length(F.regexp_replace(v, r"[^\p{L}]", "")) >= 2)


def inline_value(v: Column) -> Column:
    return looks_like_value(v) & (F.length(v) <= 20)


def plausible_name(v: Column) -> Column:
    n = F.regexp_replace(v, f"^{S}+|{S}+\\z", "")
    return n.rlike(r"^[\p{Lu}\s'-]{4,}\z") & ~(n.rlike(r"\p{IsLatin}") & n.rlike(r"\p{IsCyrillic}"))


def english_label_text(v: Column) -> Column:
    words = F.regexp_extract_all(F.replace(F.replace(F.lower(v), F.lit("'"), F.lit("")), F.lit("’"), F.lit("")), F.lit("([a-z]+)"))
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(T.LABEL_WORDS))


def english_label_word(v: Column, confidence: Column) -> Column:
    w = F.regexp_replace(F.lower(v), "[^a-z]", "")
    return w.isin(T.LABEL_WORDS) & (confidence >= F.when(F.length(w) <= 3, 80).otherwise(50))


# --- validators ----------------------------------------------------------------------------------------------------


def real_date(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def validate_name(v: Column) -> Column:
    return let(clean_value(v), lambda c: accept(c, F.length(c).between(2, 60) & c.rlike(f"^[{T.NAME_LETTERS}' -]+\\z")))


def validate_date(v: Column) -> Column:
    found = F.regexp_extract(v, rf"{AB}(\d{{2}}[./]\d{{2}}[./]\d{{4}}){AB}", 1)
    ok = lambda d: real_date(F.substring(d, 1, 2), F.substring(d, 4, 2), F.substring(d, 7, 4)).isNotNull() & (F.substring(d, 7, 4) >= "0100")
    return let(F.replace(found, F.lit("/"), F.lit(".")), lambda d: accept(d, (d != "") & ok(d)))


def validate_sex(v: Column) -> Column:
    return let(F.upper(clean_value(v)), lambda c: F.when(c.isin(T.SEX_MALE), "M").when(c.isin(T.SEX_FEMALE), "F"))


def validate_document_number(v: Column) -> Column:
    return let(F.regexp_replace(F.upper(clean_value(v)), f"{S}", ""), lambda c: accept(c, c.rlike(r"^[A-Z]{1,3}\d{6,9}\z")))


def validate_digits(v: Column) -> Column:
    return let(F.regexp_replace(v, f"{S}", ""), lambda c: accept(c, c.rlike(r"^\d{8,14}\z")))


def validate_citizenship(v: Column) -> Column:
    return let(F.upper(clean_value(v)), lambda c: accept(c, c.isin(T.CITIZENSHIPS)))


def validate_text(v: Column) -> Column:
    return let(clean_value(v), lambda c: accept(c, F.length(c).between(2, 100) & c.rlike(f"[{T.NAME_LETTERS}]")))


VALIDATORS = {
    "surname": validate_name, "givenNames": validate_name, "fatherName": validate_name, "sex": validate_sex, "birthDate": validate_date, "birthPlace": validate_text,
    "citizenship": validate_citizenship, "documentNumber": validate_document_number, "nationalIdNumber": validate_digits, "issueDate": validate_date, "expiryDate": validate_date,
}


def validate_field(field: Column, v: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, check in VALIDATORS.items():
        out = F.when(field == name, check(v)).otherwise(out)
    return out


def zone_date(digits: Column, low: int, high: int) -> Column:
    day, month, year = F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 4)
    ok = digits.rlike(r"^\d{8}\z") & year.between(f"{low:04d}", f"{high:04d}") & real_date(day, month, year).isNotNull()
    return accept(F.concat_ws(".", day, month, year), ok)


def zone_kind(field: Column, part: Column) -> Column:
    return (
        F.when(part == "cyrillic", "cyrillicName").when(part == "latin", "latinName").when(field == "sex", "sex").when(field.isin("citizenship", "birthPlace"), "state")
        .when(field.isin("birthDate", "issueDate", "expiryDate"), "date").when(field == "nationalIdNumber", "digits13").when(field == "documentNumber", "documentNumber")
    )


def parse_zone_read(field: Column, part: Column, raw: Column, as_of_year: int) -> Column:
    """The value of one read of a zone on the front, or NULL. What several tests read is worked out once."""
    allowed = lambda text, others: F.regexp_replace(text, others, "")
    name = lambda v, shape: let(drop_single_letters(v), lambda n: accept(n, n.rlike(shape)))

    def state(letters: Column) -> Column:
        half = F.when(F.contains(letters, F.lit("/")), F.substring_index(letters, "/", -1)).otherwise(F.right(letters, F.lit(3)))
        return let(half, lambda h: F.when((F.length(h) >= 2) & (F.levenshtein(h, F.lit(T.STATE)) <= 1), T.STATE))

    def date(digits: Column) -> Column:
        return F.when(field == "birthDate", zone_date(digits, 1900, as_of_year)).when(field == "issueDate", zone_date(digits, 2000, as_of_year + 1)).otherwise(zone_date(digits, 2000, 2100))

    def number(compact: Column) -> Column:
        tail = F.translate(F.substring(compact, 2, 100), *T.ZONE_DIGITS)
        return let(tail, lambda t: accept(F.concat(F.substring(compact, 1, 1), t), compact.rlike(r"^[A-Z][A-Z0-9]{8}\z") & t.rlike(r"^\d{8}\z")))

    def of(kind: Column, text: Column) -> Column:
        return (
            F.when(kind == "cyrillicName", name(allowed(text, f"[^{T.CYRILLIC} '-]"), f"^[{T.CYRILLIC}]{{2,}}(?:[ '-][{T.CYRILLIC}]+)*\\z"))
            .when(kind == "latinName", name(allowed(text, "[^A-Z '-]"), r"^[A-Z]{2,}(?:[ '-][A-Z]+)*\z"))
            .when(kind == "sex", F.nullif(F.regexp_extract(F.regexp_replace(text, f"{S}+", ""), r"([MF])\z", 1), F.lit("")))
            .when(kind == "state", let(allowed(text, "[^A-Z/]"), state))
            .when(kind == "date", let(allowed(text, r"\D"), date))
            .when(kind == "digits13", let(allowed(text, r"\D"), lambda d: accept(d, F.length(d) == 13)))
            .when(kind == "documentNumber", let(allowed(text, "[^A-Z0-9]"), number))
        )

    text = F.upper(F.regexp_replace(compose(raw), f"^{S}+|{S}+\\z", ""))
    return let(F.struct(zone_kind(field, part).alias("kind"), text.alias("text")), lambda r: F.when(r["kind"].isNotNull(), of(r["kind"], r["text"])))


def parse_back_read(field: Column, part: Column, raw: Column) -> Column:
    """The value of one read of a zone on the back, or NULL. What several tests read is worked out once."""

    def written(up: Column) -> Column:
        allowed = F.regexp_replace(up, f"[^{T.CYRILLIC}0-9 .,/()№-]", "")
        words = F.filter(F.split(F.regexp_replace(allowed, f"{S}+", " "), " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))
        text = F.trim(F.regexp_replace(F.array_join(words, " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N})]+\z", ""))
        return let(text, lambda t: accept(t, F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= F.when(field == "address", 3).otherwise(6)))

    up = F.upper(compose(raw))
    cyr = F.regexp_replace(F.substring_index(up, "/", 1), f"[^{T.CYRILLIC}]", "")
    lat = F.regexp_replace(F.trim(F.substring_index(F.upper(raw), "/", -1)), "[^A-Z]", "")
    status = lambda lat: F.get(F.filter(F.array(*[F.lit(x) for x in T.MARITAL]), lambda x: (F.length(lat) >= F.length(x) - 1) & (F.levenshtein(F.right(lat, F.length(x)), x) <= 1)), F.lit(0))
    form = r"^(AB|A|B|O)\(?(I{1,3}|IV)?\)?RH([+-])?\z"

    def blood(v: Column) -> Column:
        kind = lambda k: F.when(k != "", F.concat(F.lit("("), k, F.lit(")"))).otherwise("")
        group = F.concat(F.regexp_extract(v, form, 1), let(F.regexp_extract(v, form, 2), kind), F.lit("Rh"), F.regexp_extract(v, form, 3))
        return F.when(v.rlike(r"^N/?A\z"), "N/A").when(v.rlike(form), group)

    return (
        F.when(field.isin("address", "authority"), let(up, written))
        .when((field == "maritalStatus") & (part == "cyrillic"), let(cyr, lambda c: accept(c, F.length(c) >= 4))).when(field == "maritalStatus", let(lat, status))
        .when(field == "bloodGroup", let(F.regexp_replace(F.upper(raw), r"[^A-Z0-9()+\-/]", ""), blood)).when(field == "taxId", let(F.regexp_replace(raw, r"\D", ""), lambda d: accept(d, F.length(d) == 9)))
    )


# --- similarity ----------------------------------------------------------------------------------------------------


def distance_ratio(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def transliterate(v: Column) -> Column:
    """Letter by letter; letters outside the table are dropped."""
    single = {k: x for k, x in T.TRANSLIT.items() if len(x) == 1}
    several = {k: x for k, x in T.TRANSLIT.items() if len(x) > 1}
    out = F.regexp_replace(v, f"[^{''.join(T.TRANSLIT)}]", "")
    out = F.translate(out, "".join(single) + "ЪЬ", "".join(single.values()))
    for letter, token in several.items():
        out = F.replace(out, F.lit(letter), F.lit(token))
    return out


def cyrillic_skeleton(v: Column) -> Column:
    return F.translate(F.regexp_replace(v, f"[^{T.SKELETON[0]}]", ""), *T.SKELETON)


def latin_skeleton(v: Column) -> Column:
    for a, b in T.LATIN_SKELETON:
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(v, "[AEIOUY]", ""), "[^A-Z]", "")


def names_agree(cyrillic: Column, latin: Column) -> Column:
    a, b = cyrillic_skeleton(cyrillic), latin_skeleton(latin)
    return (F.length(a) >= 2) & (F.length(b) >= 2) & (F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) <= 0.25)


def compact_latin(v: Column) -> Column:
    return F.regexp_replace(v, "[^A-Z]", "")


def agrees(cyrillic: Column, latin: Column) -> Column:
    return (distance_ratio(transliterate(cyrillic), compact_latin(latin)) <= 0.25) | names_agree(cyrillic, latin)
