"""Alignment of a word with its Latin spelling: cost against plain recursion, and what it writes."""

import random
from functools import cache

from attesta.functions import tables as T
from attesta.operators import names


def least_cost(word, latin):
    """The cost of the cheapest way, by trying all."""

    @cache
    def rest(i, j):
        if i == len(word) and j == len(latin):
            return 0.0
        ways = [float("inf")]
        if i < len(word):
            own = T.TRANSLIT.get(word[i], "")
            ways.append(2.0 + rest(i + 1, j))
            if own == "":
                ways.append(0.5 + rest(i + 1, j))
            elif latin.startswith(own, j):
                ways.append(rest(i + 1, j + len(own)))
        for token, options in T.LATIN_TOKENS:
            if latin.startswith(token, j):
                ways.append(2.0 + rest(i, j + len(token)))
                if i < len(word) and word[i] not in options:
                    near = any(o in names.CONFUSED.get(word[i], ()) for o in options)
                    ways.append((1.0 if near else 3.0) + rest(i + 1, j + len(token)))
        return min(ways)

    return rest(0, 0)


def test_alignment_is_found_exactly_where_it_is_cheap_enough():
    rng = random.Random(6)
    found = 0
    for _ in range(400):
        word = [rng.choice(T.CYRILLIC) for _ in range(rng.randrange(9))]
        latin = "".join(T.TRANSLIT[c] for c in word)
        for _ in range(rng.randrange(3)):
            if word:
                word[rng.randrange(len(word))] = rng.choice(T.CYRILLIC + "'")
        got = names.aligned("".join(word), latin)
        assert (got is not None) == (bool(latin) and least_cost("".join(word), latin) <= names.MAX_COST)
        found += got is not None
    assert found > 150


def test_what_alignment_writes():
    assert names.aligned("САФАРОВ", "SAFAROV") == "САФАРОВ"
    assert names.aligned("СНФАРОВ", "SAFAROV") is None or names.aligned("СНФАРОВ", "SAFAROV") != "СНФАРОВ"
    assert names.aligned("САФАРОВ", "") is None and names.aligned("А Б", "AB") is None and names.aligned("", "SAF") is None
    assert names.aligned("ЛАЛИ", "ALI") == "АЛИ"  # one letter too many
    assert names.aligned("ПОЗИМ", "NOZIM") == "НОЗИМ"  # a letter that recognition confuses


def test_hooks_are_flipped_as_if_all_spellings_were_tried():
    from itertools import product

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def tried(word, readings):
        spellings = []
        for flips in product((0, 1), repeat=sum(c in T.HOOKS for c in word)):
            each = iter(flips)
            spelt = "".join(T.HOOKS[c] if c in T.HOOKS and next(each) else c for c in word)
            latin = "".join(T.TRANSLIT.get(c, "") for c in spelt)
            spellings.append((sum(distance(latin, a) for a in readings), sum(flips), sum(f << i for i, f in enumerate(flips)), spelt))
        return min(spellings)[3]

    rng = random.Random(8)
    for n in range(250):
        word = "".join(rng.choice("КҚХҲГҒЧҶ" * 2 + "АНИШЯЩЪ '") for _ in range(rng.randrange(1, 12 if n % 10 else 15)))
        readings = ["".join(rng.choice("KQHGCJAS") for _ in range(rng.randrange(1, 14))) for _ in range(rng.choice((1, 1, 2, 3)))]
        if n % 2:
            spelt = "".join(T.HOOKS[c] if c in T.HOOKS and rng.random() < 0.5 else c for c in word)
            readings[0] = "".join(T.TRANSLIT.get(c, "") for c in spelt)[rng.randrange(2) :] or "K"
        readings += readings[:1] * (n % 7 == 0)
        assert names.flipped(word, readings) == tried(word, readings), (word, readings)
    # more hooks than a machine word has bits
    assert names.flipped("К" * 70, ["Q" * 70]) == "Қ" * 70 and names.flipped("ХЧ" * 30, ["HCH" * 30, "HCH" * 30]) == "ҲЧ" * 30


def test_words_of_many_hooks_are_repaired_where_the_whole_is_asked_for(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    from attesta.plans import queries

    rows = [("К" * 9, ["Q" * 9]), ("СП" + "Қ" * 12, ["SN" + "Q" * 12]), ("Х" * 10 + "П", ["H" * 10 + "N", "KH" * 10 + "N"]), ("Ғ" * 9, []), ("КОСИМ", ["QOSIM"]), (None, ["A"])]
    df = spark.createDataFrame(rows, "w string, l array<string>")
    got = [(r.repaired, r.ratio) for r in names.with_repair(df, "w", F.col("l"), whole=True).collect()]
    assert got == [("Қ" * 9, 0.0), ("СН" + "Қ" * 12, 0.0), ("Х" * 10 + "Н", 0.0), ("Ғ" * 9, 1.0), ("ҚОСИМ", 0.0), ("А", 0.0)]
    # keys whose digits are hooks, as the queries' SQL has them
    spark.createDataFrame([(k,) for k in (7, 333333333, 555666333, 3336665553336)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    customer = duckdb.read_parquet(f"{tmp_path}/customer.parquet/*.parquet")  # noqa: F841 - read by the SQL
    for name in ("name_alignment", "name_repair"):
        want = duckdb.sql(queries.ORACLE_SQL[name]).fetchall()
        assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)
