"""Every operator on its own: nominal values, bounds, absence."""

import pytest
from pyspark.sql import functions as F

from corpident.operators import assertions, canonical, integers, outcomes, predicates, strings
from corpident.operators.alphabets import WHITESPACE


def values(spark, texts, **columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return rows.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").drop("i").collect()


S = None


@pytest.fixture(autouse=True)
def _column(spark):
    global S
    S = F.col("s")


def test_views(spark):
    rows = values(
        spark,
        ["ABC.12", "AB", "", None, "😀é.x"],
        cut=strings.slice_(S, 1, 3),
        suffix=strings.slice_from(S, 2),
        head=strings.slice_to(S, 2),
        before=strings.before_first(S, "."),
        after=strings.after_first(S, "."),
        bare=strings.strip_prefix(S, "AB"),
        joined=strings.concat(S, F.lit("!")),
    )
    assert [tuple(r) for r in rows] == [
        ("BC", "C.12", "AB", "ABC", "12", "C.12", "ABC.12!"),
        (None, "", "AB", None, None, "", "AB!"),
        (None, None, None, None, None, None, "!"),
        (None,) * 7,
        ("é.", ".x", "😀é", "😀é", "x", None, "😀é.x!"),
    ]
    assert values(spark, ["abc"], x=strings.slice_(S, 2, 1))[0].x is None


def test_integers(spark):
    rows = values(
        spark,
        ["012345674", "0", "9" * 18, None, "", "12A", "1 2", "٣٤", "9" * 30, "+12", " 12 "],
        n=integers.digits_to_integer(S),
        m=integers.mod_digits(S, 97),
    )
    assert [r.n for r in rows] == [12345674, 0, int("9" * 18), None, None, None, None, None, None, None, None]
    assert [r.m for r in rows] == [12345674 % 97, 0, int("9" * 18) % 97, None, None, None, None, None, int("9" * 30) % 97, None, None]


def test_integer_steps(spark):
    rows = spark.createDataFrame([(100,), (-1,), (None,), (3,), (0,), (97,), (98,), (4,), (5,)], "i bigint")
    i = F.col("i")
    got = rows.select(integers.modulo(i, 97), integers.complement(i, 97), integers.remainder_map(i, [9, 8, 7, 6, 5])).collect()
    assert [tuple(r) for r in got] == [(3, None, None), (96, None, None), (None, None, None), (3, 94, 6), (0, 97, 9), (0, 0, None), (1, None, None), (4, 93, 5), (5, 92, None)]


@pytest.mark.parametrize(
    ("weights", "alignment", "alphabet", "text", "expected"),
    [
        ([1, 2, 3], "left", "0123456789", "12", 1 + 4),
        ([1, 2, 3], "left", "0123456789", "12345", 1 + 4 + 9),
        ([1, 2, 3], "right", "0123456789", "12345", 3 + 8 + 15),
        ([1, 2, 3], "right", "0123456789", "45", 8 + 15),
        ([1, 2], "cycle", "0123456789", "12345", 1 + 4 + 3 + 8 + 5),
        ([1], "left", "0123456789", "1A", None),
        ([1], "left", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "Z", 35),
        ([2], "left", "XYZ", "Z", 4),
        ([1], "left", "0123456789", "", None),
        ([2**62], "left", "0123456789", "9", None),
    ],
)
def test_weighted_sum(spark, weights, alignment, alphabet, text, expected):
    assert values(spark, [text], n=integers.weighted_sum(S, weights, alignment, alphabet))[0].n == expected


def test_predicates(spark):
    p = predicates
    rows = values(
        spark,
        ["AB12", "", None, "123\n"],
        empty=p.is_empty(S),
        absent=p.is_absent(S),
        eq=p.equals(S, S),
        n=p.length_eq(S, 4),
        among=p.length_in(S, [0, 4]),
        between=p.length_between(S, 1, 3),
        digits=p.ascii_digits(S),
        upper=p.ascii_upper_letters(S),
        alnum=p.ascii_alphanumeric(S),
        charset=p.ascii_charset(S, "AB12"),
        starts=p.starts_with(S, "A"),
        ends=p.ends_with(S, "2"),
        listed=p.prefix_in(S, ["A", "AA", "XYZ"]),
        at=p.char_at_in(S, 3, "2"),
        has=p.contains(S, "B1"),
        every=p.all_of(p.is_empty(S), p.length_eq(S, 0)),
        some=p.any_of(p.is_absent(S), p.is_empty(S)),
        negated=p.not_(p.is_empty(S)),
    )
    got = [[k for k, v in r.asDict().items() if v] for r in rows]
    assert got == [
        ["eq", "n", "among", "alnum", "charset", "starts", "ends", "listed", "at", "has", "negated"],
        ["empty", "eq", "among", "every", "some"],
        ["absent", "some", "negated"],
        ["eq", "n", "among", "negated"],
    ]
    assert all(v is not None for r in rows for v in r)
    assert values(spark, [""], x=p.prefix_in(S, []))[0].x is False


def test_canonicalization(spark):
    c = canonical
    every = WHITESPACE + "a" + WHITESPACE + "ß​" + WHITESPACE
    row = values(spark, [every], t=c.trim_whitespace()(S), r=c.remove_whitespace()(S), u=c.steps(c.remove_whitespace(), c.uppercase_ascii())(S))[0]
    assert row.t == "a" + WHITESPACE + "ß​"
    assert (row.r, row.u) == ("aß​", "Aß​")
    row = values(
        spark,
        ["GR12"],
        removed=c.remove_chars("1R")(S),
        replaced=c.replace_prefix("GR", "EL")(S),
        prepended=c.prepend("x")(S),
        appended=c.append("x")(S),
        inserted=c.insert(4, "-")(S),
        too_far=c.insert(5, "-")(S),
        padded=c.left_pad(6, "0")(S),
        long=c.left_pad(2, "0")(S),
        kept=c.prepend_country_if_missing(["EL", "GR"], "EL")(S),
        added=c.prepend_country_if_missing(["BE"], "BE")(S),
        when=c.when(lambda v: F.length(v) == 4, c.append("!"), c.prepend("?"))(S),
        unless=c.when(lambda v: F.length(v) == 5, c.append("!"))(S),
    )[0]
    assert tuple(row) == ("G2", "EL12", "xGR12", "GR12x", "GR12-", "GR12", "00GR12", "GR12", "GR12", "BEGR12", "?GR12!", "GR12")


def test_assertions(spark):
    a = assertions.sequence(assertions.require(~predicates.is_empty(S), "empty", "k"), assertions.require(predicates.length_eq(S, 2), "invalid_length"))
    rows = values(spark, ["ab", "", "abc"], a=a)
    assert [r.a and tuple(r.a) for r in rows] == [None, ("empty", "k"), ("invalid_length", None)]
    with pytest.raises(ValueError):
        assertions.require(F.lit(True), "invalid_checksum")


def statuses(spark, texts, outcome):
    return [r.o and r.o.status for r in values(spark, texts, o=outcome)]


def test_luhn_and_mod97(spark):
    assert statuses(spark, ["18260012 30599"[:8] + "1230059", "1826001230", "50191231", "1", "", "1A", None], outcomes.luhn(S))[3:] == ["unsupported"] * 4
    digits = [f"{n:05d}" for n in range(200)]

    def luhn(t):
        d = [int(c) for c in reversed(t)]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    assert statuses(spark, digits, outcomes.luhn(S)) == ["valid" if luhn(t) else "invalid" for t in digits]
    texts = ["195A68Z90", "196A85", "98", None, "a95", "1-5", "001", "098"]
    number = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    assert statuses(spark, texts, outcomes.mod97_10(S))[2:6] == ["unsupported"] * 4
    assert statuses(spark, ["195A68Z90", "196A85", "001", "098"], outcomes.mod97_10(S)) == ["valid" if number(t) == 1 else "invalid" for t in ["195A68Z90", "196A85", "001", "098"]]


def test_comparisons(spark):
    i = integers.digits_to_integer(strings.slice_to(S, 1))
    assert statuses(spark, ["77", "78", "7", "7x", "x7", None], outcomes.compare_digit(i, S, 1)) == ["valid", "invalid", "unsupported", "unsupported", "unsupported", "unsupported"]
    assert statuses(spark, ["707", "708", "70"], outcomes.compare_slice(i, S, 1, 3)) == ["valid", "invalid", "unsupported"]
    assert statuses(spark, ["7", "8", "x"], outcomes.compare_constant(i, 7)) == ["valid", "invalid", "unsupported"]
    assert statuses(spark, ["x"], outcomes.compare_digit(F.lit(12).cast("bigint"), F.lit("2"), 0)) == ["invalid"]


def test_combinations(spark):
    v, i, u = outcomes.valid(), outcomes.outcome("invalid", "invalid_checksum", "k"), outcomes.unsupported("checksum_not_published")
    never = outcomes.when(F.lit(False), v)
    one = lambda o: statuses(spark, ["x"], o)[0]
    assert [one(outcomes.all_checks(*x)) for x in ((v, v), (v, u, v), (u, i, v), ())] == ["valid", "unsupported", "invalid", "valid"]
    assert [one(outcomes.any_check(*x)) for x in ((i, v), (i, u), (i, i), ())] == ["valid", "unsupported", "invalid", "unsupported"]
    assert [one(outcomes.choose(*x)) for x in ((never, v, i), (i, v), (), (never,))] == ["valid", "invalid", "unsupported", "unsupported"]
