"""Checks and routing of digit strings. Plain column expressions without joins or Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and check characters of 18-character identity numbers.
ID18_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID18_CHECKS = "10X98765432"
# Area codes that no North American number has, and the exchange that is refused.
NO_AREA = ("211", "311", "411", "511", "611", "711", "811", "911")
NO_EXCHANGE = "555"
# Least share of letter/digit changes and characters of a free-standing code.
CODE_CHANGES, FRAGMENT_CHARS = 3, 5


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    return d.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", d)


def bank_prefix(d: Column) -> Column:
    """A card issuer's prefix with a length it uses."""
    n, two, four = F.length(d), F.substring(d, 1, 2), F.substring(d, 1, 4).cast("int")
    return F.coalesce(
        (d.startswith("4") & n.between(13, 19))
        | (two.isin("51", "52", "53", "54", "55") & (n == 16))
        | (four.between(2221, 2720) & (n == 16))
        | (two.isin("34", "37") & (n == 15))
        | ((two == "62") & n.between(16, 19))
        | (((four == 6011) | (two == "65")) & (n == 16))
        | (four.between(3528, 3589) & (n == 16)),
        F.lit(False),
    )


def cn_mobile(d: Column) -> Column:
    return d.rlike("^1[3-9][0-9]{9}$")


def us_phone(d: Column) -> Column:
    return d.rlike("^[2-9][0-9]{9}$") & ~F.substring(d, 1, 3).isin(*NO_AREA) & (F.substring(d, 4, 3) != NO_EXCHANGE)


def month_day(x: Column, at: int) -> Column:
    """Two digits of a month and two of a day, at a position from 1."""
    return F.substring(x, at, 2).cast("int").between(1, 12) & F.substring(x, at + 2, 2).cast("int").between(1, 31)


def cn_id18(x: Column) -> Column:
    total = sum((F.substring(x, k + 1, 1).cast("int") * w for k, w in enumerate(ID18_WEIGHTS)), F.lit(0))
    check = F.substring(F.lit(ID18_CHECKS), (total % 11 + 1).cast("int"), F.lit(1))
    return F.coalesce(x.rlike("^[0-9]{17}[0-9Xx]$") & (F.upper(F.substring(x, 18, 1)) == check) & month_day(x, 11), F.lit(False))


def cn_id15(d: Column) -> Column:
    return F.coalesce(d.rlike("^[0-9]{15}$") & month_day(d, 9), F.lit(False))


def phone_digits(d: Column, region: Column, pattern: Column) -> Column:
    """Digits of a phone without its country code: 86 before a mobile number, 1 for the shapes that carry it."""
    return F.when(d.rlike("^861[3-9][0-9]{9}$") & F.coalesce(region != "us", F.lit(True)), F.substring(d, 3, 11)).when(
        (region == "us") & pattern.isin("us_country_code", "us_country_code_paren", "us_trunk_area_paren") & d.rlike("^1[0-9]{10}$"), F.substring(d, 2, 10)
    ).otherwise(d)


def route(digits: Column, text: Column, fragment: Column, region: Column) -> Column:
    """Name of the check that a fragment passes, or null. A fixed region allows only its phone; the order is phone, identity
    number of 18 and of 15, card - so a 15-digit card that reads as a date is an identity number."""
    num = fragment == "NUM"
    id_text = (fragment == "ALNUM") & text.rlike("^[0-9]{17}[Xx]$")
    n, free = F.length(digits), F.coalesce(region, F.lit("")) == ""
    free = free | ~F.coalesce(region, F.lit("")).isin("cn", "us")
    return (
        F.when(~(num | id_text) | (n == 0), None)
        .when(num & (region == "cn"), F.when(cn_mobile(digits), "validated_phone_cn"))
        .when(num & (region == "us"), F.when(us_phone(digits), "validated_phone_us"))
        .when(free & num & cn_mobile(digits), "validated_phone_cn")
        .when(free & num & us_phone(digits), "validated_phone_us")
        .when(((n == 18) | id_text) & cn_id18(F.when(F.length(text) == 18, text).otherwise(digits)), "validated_id_cn_18")
        .when(num & cn_id15(digits), "validated_id_cn_15")
        .when(num & luhn(digits) & bank_prefix(digits), "validated_bank_number_pan")
    )


def attr_of(check: Column) -> Column:
    """Attribute type of a passed check."""
    return F.when(check.startswith("validated_phone"), "phone").when(check.startswith("validated_id"), "id_number").when(check.startswith("validated_bank"), "bank_number")


def compact_clock(x: Column) -> Column:
    """HH:MM or HH:MM:SS of a clock time, or the empty string."""
    t = F.translate(F.regexp_replace(x, r"[\s]", ""), "：", ":")
    h = F.lpad(F.regexp_extract(t, "^([0-9]{1,2}):", 1), 2, "0")
    return F.when(t.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), F.concat(h, F.regexp_replace(t, "^[0-9]{1,2}", ""))).otherwise("")


def content_shape(x: Column) -> Column:
    """time, alnum or num by the look of a value; null for words, signs and blanks."""
    letter, digit = x.rlike(r"\p{L}"), x.rlike(r"\p{Nd}")
    return F.when(F.trim(x) == "", None).when(compact_clock(x) != "", "time").when(letter & (digit | x.rlike(r"[._+\-/]")), "alnum").when(digit & ~letter, "num")


def stands_alone(x: Column) -> Column:
    """A code that looks private without context: ASCII with a letter, and a hyphen or underscore or at least three changes
    between letters and digits."""
    packed = F.regexp_replace(x, "[^A-Za-z0-9]", "")
    changes = F.regexp_count(packed, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"))
    return x.rlike("^[A-Za-z0-9_-]+$") & x.rlike("[A-Za-z]") & (x.rlike("[_-]") | (changes >= CODE_CHANGES))


def passes_gate(attr: Column, text: Column, context: Column) -> Column:
    """Whether a candidate is emitted: never times and amounts; numbers of five digits or in context; codes of five letters and
    digits that stand in context or alone; all else."""
    solid = F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) >= FRAGMENT_CHARS
    return (
        F.when(attr.isin("time", "amount"), False)
        .when(attr == "num", (F.length(only_digits(text)) >= FRAGMENT_CHARS) | context)
        .when(attr == "alnum", solid & (context | stands_alone(text)))
        .otherwise(True)
    )
