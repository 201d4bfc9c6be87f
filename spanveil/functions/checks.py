"""Checksums of recognized identifiers: true, false, or null where a type has no check. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.validators import only_digits

LETTERS36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digit(x: Column, k: int) -> Column:
    return F.substring(x, k + 1, 1).cast("int")


def weighted(x: Column, weights, start: int = 0) -> Column:
    """Sum of digits times weights, from a position on."""
    return sum((digit(x, start + k) * w for k, w in enumerate(weights)), F.lit(0))


def luhn(d: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def abn(d: Column) -> Column:
    return (weighted(d, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)) - 10) % 89 == 0


def acn(d: Column) -> Column:
    return (10 - weighted(d, range(8, 0, -1)) % 10) % 10 == digit(d, 8)


def tfn(d: Column) -> Column:
    return weighted(d, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0


def medicare(d: Column) -> Column:
    return weighted(d, (1, 3, 7, 9, 1, 3, 7, 9)) % 10 == digit(d, 8)


# Multiplication and permutation of the dihedral checksum.
VERHOEFF_D = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
VERHOEFF_P = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")


def verhoeff(d: Column) -> Column:
    """Right to left: the running value is multiplied by the permuted digit."""
    rows = lambda t: F.array(*[F.lit(r) for r in t])
    figures = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    marked = F.transform(figures, lambda c, i: F.struct(c.cast("int").alias("c"), (i % 8).alias("r")))
    pick = lambda table, r, c: F.substring(F.get(rows(table), r), c + 1, F.lit(1)).cast("int")
    return F.aggregate(marked, F.lit(0), lambda acc, x: pick(VERHOEFF_D, acc, pick(VERHOEFF_P, x["r"], x["c"]))) == 0


def iban(x: Column) -> Column:
    """The rest modulo 97 of the rearranged number, letters as two digits, a digit at a time."""
    t = F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(t, 5, 100), F.substring(t, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS36), c) - 1)
    return F.aggregate(values, F.lit(0), lambda acc, v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)) == 1


def pesel(d: Column) -> Column:
    return (10 - weighted(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10) % 10 == digit(d, 10)


def nhs(d: Column) -> Column:
    return weighted(d, range(10, 0, -1)) % 11 == 0


def aba(d: Column) -> Column:
    return weighted(d, (3, 7, 1, 3, 7, 1, 3, 7, 1)) % 10 == 0


def npi(d: Column) -> Column:
    return luhn(F.concat(F.lit("80840"), d))


def dea(x: Column) -> Column:
    d = only_digits(x)
    return (digit(d, 0) + digit(d, 2) + digit(d, 4) + 2 * (digit(d, 1) + digit(d, 3) + digit(d, 5))) % 10 == digit(d, 6)


def de_tax(d: Column) -> Column:
    """ISO 7064 mod 11, 10."""
    product = F.lit(10)
    for k in range(10):
        s = (digit(d, k) + product) % 10
        product = (F.when(s == 0, 10).otherwise(s) * 2) % 11
    return (11 - product) % 10 == digit(d, 10)


def th_tnin(d: Column) -> Column:
    return (11 - weighted(d, range(13, 1, -1)) % 11) % 10 == digit(d, 12)


def kr_rrn(d: Column) -> Column:
    return (11 - weighted(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == digit(d, 12)


def kr_frn(d: Column) -> Column:
    return (13 - weighted(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == digit(d, 12)


def kr_brn(d: Column) -> Column:
    return (10 - (weighted(d, (1, 3, 7, 1, 3, 7, 1, 3, 5)) + F.floor(digit(d, 8) * 5 / 10)) % 10) % 10 == digit(d, 9)


def es_letter(x: Column) -> Column:
    """NIF and NIE: the letter of the number modulo 23; X, Y, Z stand for 0, 1, 2."""
    t = F.regexp_replace(F.upper(x), "-", "")
    number = F.concat(F.translate(F.substring(t, 1, 1), "XYZ", "012"), F.regexp_extract(t, "^.([0-9]*)", 1)).cast("int")
    return F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (number % 23 + 1).cast("int"), F.lit(1)) == F.regexp_extract(t, "([A-Z])$", 1)


def fi_code(x: Column) -> Column:
    number = F.concat(F.substring(x, 1, 6), F.substring(x, 8, 3)).cast("int")
    return F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (number % 31 + 1).cast("int"), F.lit(1)) == F.upper(F.substring(x, 11, 1))


def it_vat(x: Column) -> Column:
    d = only_digits(x)
    even = sum((F.when(digit(d, k) * 2 > 9, digit(d, k) * 2 - 9).otherwise(digit(d, k) * 2) for k in range(1, 10, 2)), F.lit(0))
    odd = sum((digit(d, k) for k in range(0, 10, 2)), F.lit(0))
    return (d != "00000000000") & ((10 - (odd + even) % 10) % 10 == digit(d, 10))


def de_letter_sum(x: Column, head: int, tail: int, weights) -> Column:
    """Sum of the cross sums of weighted figures; the letter after ``head`` digits counts as its two-digit place in the alphabet."""
    t = F.upper(F.trim(x))
    place = F.lpad((F.ascii(F.substring(t, head + 1, 1)) - 64).cast("string"), 2, "0")
    figures = F.concat(F.substring(t, 1, head), place, F.substring(t, head + 2, tail))
    products = [digit(figures, k) * w for k, w in enumerate(weights)]
    return sum((F.when(p > 9, F.floor(p / 10) + p % 10).otherwise(p) for p in products), F.lit(0))


def kvnr(x: Column) -> Column:
    t = F.upper(F.trim(x))
    return t.rlike("^[A-Z][0-9]{9}$") & (de_letter_sum(x, 0, 8, (2, 9, 8, 7, 6, 5, 4, 3, 2, 1)) % 10 == digit(t, 9))


def rvnr(x: Column) -> Column:
    t = F.upper(F.trim(x))
    return t.rlike("^[0-9]{8}[A-Z][0-9]{3}$") & (de_letter_sum(x, 8, 2, (2, 1) * 6) % 10 == digit(t, 11))


def gstin(x: Column) -> Column:
    """A state, ten places with letters, four digits and a letter, a place, Z, a place."""
    t = F.upper(F.regexp_replace(x, "[- ]", ""))
    letters = F.length(F.regexp_replace(F.substring(t, 3, 5), "[^A-Z]", ""))
    return t.rlike("^(0[1-9]|[12][0-9]|3[0-7])[A-Z0-9]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$") & (letters >= 3)


# What characters at odd places of an Italian fiscal code count, in the order of LETTERS36.
IT_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def it_fiscal(x: Column) -> Column:
    """Odd places by a table, even ones by value, a letter from its place in the alphabet; the rest by 26 is the last letter."""
    t = F.upper(x)
    at = lambda k: F.instr(F.lit(LETTERS36), F.substring(t, k + 1, 1)) - 1
    odd = sum((F.get(F.array(*[F.lit(v) for v in IT_ODD]), at(k)) for k in range(0, 15, 2)), F.lit(0))
    even = sum((F.when(at(k) > 9, at(k) - 10).otherwise(at(k)) for k in range(1, 15, 2)), F.lit(0))
    return (F.length(t) == 16) & (F.substring(F.lit(LETTERS36), ((odd + even) % 26 + 11).cast("int"), F.lit(1)) == F.substring(t, 16, 1))


def ssn_invalid(x: Column) -> Column:
    """Mixed separators, one digit throughout, a zero group, or a number that is never issued."""
    d = only_digits(x)
    separators = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(x, "[0-9]", ""), ""), lambda c: c != "")))
    return (separators > 1) | d.rlike(r"^([0-9])\1*$") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000") | d.rlike("^(000|666|123456789|98765432|078051120)")


# Checks by what they do: decide (true lifts to score 1, false drops), refuse (true drops) or lift (true lifts) a match.
DECIDE = {
    "AU_ABN": lambda x, d: abn(d),
    "AU_ACN": lambda x, d: acn(d),
    "AU_TFN": lambda x, d: tfn(d),
    "AU_MEDICARE": lambda x, d: medicare(d),
    "IN_AADHAAR": lambda x, d: (F.length(d) == 12) & (F.substring(d, 1, 1) >= "2") & verhoeff(d) & (d != F.reverse(d)),
    "IBAN_CODE": lambda x, d: iban(x),
    "PL_PESEL": lambda x, d: pesel(d),
    "UK_NHS": lambda x, d: nhs(d),
    "ABA_ROUTING_NUMBER": lambda x, d: aba(d),
    "US_NPI": lambda x, d: npi(d),
    "MEDICAL_LICENSE": lambda x, d: dea(x),
    "DE_TAX_ID": lambda x, d: de_tax(d),
    "TH_TNIN": lambda x, d: th_tnin(d),
    "KR_BRN": lambda x, d: kr_brn(d),
    "ES_NIF": lambda x, d: es_letter(x),
    "ES_NIE": lambda x, d: es_letter(x),
    "FI_PERSONAL_IDENTITY_CODE": lambda x, d: fi_code(x),
    "IT_VAT_CODE": lambda x, d: it_vat(x),
    "CREDIT_CARD": lambda x, d: luhn(d),
    "DE_HEALTH_INSURANCE": lambda x, d: kvnr(x),
    "DE_SOCIAL_SECURITY": lambda x, d: rvnr(x),
    "IN_GSTIN": lambda x, d: gstin(x),
    "IT_FISCAL_CODE": lambda x, d: it_fiscal(x),
    "SE_PERSONNUMMER": lambda x, d: luhn(F.right(d, F.lit(10))),
    "SE_ORGANISATIONSNUMMER": lambda x, d: luhn(d),
}
REFUSE = {
    "US_SSN": lambda x, d: ssn_invalid(x),
    "CA_SIN": lambda x, d: ~luhn(d),
    "MAC_ADDRESS": lambda x, d: F.regexp_replace(F.upper(x), "[^0-9A-F]", "").isin("0" * 12, "F" * 12),
}
LIFT = {"KR_RRN": lambda x, d: kr_rrn(d), "KR_FRN": lambda x, d: kr_frn(d), "NG_NIN": lambda x, d: verhoeff(d)}


def verdict(entity: Column, text: Column, entities) -> Column:
    """True lifts a match to score 1, false drops it, null leaves its score. Only the checks of ``entities`` are compiled."""
    d = only_digits(text)
    sure = lambda c: F.coalesce(c, F.lit(False))
    out = F.lit(None).cast("boolean")
    for table, what in ((DECIDE, lambda c: sure(c)), (REFUSE, lambda c: F.when(sure(c), False)), (LIFT, lambda c: F.when(sure(c), True))):
        for name, test in table.items():
            if name in entities:
                out = F.when(entity == name, what(test(text, d))).otherwise(out)
    return out
