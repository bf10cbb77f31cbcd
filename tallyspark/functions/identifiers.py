"""Checksums of personal identifiers as column expressions, and the patterns that find them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): letters, digits and white space of every script, not of ASCII alone.
# Patterns for a whole table cell.
CELL_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CELL_PHONE = r"(?U)^(?:\+|00|0)[\d\s().\-/]{8,}$"
CELL_DECIMAL = r"(?U)^-?\d+[.,]\d+$"
CELL_NUMBERLIKE = r"(?U)^[\d\s\-]+$"
CELL_CODE = r"(?U)^[^\W\d_]+[ _\-]?[A-Z0-9]{1,4}$"
IBAN = r"(?U)\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b"

# Patterns inside running text.
TEXT_NOISE = r"(?iU)https?://\S+|\bdoi:\s*\S+|\b10\.\d{4,9}/\S+|\bISBN[\s:-]*[\dXx-]{10,17}"
TEXT_PHONE = r"(?U)(?<![\w.])(?:\+|00)\d[\d ()./-]{7,}\d(?![\w])"
TEXT_ELEVEN = r"(?U)(?<!\d)\d{11}(?!\d)"
TEXT_TEN = r"(?U)(?<!\d)\d{10}(?!\d)"
TEXT_CARD = r"(?U)(?<!\d)(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)"
CURRENCY = r"(?:HUF|Ft|EUR|€|USD|US\$|\$|TRY|TL|₺|RON|lei|GBP|£)"
TEXT_AMOUNT = rf"(?iU)(?<![\w]){CURRENCY}\s?\d[\d\s.,']*\d|(?<![\w.,])\d[\d\s.,']*\d\s?{CURRENCY}(?![\w])"
TEXT_INVOICE = (
    r"(?iU)\b(?:invoice|inv|proforma|pro-forma|számla|szamla|fatura|factura|order|PO)\b\.?\s*(?:no|nr|number|sz|num|#)?\.?\s*[:#]?\s*"
    r"(?=[A-Z0-9/\-]*\d)[A-Z0-9][A-Z0-9/\-]{3,}"
)
TEXT_NAME_LABEL = (
    r"(?iU)\b(?:customer|client|contact|buyer|owner|name|full\s+name|first\s+name|last\s+name|surname|"
    r"müşteri|musteri|ad(?:ı)?|soyad(?:ı)?|isim|név|ugyfel|ügyfél|nome|cognome|cliente|"
    r"نام|نام\s+خانوادگی|مشتری)\b\s*(?:[:=]|\s-\s)\s*"
    r"(?=[^\n]{2,80}$)(?:[A-ZÀ-ÖØ-öø-ÿĀ-žĞİŞÇÖÜ][\wÀ-ÖØ-öø-ÿĀ-žĞİŞÇÖÜ'’.-]+(?:\s+|$)){1,4}"
)


_DIGITS = [(chr(i), str(unicodedata.decimal(chr(i)))) for i in range(128, 0x10000) if unicodedata.category(chr(i)) == "Nd"]


def digits_only(c: Column) -> Column:
    """The decimal digits of any script, as ASCII digits."""
    return F.translate(F.regexp_replace(c, r"(?U)\D", ""), "".join(a for a, _ in _DIGITS), "".join(b for _, b in _DIGITS))


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1).try_cast("int")


def iban_ok(c: Column) -> Column:
    """Length and mod-97 test of a bank account number."""
    s = F.upper(F.regexp_replace(c, " ", ""))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda x: x != "")

    def fold(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.coalesce(F.length(s).between(15, 34) & (F.aggregate(chars, F.lit(0), fold) == 1), F.lit(False))


def tckn_ok(d: Column) -> Column:
    """Eleven digits with the two check digits of a Turkish ID number."""
    odd = sum((_digit(d, i) for i in range(0, 9, 2)), F.lit(0))
    even = sum((_digit(d, i) for i in range(1, 8, 2)), F.lit(0))
    first_ten = sum((_digit(d, i) for i in range(10)), F.lit(0))
    ok = (F.pmod(7 * odd - even, F.lit(10)) == _digit(d, 9)) & (first_ten % 10 == _digit(d, 10))
    return F.when(d.rlike(r"^[1-9]\d{10}$"), ok).otherwise(False)


def hu_tax_ok(d: Column) -> Column:
    """Ten digits beginning with 8 and the check digit of a Hungarian tax ID."""
    total = sum((_digit(d, i) * (i + 1) for i in range(9)), F.lit(0))
    return F.when(d.rlike(r"^8\d{9}$"), total % 11 == _digit(d, 9)).otherwise(False)


def luhn_ok(d: Column) -> Column:
    """13 to 19 digits that pass the Luhn test."""
    back = F.reverse(d)

    def value(i: Column) -> Column:
        x = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 1, twice).otherwise(x)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), value), F.lit(0), lambda a, x: a + x)
    return F.when(d.rlike(r"^\d{13,19}$"), total % 10 == 0).otherwise(False)
