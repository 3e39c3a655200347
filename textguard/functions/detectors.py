"""Detectors of structured categories, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.spans import cut, digits, span_extract


def email(text: Column) -> Column:
    return span_extract(text, P.EMAIL, "EMAIL", "regex.email", 1.0, when=F.contains(text, F.lit("@")))


def _edges(value: Column) -> tuple[Column, Column]:
    """Numbers of spaces and hyphens at the two ends."""
    n = F.length(value)
    return n - F.length(F.regexp_replace(value, "^[ -]+", "")), n - F.length(F.regexp_replace(value, "[ -]+$", ""))


def plausible_phone(value: Column, start: Column, end: Column, text: Column) -> Column:
    """Digit count, no money or unit around, and a shape that phones have."""
    number, n = digits(value), F.length(digits(value))
    before = F.lower(F.substring(text, F.greatest(start - 1, F.lit(1)), F.least(start, F.lit(2))))
    after = F.lower(F.substring(text, end + 1, F.lit(12)))
    money = F.contains(before, F.lit("₹")) | F.contains(before, F.lit("rs"))
    mobile = (n == 10) & number.rlike("^[6-9]")
    shaped = mobile | (number.startswith("91") & n.isin(11, 12)) | F.trim(value).startswith("+") | (value.rlike("[- ]") & n.isin(10, 11))
    return n.between(10, 13) & ~money & ~after.rlike(P.PHONE_UNITS) & shaped


def phone(text: Column) -> Column:
    return span_extract(text, P.PHONE, "PHONE", "regex.phone", 1.0, when=text.rlike(r"(?U)\d{3}"), keep=plausible_phone, trim=lambda v, s, e, t: cut(v, s, *_edges(v)))


def ssn(text: Column) -> Column:
    return span_extract(text, P.SSN, "SSN", "regex.ssn", 1.0, when=text.rlike(r"(?U)\d-\d"))


def _is_card(value: Column, start: Column, end: Column, text: Column) -> Column:
    number = digits(value)
    return F.length(number).between(13, 16) & F.coalesce(F.call_function("luhn_check", number), F.lit(False))


def credit_card(text: Column) -> Column:
    return span_extract(text, P.CREDIT_CARD, "CREDIT_CARD", "regex.credit_card", 1.0, when=text.rlike(r"(?U)\d[ -]?\d[ -]?\d"), keep=_is_card, trim=lambda v, s, e, t: cut(v, s, F.lit(0), _edges(v)[1]))


def ip(text: Column) -> Column:
    octets = lambda v: F.forall(F.split(v, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(256)) <= 255)
    return span_extract(text, P.IP, "IP", "regex.ip", 1.0, when=text.rlike(r"(?U)\d\.\d"), keep=lambda v, s, e, t: octets(v))


def dob(text: Column) -> Column:
    """Dates that a birth trigger precedes within 40 code points."""
    window = lambda s, t: F.substring(t, F.greatest(s - 39, F.lit(1)), F.least(s, F.lit(40)))
    return span_extract(text, P.DATE, "DOB", "rule.dob", 1.0, when=text.rlike(P.DOB_TRIGGER) & text.rlike(r"(?U)\d"), keep=lambda v, s, e, t: window(s, t).rlike(P.DOB_TRIGGER))


#: In the order in which they run; exact ties between detectors keep it.
STRUCTURED = {"EMAIL": email, "PHONE": phone, "SSN": ssn, "CREDIT_CARD": credit_card, "IP": ip, "DOB": dob}
