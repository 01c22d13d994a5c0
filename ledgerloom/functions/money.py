"""Amounts, VAT and the arithmetic that ties them together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats in which receipts print amounts, and lines whose numbers are no amounts.
AMOUNT = r"(?<![\p{L}\d%])(\d{1,5})\s?[.,]\s?(\d{2})(?![\p{L}\d])(?!\s*%)"
NOT_MONEY = (
    r"(?i)RC\s*:|AUTOR|NR\.?\s*CARD|\bTRX\b|CNP|C\.?I\.?F|CUI|COD\s+FISCAL|TELEFON|TEL\.?\s*[:=]|MOBIL|FAX|IBAN"
    r"|CONT(?:UL)?\s+(?:BANCAR|CURENT|RO)|BANCA|CAPITAL\s+SOCIAL|NR\.?\s*(?:ORD\.?)?\s*REG\.?\s*COM|POS\b|EJTRZ|ID\s*UNIC|\bSB\s*:|AUTORIZARE|NR\.?\s*AUTO"
)
RATE_VALUES = (5.0, 9.0, 11.0, 19.0, 21.0)
#: Rates in force, the first the usual one: (first day, last day, rates).
VAT_PERIODS = (("0001-01-01", "2025-07-31", (19.0, 9.0, 5.0)), ("2025-08-01", "2026-07-31", (21.0, 11.0, 9.0)), ("2026-08-01", "9999-12-31", (21.0, 11.0)))
ANY_DATE_RATES = (21.0, 11.0, 19.0, 9.0, 5.0)


def ron2(c: Column) -> Column:
    """Two decimals, half away from zero on the scaled double."""
    return F.round(c * 100) / 100


def amounts_anyhow(line: Column) -> Column:
    """All amounts printed on a line, in order."""
    whole = F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(1))
    part = F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(2))
    return F.zip_with(whole, part, lambda a, b: F.concat(a, F.lit("."), b).cast("double"))


def amounts(line: Column) -> Column:
    """The amounts of a line that is about money; none of a line of ids, cards or phones."""
    return F.when(F.rlike(line, F.lit(NOT_MONEY)), F.array().cast("array<double>")).otherwise(amounts_anyhow(line))


def is_rate(v: Column) -> Column:
    return v.isin(*RATE_VALUES)


def plausible_total(v: Column) -> Column:
    return v.between(0.50, 99999) & ~is_rate(v)


def parse_grouped(text: Column) -> Column:
    """An amount with thousands separators: the last separator with one or two digits after it is the decimal one."""
    t = F.regexp_replace(text, r"[^0-9.,]", "")
    fraction = F.regexp_extract(t, r"[.,](\d{1,2})$", 1)
    digits = F.regexp_replace(t, r"[.,]", "")
    whole = F.regexp_replace(F.regexp_replace(t, r"[.,]\d{1,2}$", ""), r"[.,]", "")
    return F.when(fraction != "", F.concat(whole, F.lit("."), fraction)).otherwise(digits).try_cast("double")


def rates_at(date: Column) -> Column:
    """The legal VAT rates at a date, the usual one first; all known ones for null."""
    out = F.when(date.isNull(), F.array(*map(F.lit, ANY_DATE_RATES)))
    for first, last, rates in VAT_PERIODS:
        out = out.when(date.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.array(*map(F.lit, rates)))
    return out


def rate_warning(rate: Column, date: Column) -> Column:
    return F.when(date.isNotNull() & ~F.array_contains(rates_at(date), rate), F.concat(F.lit("rate "), rate.cast("int"), F.lit("% not in force at the date")))


def vat_in(total: Column, rate: Column) -> Column:
    return total * rate / (100 + rate)


def consistent(total: Column, vat: Column, rate: Column) -> Column:
    return F.abs(vat - vat_in(total, rate)) <= 0.06


def reconcile(total: Column, vat: Column, rate: Column, printed: Column) -> Column:
    """Struct (total, vat, verified, source) of the five branches: both agree, the VAT implies a printed total, only the total counts, or neither is there."""
    implied = ron2(vat * (100 + rate) / rate)
    match = F.get(F.filter(F.coalesce(printed, F.array().cast("array<double>")), lambda p: F.abs(p - implied) <= 0.06), F.lit(0))
    found = lambda t, v, ok, source: F.struct(t.cast("double").alias("total"), v.cast("double").alias("vat"), F.lit(ok).alias("verified"), source.alias("source"))
    source = F.when(total.isNull() | (F.abs(total - match) > 0.06), "derivat_din_tva").otherwise("ocr")
    return (
        F.when(total.isNotNull() & vat.isNotNull() & consistent(total, vat, rate), found(total, vat, True, F.lit("ocr")))
        .when(vat.isNotNull() & match.isNotNull(), found(match, vat, True, source))
        .when(total.isNotNull(), found(total, ron2(vat_in(total, rate)), False, F.lit("ocr")))
        .otherwise(found(total, vat, False, F.lit("lipsa")))
    )


def reconcile_warning(total: Column, vat: Column, rate: Column, printed: Column) -> Column:
    """What `reconcile` changed, in words; null if nothing, or if a total came from the VAT alone."""
    implied = ron2(vat * (100 + rate) / rate)
    match = F.get(F.filter(F.coalesce(printed, F.array().cast("array<double>")), lambda p: F.abs(p - implied) <= 0.06), F.lit(0))
    return (
        F.when(total.isNull() | consistent(total, vat, rate), F.lit(None).cast("string"))
        .when(match.isNotNull() & (F.abs(total - match) > 0.06), "total corrected by the VAT: a printed amount")
        .when(vat.isNotNull() & match.isNull(), "VAT recomputed from the total: the read one disagrees")
        .when(vat.isNull(), "VAT computed from the total: none was read")
    )


def ledger_entries(total: Column, vat: Column, account: Column, cash: Column) -> Column:
    """Entries (debit, credit, amount): base, deductible VAT if any, payment; none without a positive total."""
    v = ron2(F.least(F.greatest(F.coalesce(vat, F.lit(0.0)), F.lit(0.0)), total))
    row = lambda d, c, a: F.struct(d.alias("debit"), c.alias("credit"), a.alias("amount"))
    pay = F.when(F.coalesce(cash, F.lit(False)), "5311").otherwise("5125")
    all_ = F.array(row(account, F.lit("401"), ron2(total - v)), row(F.lit("4426"), F.lit("401"), v), row(F.lit("401"), pay, ron2(total)))
    kept = F.filter(all_, lambda e: (e["debit"] != "4426") | (e["amount"] > 0))
    return F.when(total > 0, kept).otherwise(F.array().cast("array<struct<debit:string,credit:string,amount:double>>"))


def legacy_check(total: Column, base: Column, vat: Column) -> Column:
    """Struct (base, error): a base that misses total minus VAT by more than 0.02 is recomputed, or flagged if it misses by half of the total or more."""
    off = F.abs(total - (base + vat))
    bad = off >= 0.5 * total
    return F.struct(F.when((off > 0.02) & ~bad, ron2(total - vat)).otherwise(base).alias("base"), F.coalesce((off > 0.02) & bad, F.lit(False)).alias("error"))


def cap_warnings(total: Column, cash: Column, euro: Column, has_buyer: Column) -> Column:
    """Warnings of a receipt: cash over 5,000, and a simplified invoice over 100 euros without a buyer's id; euro is 5 if unknown."""
    rate = F.coalesce(euro, F.lit(5.0))
    return F.array_compact(F.array(F.when(cash & (total > 5000), "cash over 5000"), F.when(~has_buyer & (total > 100 * rate), "over 100 EUR without buyer")))
