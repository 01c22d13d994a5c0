"""Fields of receipts from their lines: one shuffle by document, then windows and aggregates on that partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ids, money, text

# What lines say about totals, rates, numbers and payment.
TOTAL = r"(?i)(?<!SUB)\bTOTAL\b(?!\s*TVA)"
TOTAL_INLINE = TOTAL + r"\s*[:=]?\s*(\d{1,5})\s?[.,]\s?(\d{2})(?!\s*%)"
NO_TOTAL = r"(?i)SUBTOTAL|TOTAL\s*TVA|TVA\s*TOTAL|IOTAL\s*TVA|SUMA\s*TVA|COTA\s*TVA|REST|RULAJ|TOTALTVA"
NO_LOOKAHEAD = r"(?i)%|COTA\s*TVA"
NO_FREQUENCY = r"CUI|CIF|FISCAL|COD\s*FISC|CLIENT|CNP|RC\s*:|AUTOR|TRX|POS\b|EJTRZ|TELEFON|IBAN"
PAID = r"(?i)\b(?:CARD|NUMERAR|CASH|SUMA|PLATA|ACHITAT)\b"
VAT_AMOUNT = r"(?i)TOTAL\s*TVA|TVA\s*TOTAL|IOTAL\s*TVA|TOTALTVA|SUMA\s*TVA"
RATE = r"(?i)(?:COTA\s*)?(?:TOTAL\s*)?TVA\s*[A-E]?\s*[=:]?\s*(\d{1,2})(?:[.,]\d{1,2})?\s*[%X×x]"
ITEM_END = r"(?i)(?:^|\s|-)\b[A-E]\b(?:\s+[A-E]\b)*\s*$"
NO_ITEM = r"(?i)\bTOTAL\b|SUBTOTAL|\bTVA\b|CARD|CASH|NUMERAR|REST|RULAJ|COTA"
DISCOUNT = r"DISCOUNT|REDUCERE|RABAT|\d[.,]\d{2}\s*-\s*[A-E]|\d[.,]\d{2}-[A-E]"
BUYER = r"CLIENT|CUMPARATOR|BENEF|CNP"
ID_CONTEXT = (
    r"(?:COD\s*FISC[A-Z]*|COD\s*IDENT[A-Z]{0,8}\s*FISC[A-Z]*|C\.?\s*[I1]\.?\s*F|\bC\.?\s*F\b|\bCUI\b)\s*[.:]?\s*(?:R(?:[O0Q]|[^A-Z0-9@]{0,3}))?\s*[.:]?\s*([A-Z0-9@]{2,12})"
)
PREFIXED_ID = r"\bR[O0]\s?([0-9OQDILSZB@]{2,12})\b"
NUMBERS = (r"(?i)NUMAR\s*BON\s*FISCAL\s*[:#]?\s*(\d{1,8})", r"(?i)BON\s*FISCAL\s*[:#]?\s*(\d{2,8})", r"(?i)\bBF\s*[.:]?\s*0*(\d{1,8})")


def _by():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _is(pattern: str, c: Column | None = None) -> Column:
    return F.rlike(F.col("text") if c is None else c, F.lit(pattern))


def _first(value: Column) -> Column:
    """The value of the first line that has one."""
    return F.min(F.when(value.isNotNull(), F.struct("line_no", value.alias("v"))))["v"]


def _found(pattern: str, group: int = 1, c: Column | None = None) -> Column:
    return F.nullif(F.regexp_extract(F.col("text") if c is None else c, pattern, group), F.lit(""))


def id_reads(line: Column, pattern: str) -> Column:
    """Normal forms of what either of two groups of the pattern reads on a line, in their order."""
    one, two = (F.regexp_extract_all(line, F.lit(pattern), F.lit(i)) for i in (1, 2))
    found = F.transform(F.zip_with(one, two, lambda a, b: F.concat(a, b)), ids.normal_id)
    return F.when(_is(pattern, line), found).otherwise(F.array().cast("array<string>"))  # most lines have none: one look tells


def labelled_ids(upper: Column) -> Column:
    """Ids of two to ten digits behind a label or a country prefix on a line in capitals, in their order; none on a buyer's line."""
    found = F.filter(id_reads(upper, f"{ID_CONTEXT}|{PREFIXED_ID}"), lambda d: F.char_length(d).between(2, 10))
    return F.when(~_is(BUYER, upper), found).otherwise(F.array().cast("array<string>"))


def repeatable(amounts: Column, upper: Column) -> Column:
    """Amounts of a line that tell a total by standing twice: of 10 or more and no rate; what a line says was paid, whatever it is."""
    paid = _is(PAID) & ~_is(NO_TOTAL)
    return F.when(~_is(NO_FREQUENCY, upper), F.filter(amounts, lambda v: ((v >= 10) & money.plausible_total(v)) | (paid & v.between(0.50, 99999))))


def paid_rate(beside: Column, all_: Column) -> Column:
    """An amount beside its label that equals a rate, if it was paid, too."""
    return F.when(F.array_contains(all_, beside), beside)


def largest_twice(all_: Column) -> Column:
    """The largest amount that stands twice, to the cent; sorted once, then held against its neighbours."""
    cents = F.sort_array(F.transform(all_, lambda v: F.round(v * 100).cast("long")))
    pairs = lambda c: F.filter(F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.when(a == b, a)), lambda v: v.isNotNull())
    return F.array_max(F.flatten(F.transform(F.array(cents), pairs))) / 100


def receipt_totals(lines: DataFrame) -> DataFrame:
    """doc_id and total: printed behind TOTAL (a sum that equals a rate only if it was paid, too), else on or within six lines after it, else the largest amount that stands twice, of 10 or more or paid."""
    rows = lines.select("doc_id", "line_no", "text").withColumn("any", money.amounts(F.col("text"))).withColumn("amounts", F.filter("any", money.plausible_total))
    rejected = _is(NO_TOTAL)
    inline = F.concat(_found(TOTAL_INLINE), F.lit("."), _found(TOTAL_INLINE, 2)).cast("double")
    rows = rows.withColumn("beside", F.when(~rejected, inline)).withColumn("inline", F.when(money.plausible_total(F.col("beside")), F.col("beside")))
    large = F.filter("amounts", lambda v: v >= 30)
    offer = F.when(~rejected & ~_is(NO_LOOKAHEAD) & (F.size("amounts") > 0), F.coalesce(F.array_max(large), F.array_max("amounts")))
    rows = rows.withColumn("offer", offer).withColumn("next", F.collect_list("offer").over(_by().rowsBetween(1, 6)))
    labelled = F.when(_is(TOTAL) & ~rejected, F.coalesce(F.array_max("amounts"), F.get("next", F.lit(0))))
    often = repeatable(F.col("any"), F.upper("text"))
    rate = F.when(money.is_rate(F.col("beside")), F.col("beside"))
    out = rows.groupBy("doc_id").agg(_first(F.col("inline")).alias("a"), _first(rate).alias("r"), _first(labelled).alias("b"), F.flatten(F.collect_list(often)).alias("all"))
    return out.select("doc_id", F.coalesce("a", paid_rate(F.col("r"), F.col("all")), "b", largest_twice(F.col("all"))).alias("total"))


def item_totals(lines: DataFrame) -> DataFrame:
    """doc_id and item_total: signed amounts of item lines, with equal neighbours read once; null if not positive."""
    value = F.get(F.reverse(money.amounts(F.col("text"))), F.lit(0))
    rows = lines.select("doc_id", "line_no", "text").where(_is(ITEM_END) & ~_is(NO_ITEM)).withColumn("value", value).where(F.col("value").isNotNull() & ~money.is_rate(F.col("value")))
    rows = rows.withColumn("value", F.when(_is(DISCOUNT, F.upper("text")), -F.col("value")).otherwise(F.col("value")))
    rows = rows.withColumn("before", F.lag("value").over(_by())).where(F.col("before").isNull() | (F.abs(F.col("before") - F.col("value")) >= 0.001))
    total = money.ron2(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"))
    return rows.groupBy("doc_id").agg(F.when(total > 0, total).alias("item_total"))


def vat_lines(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, rate, amount of lines that state VAT: a rate with the amount beside it."""
    rate = _found(RATE).cast("double")
    amount = F.get(F.reverse(F.filter(money.amounts_anyhow(F.col("text")), lambda v: ~money.is_rate(v))), F.lit(0))
    return lines.where(_is(VAT_AMOUNT)).select("doc_id", "line_no", rate.alias("rate"), amount.alias("amount")).where("rate > 0 AND rate < 100 AND amount IS NOT NULL")


def receipt_fields(lines: DataFrame) -> DataFrame:
    """doc_id, header, read_id, date, number, payment, account and text of each document."""
    upper = F.upper("text")
    first_id = _first(F.get(labelled_ids(upper), F.lit(0)))
    date = text.receipt_date(F.col("text"))
    dated = F.min(F.when(date.isNotNull(), F.struct((~F.contains(upper, F.lit("DATA"))).alias("k"), "line_no", date.alias("v"))))["v"]
    numbers = [_first(_found(p)) for p in NUMBERS]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    out = lines.groupBy("doc_id").agg(_first(F.col("text")).alias("header"), first_id.alias("read_id"), dated.alias("date"), F.coalesce(*numbers).alias("number"), whole.alias("whole"))
    cash = F.when(F.rlike(F.upper("whole"), F.lit("NUMERAR|CASH")), "numerar").when(F.contains(F.upper("whole"), F.lit("CARD")), "card")
    return out.select("doc_id", "header", "read_id", "date", "number", cash.alias("payment"), text.first_rule(F.col("whole")).alias("account"))


def confidence(id_ok: Column, verified: Column, date: Column, total: Column, number: Column, warnings: Column) -> Column:
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    c = 0.35 + yes(id_ok, 0.15) + yes(verified, 0.20) + yes(date.isNotNull(), 0.10) + yes(total.isNotNull(), 0.10) + yes(number.isNotNull(), 0.05) - 0.04 * warnings
    return money.ron2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def completeness(total: Column, has_vat: Column, cui: Column, date: Column, name: Column, verified: Column, id_ok: Column) -> Column:
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.when(total.isNull(), -50.0).otherwise(100.0) + yes(has_vat, 40.0) + yes(cui.isNotNull(), 30.0) + yes(date.isNotNull(), 15.0) + yes(F.char_length(name) >= 6, 10.0) + yes(verified, 20.0) + yes(id_ok, 10.0)


# Fuel on receipts, shops known by name, forms of companies, and lines that are no name.
FUEL = r"(?i)MOTORINA[A-Z0-9 ]*|BENZINA[A-Z0-9 ]*|\bGPL\b|DIESEL|ADBLUE"
FUEL_LINE = r"\bL(?:ITRU)?\b|MOTORINA|BENZINA|\bGPL\b|DIESEL|ADBLUE"
FUEL_PAIR = r"(\d{1,3}[.,]\d{1,3})\s*(?:L(?:ITRU)?\s*)?[Xx×]\s*(\d{1,3}[.,]\d{1,3})\s*L?(?:ITRU)?"
BRANDS = r"(?i)\b(MAGISTRAL(?:\s+GAZ)?|MOL(?:\s+ROMANIA)?|DOUGLAS|TURIST(?:\s+SERVICE)?|ROG(?:\s+GAZ)?|OMV|PETROM|LIDL|KAUFLAND|CARREFOUR|MEGA\s*IMAGE)\b"
LEGAL_FORM = r"(?i)\b(S\.?\s?R\.?\s?L\.?|S\.?A\.?|P\.?F\.?A\.?|S\.?C\.?S\.?|I\.?I\.?)(\b|$)"
NO_NAME = r"(?i)BON\s*FISCAL|TOTAL|TVA|CARD|CASH|NUMERAR|SUBTOTAL|DATA|ORA|CASIER|OPERATOR|POS\b|EJTRZ|SKID|GPL\b|MOTORINA|BENZINA"
TIME = r"\b(\d{1,2})[:.\-](\d{2})(?:[:.\-](\d{2}))?\b"


def fuel_columns() -> dict[str, Column]:
    """fuel_name, fuel_pair (liters, price) and fuel_line of a line: of two numbers the one that can be a price per litre only is the price."""
    number = lambda i: F.replace(F.nullif(F.regexp_extract(F.upper("text"), FUEL_PAIR, i), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    a, b = number(1), number(2)
    is_price, is_litres = (lambda c: c.between(2, 25)), (lambda c: c.between(0.5, 250))
    pair = lambda l, p: F.struct(l.alias("liters"), p.alias("price"))
    read = (
        F.when(is_price(a) & is_litres(b) & ~is_price(b), pair(b, a))
        .when(is_price(b) & is_litres(a) & ~is_price(a), pair(a, b))
        .when(is_price(a) & is_litres(b), pair(b, a))
        .when(is_price(b) & is_litres(a), pair(a, b))
    )
    name = F.when(_is(FUEL), F.trim(F.regexp_extract("text", FUEL, 0)))
    # most lines have no pair: one look tells
    return {"fuel_name": name, "fuel_pair": F.when(_is(FUEL_PAIR, F.upper("text")) & (a * b <= 50_000), read), "fuel_line": _is(FUEL_LINE, F.upper("text"))}


def fuel(lines: DataFrame) -> DataFrame:
    """doc_id, liters, price, product of documents with a fuel line: a pair counts on a line of fuel, or anywhere once a product is named."""
    rows = lines.select("doc_id", "line_no", "text").withColumns(fuel_columns())
    out = rows.groupBy("doc_id").agg(_first(F.col("fuel_pair")).alias("any"), _first(F.when(F.col("fuel_line"), F.col("fuel_pair"))).alias("on_line"), _first(F.col("fuel_name")).alias("product"))
    p = F.when(F.col("product").isNotNull(), F.col("any")).otherwise(F.col("on_line"))
    return out.select("doc_id", p["liters"].alias("liters"), p["price"].alias("price"), "product").where("liters IS NOT NULL OR product IS NOT NULL")


def merchants(lines: DataFrame) -> DataFrame:
    """doc_id, merchant: a known shop in the first 12 lines, else a line with a company's form in the first 10, else the first line of 6 that can be a name."""
    tokens = F.filter(F.split(F.trim("text"), " "), lambda t: t != "")
    rows = lines.withColumn("nth", F.row_number().over(_by())).where("nth <= 12").withColumn("tokens", tokens)
    once = F.filter("tokens", lambda t, i: (i == 0) | (F.upper(F.get(F.col("tokens"), i - 1)) != F.upper(t)))
    rows = rows.withColumn("name", F.array_join(once, " "))
    letters, digits = F.regexp_count("name", F.lit(r"\p{L}")), F.regexp_count("name", F.lit(r"\p{N}"))
    legal = _is(LEGAL_FORM, F.col("name"))
    garbage = (letters < 3) | (digits > letters) | (_is(r"\d{1,5}[.,]\d{2}", F.col("name")) & (digits >= 4)) | (_is(NO_NAME, F.col("name")) & ~legal)
    brand = F.nullif(F.regexp_extract("name", BRANDS, 0), F.lit(""))
    first = lambda c, v: F.min(F.when(c, F.struct("nth", v.alias("v"))))["v"]
    known = first(brand.isNotNull(), F.when(legal & ~garbage, F.col("name")).otherwise(brand))
    company = first((F.col("nth") <= 10) & (F.char_length("name") >= 6) & ~garbage & legal, F.col("name"))
    any_ = first((F.col("nth") <= 6) & (F.char_length("name") >= 4) & ~garbage, F.col("name"))
    return rows.groupBy("doc_id").agg(F.coalesce(known, company, any_).alias("merchant"))


def time_of_day(line: Column) -> Column:
    """H:mm of a line that names an hour; null where the hour is past 23."""
    hour = F.nullif(F.regexp_extract(line, TIME, 1), F.lit(""))
    return F.when(F.contains(F.upper(line), F.lit("ORA")) & (hour.cast("int") < 24), F.concat(hour, F.lit(":"), F.regexp_extract(line, TIME, 2)))


def document_quality(text_: Column, word_count: Column, letters: Column) -> Column:
    """A score that prefers whole documents to fragments: length, and marks of title, id, total, date and money."""
    t = F.upper(text_)
    is_ = lambda p, w: F.when(F.rlike(t, F.lit(p)), w).otherwise(0.0)
    money_count = F.regexp_count(t, F.lit(r"\b\d{1,5}[.,]\d{2}\b"))
    bare = ~F.rlike(t, F.lit(r"\bS\.?R\.?L\.?|\bS\.?A\.?|PFA")) & ~F.rlike(t, F.lit(r"COD\s*FISC|C\.?I\.?F|\bCUI\b"))
    return (
        letters
        + is_(r"BON\s+FISCAL|CH[I1L][T7L][A-ZĂÂÎȘȚ]{3,}", 350.0)
        + is_(r"CUI|C\.?I\.?F|COD\s+FISCAL", 180.0)
        + is_(r"\bTOTAL\b|SUM[AĂK](?:I)?\s+DE", 260.0)
        + is_(r"\b\d{1,2}[./-]\d{1,2}[./-]20\d{2}\b", 120.0)
        + 40.0 * F.least(money_count, F.lit(12))
        + is_(r"(?<!SUB)\bTOTAL\b(?!\s*TVA).{0,40}\d{1,5}[.,]\d{2}", 200.0)
        - F.when((money_count >= 2) & bare & (word_count < 20), 150.0).otherwise(0.0)
    )
