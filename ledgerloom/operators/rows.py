"""Rows for ledgers and exports: VAT of several rates, one row per rate, receipts and slips as one kind of row, accounts by a user's keywords, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators.receipt import RATE

#: Difference up to which several rates' bases and VAT make up a total.
MULTI_RATE_TOLERANCE = 0.10
#: Columns of a row that receipts and slips share.
ROW = ("kind", "number", "date", "company", "total", "base", "vat", "rates")


def vat_pairs(lines: DataFrame) -> DataFrame:
    """doc_id, rate, amount, nth: each rate a document states with the VAT beside it, in order of first mention.

    A line with as many amounts as rates pairs them in order; one with a single rate takes the last amount; others pair none.
    Amounts that equal a rate are none. Of a rate that stands twice the first line counts. One shuffle, by document and rate.
    """
    rates = F.transform(F.regexp_extract_all("text", F.lit(RATE), F.lit(1)), lambda r: r.cast("double"))
    amounts = F.filter(money.amounts_anyhow(F.col("text")), lambda v: ~money.is_rate(v))
    said = lines.select("doc_id", "line_no", rates.alias("r"), amounts.alias("a")).where((F.size("r") > 0) & (F.size("a") > 0))
    pair = F.when(F.size("r") == F.size("a"), F.arrays_zip("r", "a")).when(F.size("r") == 1, F.array(F.struct(F.get("r", F.lit(0)).alias("r"), F.element_at("a", -1).alias("a"))))
    each = said.select("doc_id", "line_no", F.posexplode(pair).alias("pos", "p"))
    first = F.min(F.struct("line_no", "pos", F.col("p.a").alias("amount"))).alias("f")
    found = each.groupBy("doc_id", F.col("p.r").alias("rate")).agg(first)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.line_no", "f.pos"))
    return found.select("doc_id", "rate", "f.amount", nth.alias("nth"))


def multi_rate(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Per document with two rates or more: rates, n_rates, vat_total, base_total, total, verified and warning.

    pairs: as of vat_pairs; totals: doc_id, total. A base is what the VAT amounts to at its rate. verified: bases and VAT make
    up the total; null where no total was read.
    """
    base = money.ron2(F.col("amount") * 100 / F.col("rate"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("rate").cast("int").cast("string").alias("r")))), lambda x: x["r"]), ", ")
    cents = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    found = pairs.groupBy("doc_id").agg(listed.alias("rates"), F.count(F.lit(1)).alias("n_rates"), cents(F.col("amount")).alias("vat_total"), cents(base).alias("base_total")).where("n_rates > 1")
    out = found.join(totals.select("doc_id", "total"), "doc_id", "left")
    out = out.withColumn("verified", money.ron2(F.abs(F.col("total") - money.ron2(F.col("base_total") + F.col("vat_total")))) <= MULTI_RATE_TOLERANCE)
    return out.withColumn("warning", F.when(~F.col("verified"), F.lit("total differs from bases and VAT of several rates")))


def by_rate(items: DataFrame) -> DataFrame:
    """doc_id, rate, base, vat of items (doc_id, rate, base in whole units), VAT rounded down."""
    return items.groupBy("doc_id", "rate").agg(F.sum("base").alias("base")).withColumn("vat", F.expr("base * rate div 100"))


def split_by_rate(docs: DataFrame) -> DataFrame:
    """docs with one row per element of `breakdown` (rate, base, vat), whose total is base and VAT where there are several rates;
    documents without a breakdown keep their one row, with null rate, base and vat."""
    own = [c for c in docs.columns if c not in ("breakdown", "total", "rate", "base", "vat")]
    rows = docs.select(*own, "total", F.size("breakdown").alias("_n"), F.explode_outer("breakdown").alias("b"))
    made = money.ron2(F.col("b.base") + F.col("b.vat"))
    total = F.when(F.col("_n") > 1, made).when(F.col("_n") == 1, F.coalesce("total", made)).otherwise(F.col("total"))
    return rows.select(*own, total.alias("total"), "b.rate", "b.base", "b.vat")


# Accounts of slips whose kind is forced.
FORCED_ACCOUNTS = {"Chitanță de mână": "5311", "Chitanță POS": "5125"}


def forced_kinds(docs: DataFrame, forced: str = "forced") -> DataFrame:
    """docs (kind, kind_unsure, total, base, vat, rates, vat_unsure, breakdown, account) as the kind in column `forced` makes them.

    A forced kind stands without question; a forced slip has no VAT: its base is its total, its rates are "-", its breakdown
    is null, and its account is the kind's. Rows whose `forced` is null stay as they are, rows that repeat stay.
    """
    kind, slip = F.col(forced), F.coalesce(F.col(forced).isin(*FORCED_ACCOUNTS), F.lit(False))
    account = F.col("account")
    for name, value in FORCED_ACCOUNTS.items():
        account = F.when(kind == name, F.lit(value)).otherwise(account)
    put = lambda c, v: F.when(slip, v).otherwise(F.col(c))
    return docs.withColumns(
        {
            "kind": F.coalesce(kind, "kind"),
            "kind_unsure": F.col("kind_unsure") & kind.isNull(),
            "vat": put("vat", F.lit(0.0)),
            "rates": put("rates", F.lit("-")),
            "base": put("base", F.col("total")),
            "vat_unsure": put("vat_unsure", F.lit(False)),
            "breakdown": put("breakdown", F.lit(None)),
            "account": account,
        }
    )


def _as_rows(df: DataFrame, kind: str) -> DataFrame:
    has = set(df.columns)
    return df.select("doc_id", F.lit(kind).alias("kind"), *(F.col(c) if c in has else F.lit(None).alias(c) for c in ROW[1:]))


def receipt_rows(receipts: DataFrame) -> DataFrame:
    """Receipts (doc_id and any of ROW's columns) as rows; what they lack is null."""
    return _as_rows(receipts, "Bon Fiscal")


def slip_rows(slips: DataFrame) -> DataFrame:
    """Slips as rows: no VAT is theirs, so base and VAT are null whatever the input holds."""
    return _as_rows(slips.drop("base", "vat", "rates"), "Chitanță")


def reindexed(rows: DataFrame, by: str = "upload") -> DataFrame:
    """rows with `index`, from 1 in each upload: receipts first, then slips, each in document order."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy("kind", "doc_id")))


def keyword_accounts(df: DataFrame, rules: DataFrame, key: str, text: str, usual: str) -> DataFrame:
    """key and account: of the rules (ordinal, keyword, account) whose keyword the text holds the first, else the usual account.

    A user's rules are a handful and are broadcast."""
    hit = df.select(key, F.upper(text).alias("_t")).join(F.broadcast(rules), F.contains(F.col("_t"), F.upper("keyword")), "left")
    return hit.groupBy(key).agg(F.coalesce(F.min_by("account", "ordinal"), F.lit(usual)).alias("account"))


def export_rows(df: DataFrame, headers: list[str], fields: dict[str, Column]) -> DataFrame:
    """df under a template's headers: each header shows its field (by lower-cased name), one without a field is blank; null is blank."""
    return df.select(*(F.coalesce(fields[h.lower()], F.lit("")).alias(h) if h.lower() in fields else F.lit("").alias(h) for h in headers))
