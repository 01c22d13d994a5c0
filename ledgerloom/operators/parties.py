"""Parties of a receipt: the seller's id with a label or without one, the buyer's id and name, and what the registry knows of the buyer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ids
from ledgerloom.operators.receipt import _first, _is, id_reads, labelled_ids

# Numbers without a label, lines whose numbers are no ids, and words near a seller's id.
BARE = r"\bR[O0]?\s*([0-9OQDILSZB]{6,10})\b|\b([0-9]{6,10})\b"
NO_BARE = r"CLIENT|CNP|BENEF|CARD|TRX|POS|EJTRZ|AUTOR|TELEFON|IBAN|DATA|ORA"
NEAR_ID = r"FISC|CUI|CIF|COD|SRL|S\.A|GAZ|PETROL|MAGISTRAL|MOL|DOUGLAS"
# What stands before a buyer's id and name.
BUYER_ID = r"(?i)(?:CIF\s*/?\s*CNP\s*CLIENT|C\.?I\.?F\.?\s*CLIENT|CUI\s*CLIENT|COD\s*CLIENT)\s*[.:]?\s*(?:R[O0])?\s*([0-9OQDILSZB]{4,10})"
BUYER_NAME = r"(?i)\bCLIENT\s*[.:]\s*([A-Z][A-Z0-9 .\-]{3,40})"


def bare_ids(line: Column) -> Column:
    """Numbers of six to ten digits without a label that can be ids: their control digit fits or the line names a seller; dates are none."""
    upper = F.upper(line)
    near = _is(NEAR_ID, upper)
    date = lambda d: F.startswith(d, F.lit("20")) & (F.char_length(d) == 8)
    found = F.filter(id_reads(upper, BARE), lambda d: F.char_length(d).between(6, 10) & ~date(d) & (near | ids.company_id_ok(d)))
    return F.when(~_is(NO_BARE, upper), found).otherwise(F.array().cast("array<string>"))


def buyer_id(line: Column) -> Column:
    """Digits of a buyer's id with misread letters repaired, four at least; null if the line has none."""
    digits = F.regexp_replace(ids.repair_digits(F.regexp_extract(line, BUYER_ID, 1)), "[^0-9]", "")
    return F.when(F.char_length(digits) >= 4, digits)


def buyer_name(line: Column) -> Column:
    """A buyer's name; null on lines that speak of the buyer's id."""
    name = F.trim(F.regexp_extract(line, BUYER_NAME, 1))
    return F.when(~_is("CIF|CNP", F.upper(line)) & (name != ""), name)


def parties(lines: DataFrame, buyers: DataFrame | None = None) -> DataFrame:
    """doc_id, seller_id, seller_ok, labelled, candidates, buyer_id, buyer_name of each document, in one shuffle.

    The first labelled id is the seller's as it is read, even if it is the buyer's; where no line has one, the first bare number
    that can be an id and is not the buyer's. seller_ok tells whether its control digit fits, labelled whether a label stood
    before it. candidates are the labelled ids and what each may stand for, else the bare ones; the buyer's id is never guessed.
    buyers (doc_id, buyer_id), if given, tells the buyers of documents over what is printed; of several the least counts. Null texts say nothing; documents without ids have nulls and no candidates; an empty table gives none.
    """
    rows = lines.select("doc_id", "line_no", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"labels": labelled_ids(F.upper("text")), "bare": bare_ids(F.col("text")), "b": buyer_id(F.col("text")), "n": buyer_name(F.col("text"))})
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("line_no", c)))), lambda x: x[c]))
    out = rows.groupBy("doc_id").agg(in_order("labels").alias("labels"), in_order("bare").alias("bare"), _first(F.col("b")).alias("printed_buyer"), _first(F.col("n")).alias("buyer_name"))
    if buyers is not None:
        out = out.join(buyers.groupBy("doc_id").agg(F.min("buyer_id").alias("known_buyer")), "doc_id", "left")
        out = out.withColumn("printed_buyer", F.coalesce("known_buyer", "printed_buyer"))
    other = lambda d: ~d.eqNullSafe(F.col("printed_buyer"))
    out = out.withColumns({"others": F.filter("labels", other), "bare": F.filter("bare", other)})
    labelled, first = F.size("labels") > 0, F.get("labels", F.lit(0))
    seller = F.when(labelled, first).otherwise(F.get("bare", F.lit(0)))
    guesses = F.flatten(F.transform("others", lambda d: ids.id_candidates(d, F.col("printed_buyer"))))
    guesses = F.array_distinct(F.when(first == F.col("printed_buyer"), F.concat(F.array(first), guesses)).otherwise(guesses))
    return out.select(
        "doc_id", seller.alias("seller_id"), ids.company_id_ok(seller).alias("seller_ok"), (labelled & seller.isNotNull()).alias("labelled"),
        F.when(labelled, guesses).otherwise(F.array_distinct("bare")).alias("candidates"), F.col("printed_buyer").alias("buyer_id"), "buyer_name",
    )


def named_buyers(found: DataFrame, registry: DataFrame) -> DataFrame:
    """found with buyer_name as the registry (cui, name) has it, and buyer_known: whether it knows the buyer's id.

    Distinct ids meet the registry, so a buyer of many receipts is looked up once; where the registry has no name the printed
    one stays. Of several names of an id the least counts.
    """
    names = registry.groupBy(F.col("cui").alias("buyer_id")).agg(F.min("name").alias("_name"), F.lit(True).alias("_known"))
    wanted = found.select("buyer_id").where("buyer_id IS NOT NULL").distinct().join(names, "buyer_id")
    out = found.join(wanted, "buyer_id", "left")
    return out.withColumns({"buyer_name": F.coalesce("_name", "buyer_name"), "buyer_known": F.coalesce("_known", F.lit(False))}).select(*found.columns, "buyer_known")
