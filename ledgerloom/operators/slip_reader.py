"""Slips read three times (focused bands, digits, text): zones between anchors and stop words, ids, dates, and the sum that the readings agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ids, money, text
from ledgerloom.operators import slip
from ledgerloom.operators.receipt import ID_CONTEXT, LEGAL_FORM

#: Names of the readings, the surest for digits first.
READINGS = ("focused", "digits", "text")
#: Difference up to which a sum in digits is the one said in words.
SAID = 1.0

# Labels of a slip's fields with the words that end them.
PAYER = (("AM PRIMIT DE LA", "PRIMIT DE LA"), ("CUI", "CNP", "CIF", "ADRESA", "SUMA"))
ISSUER = (("UNITATEA", "ENTITATEA", "FURNIZOR", "SOCIETATEA"), ("CUI", "CIF", "COD FISCAL", "NR", "ADRESA", "PRIMIT DE LA"))
IN_WORDS = (("ADICA",), ("REPREZENTAND", "REPREZENT"))
SUBJECT = (("REPREZENTAND", "REPREZENT"), ("CASIER", "SEMNATURA"))
# The line from which on the payer speaks, payers' ids, sums and dates as slips write them, letters for digits.
FROM_PAYER = r"PRIMIT DE LA|(?:AM\s*)?PR[I1U]M[I1U]T\s+DE\s+L[AE]"
PAYER_ID = r"(?:CUI|CIF|C\.?F\.?|C\.?U\.?I(?:\.?/C\.?N\.?P\.?)?|CNP)\s*[:.]?\s*(?:[RK][O0Q]\s*)?([0-9OQDILSZBG]{4,13})|\b[RK][O0Q]\s*([0-9OQDILSZBG]{4,10})"
SUM_LABEL = r"\bSU[MN](?:A|K|KI|AI)\b"
SUM_INLINE = r"\bSU[MN](?:A|K|KI|AI)(?:\s+DE)?\s*[.:]?\s*([0-9]{1,5})\s*[.,\s]\s*([0-9]{2})\b"
SUM_COMPACT = r"\bSU[MN](?:A|K|KI|AI)(?:\s+DE)?[^0-9]{0,12}([0-9]{3,7})\b"
SUM_FUZZY = r"(?<![A-Z0-9])([0-9OQDILZSEAGTBH]{1,5})\s*(?:[.,+:]|\s)\s*([0-9OQDILZSEAGTBH]{2})(?![A-Z0-9])"
MEANINGS = {"O": "0", "Q": "0", "D": "04", "I": "1", "L": "1", "Z": "2", "E": "3", "A": "4", "H": "4", "S": "5", "G": "6", "T": "7", "B": "8"}
DATE = r"([0-9OQDILZSBGFH@]{1,2})\s*(?:[./-]|\s+)\s*([0-9OQDILZSBGFH@]{1,2})\s*(?:[./-]|\s+)\s*(2[0-9OQDILZSBGFH@\s]{3,6})"
DATE_ISO = r"(20\d{2})[./-](\d{1,2})[./-](\d{1,2})"
DATE_NOISE, DATE_LABEL = r"FACTURA|FACT\.|REPREZENT", r"DATA|TIPARIT LA"
DATE_LETTERS, DATE_DIGITS = "OQD@ILZEAHSFGTB", "000011234455678"


def _prepared(lines: DataFrame) -> DataFrame:
    """lines (doc_id, reading, line_no, text) with `up`, upper case without diacritics, and `next`, that of the line below."""
    up = lines.select("doc_id", "reading", "line_no", F.coalesce("text", F.lit("")).alias("text")).withColumn("up", text.fold_upper(F.col("text")))
    return up.withColumn("next", F.lead("up").over(Window.partitionBy("doc_id", "reading").orderBy("line_no")))


def _rank() -> Column:
    """Place of a line: its reading, then its number."""
    return F.struct(F.array_position(F.array(*map(F.lit, READINGS)), F.col("reading")).alias("r"), "line_no")


def _first(value: Column, there: Column) -> Column:
    """The value of the first line where `there` holds, null included."""
    return F.min_by(value, F.when(there, _rank()))


def zone(anchors: tuple[str, ...], stops: tuple[str, ...]) -> tuple[Column, Column]:
    """(what a line says behind its anchor, whether it has one): of several anchors the first of the list; two letters or fewer
    go on with the line below, unless a stop word stands there; the first stop word ends it; null if nothing is left."""
    after = F.lit(None).cast("string")
    for a in reversed(anchors):
        at = F.instr("up", a)
        after = F.when(at > 0, F.substr("up", at + len(a), F.lit(10_000))).otherwise(after)
    stop = "|".join(stops)
    value = F.regexp_replace(after, r"^[ .:_-]+|[ .:_-]+$", "")
    below = F.when((F.char_length(value) < 3) & F.col("next").isNotNull() & ~F.rlike("next", F.lit(stop)), F.col("next")).otherwise(value)
    return F.nullif(F.get(F.split(below, stop, 2), F.lit(0)), F.lit("")), after.isNotNull()


def slip_date(up: Column) -> Column:
    """ISO date of a line in upper case, letters read as the digits they look like; null unless the day exists."""
    digits = lambda c: F.regexp_replace(F.translate(c, DATE_LETTERS, DATE_DIGITS), "[^0-9]", "").try_cast("int")
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    is_iso = F.rlike(up, F.lit(DATE_ISO))
    order = lambda i: F.when(is_iso, F.regexp_extract(up, DATE_ISO, i)).otherwise(F.regexp_extract(up, DATE, 4 - i))
    parts = F.array(*(digits(order(i)) for i in (1, 2, 3)))
    read = bind(parts, lambda p: F.when(F.get(p, F.lit(0)).between(2000, 2099), F.format_string("%04d-%02d-%02d", F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))))
    return F.when(is_iso | F.rlike(up, F.lit(DATE)), F.date_format(read.try_cast("date"), "yyyy-MM-dd"))


def read_fields(lines: DataFrame, own_id: Column | None = None) -> DataFrame:
    """doc_id, issuer, issuer_id, payer, payer_id, payer_person, payer_ok, date, subject of slips.

    lines: doc_id, reading (focused, digits or text), line_no, text. Above the line that says from whom the money came the
    issuer speaks, from there on the payer. payer_ok tells whether the payer's company or personal id passes its control digit:
    a leading zero that spoils it is dropped, and an id that differs from own_id (the user's company) in one digit is that.
    Missing readings and null texts say nothing; nothing read is null. One shuffle, by document and reading, and one by document.
    """
    rows = _prepared(lines)
    w = Window.partitionBy("doc_id", "reading")
    rows = rows.withColumn("_at", F.min(F.when(F.rlike("up", F.lit(FROM_PAYER)), F.col("line_no"))).over(w))
    rows = rows.withColumn("above", F.col("_at").isNull() | (F.col("line_no") < F.col("_at")))
    is_ = lambda name: F.col("reading") == name
    fields = {}
    for name, (labels, where) in {"issuer": (ISSUER, F.col("above") & ~is_("focused")), "payer": (PAYER, is_("text")), "subject": (SUBJECT, is_("text"))}.items():
        value, has = zone(*labels)
        fields[name] = _first(value, has & where)
    legal = F.col("above") & is_("text") & F.rlike("up", F.lit(LEGAL_FORM)) & ~F.rlike("up", F.lit("CHITANTA|PRIMIT DE LA"))
    company = ids.normal_id(F.nullif(F.regexp_extract("up", ID_CONTEXT, 1), F.lit("")))
    has_payer_id = is_("digits") & ~F.col("above") & F.rlike("up", F.lit(PAYER_ID))
    raw = F.concat(F.regexp_extract("up", PAYER_ID, 1), F.regexp_extract("up", PAYER_ID, 2))
    date = slip_date(F.col("up"))
    rows = rows.withColumns({"_company": company, "_date": F.when(~F.rlike("up", F.lit(DATE_NOISE)), date)})
    labelled = F.rlike("up", F.lit(DATE_LABEL))
    out = rows.groupBy("doc_id").agg(
        *(v.alias(k) for k, v in fields.items()),
        _first(F.trim("text"), legal).alias("_legal"),
        _first(F.col("_company"), F.col("above") & ~is_("focused") & F.char_length("_company").between(2, 10)).alias("issuer_id"),
        _first(F.regexp_replace(ids.repair_digits(raw), "[^0-9]", ""), has_payer_id).alias("_id"),
        F.coalesce(_first(F.col("_date"), F.col("_date").isNotNull() & labelled), _first(F.col("_date"), F.col("_date").isNotNull())).alias("date"),
    )
    n = F.char_length("_id")
    person = F.when(n >= 13, F.substring("_id", 1, 13))
    bare = F.substring("_id", 2, 20)
    read = F.when(n.between(4, 12), F.when(~ids.company_id_ok(F.col("_id")) & F.startswith("_id", F.lit("0")) & (n > 4) & ids.company_id_ok(bare), bare).otherwise(F.col("_id")))
    out = out.withColumns({"payer_person": person, "payer_id": read})
    if own_id is not None:
        out = out.withColumn("_own", own_id)
        wrong = F.size(F.filter(F.arrays_zip(F.split("_own", "").alias("a"), F.split("payer_id", "").alias("b")), lambda p: p["a"] != p["b"]))
        mend = ~ids.company_id_ok(F.col("payer_id")) & (F.char_length("_own") == F.char_length("payer_id")) & (wrong == 1) & ids.company_id_ok(F.col("_own"))
        out = out.withColumn("payer_id", F.when(mend, F.col("_own")).otherwise(F.col("payer_id")))
    ok = F.when(F.col("payer_person").isNotNull(), ids.personal_id_ok(F.col("payer_person"))).when(F.col("payer_id").isNotNull(), ids.company_id_ok(F.col("payer_id")))
    return out.select("doc_id", F.coalesce("issuer", "_legal").alias("issuer"), "issuer_id", "payer", "payer_id", "payer_person", ok.alias("payer_ok"), "date", "subject")


def _sums() -> tuple[Column, Column]:
    """(exact sums, sums under repaired letters) of a line, in order."""
    both = lambda p, c: F.zip_with(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    number = lambda a, b: F.concat(a, F.lit("."), b).try_cast("double")
    up = F.col("up")
    inline = F.transform(both(SUM_INLINE, up), lambda m: number(m["a"], m["b"]))
    run = F.regexp_extract(up, SUM_COMPACT, 1)
    compact = F.when((F.col("reading") == "focused") & (run != ""), F.array(number(F.substr(run, F.lit(1), F.char_length(run) - 2), F.right(run, F.lit(2)))))
    none = F.array().cast("array<double>")
    exact = F.concat(money.amounts(F.col("text")), inline, F.coalesce(compact, none))
    variants = lambda m: F.flatten(F.transform(slip.digit_variants(m["a"], MEANINGS), lambda a: F.transform(slip.digit_variants(m["b"], MEANINGS), lambda b: number(a, b))))
    repaired = F.flatten(F.transform(both(SUM_FUZZY, up), variants))
    positive = lambda c: F.filter(c, lambda v: v > 0)
    return positive(exact), positive(repaired)


def read_sums(lines: DataFrame) -> DataFrame:
    """doc_id, digits, words, amount, confirmed, warnings: the sum of a slip from its readings.

    Sums are read on lines that are labelled so and on the line below. The candidates of all readings keep their order, the
    focused reading first, and are never sorted by size. The one next to the sum in words counts if it lies within 1; else one
    of the focused reading that the text or the digits confirm; else the first of any; else the only one under repaired letters,
    or the one next to the words. Digits and words then decide: they agree, or the words win a difference of 10 or less. Null
    where nothing was read; missing readings have no candidates.
    """
    rows = _prepared(lines)
    named = F.rlike("up", F.lit(SUM_LABEL))
    rows = rows.withColumn("_label", named).withColumn("_below", F.lag("_label").over(Window.partitionBy("doc_id", "reading").orderBy("line_no")))
    exact, repaired = _sums()
    there = F.col("_label") | F.coalesce("_below", F.lit(False))
    said, has = zone(*IN_WORDS)
    rows = rows.withColumns({"_exact": F.when(there, exact), "_repaired": F.when(there, repaired), "_said": said, "_says": has & (F.col("reading") == "text")})
    listed = lambda c, r: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("reading") == r) & (F.size(c) > 0), F.struct("line_no", F.col(c).alias("v"))))), lambda x: x["v"])))
    cols = {f"{r}{c}": listed(c, r) for r in READINGS for c in ("_exact", "_repaired")}
    out = rows.groupBy("doc_id").agg(_first(F.col("_said"), F.col("_says")).alias("said"), *(v.alias(k) for k, v in cols.items())).withColumn("words", slip.sum_in_words(F.col("said")))
    focused, digits, plain = (F.col(f"{r}_exact") for r in READINGS)
    out = out.withColumns({"_e": F.array_distinct(F.concat(focused, digits, plain)), "_r": F.array_distinct(F.concat(*(f"{r}_repaired" for r in READINGS)))})

    def nearest(c: str) -> Column:
        ranked = F.transform(c, lambda v, i: F.struct(F.abs(v - F.col("words")).alias("d"), i.alias("i"), v.alias("v")))
        best = F.get(F.array_sort(ranked), F.lit(0))
        return F.when(best["d"] <= SAID, best["v"])

    seen = lambda a, b: F.get(F.filter(a, lambda v: F.exists(b, lambda o: F.abs(o - v) < 0.01)), F.lit(0))
    first = lambda a: F.get(a, F.lit(0))
    sole = F.when(F.size("_r") == 1, first(F.col("_r")))
    out = out.withColumns({"_sure": F.coalesce(nearest("_e"), seen(focused, plain), seen(focused, digits), first(focused), first(digits), first(plain)), "_sole": sole, "_near": nearest("_r")})
    out = out.withColumn("digits", F.coalesce("_sure", "_sole", "_near"))
    guess = F.when(F.col("_sure").isNull(), F.when(F.col("_sole").isNotNull(), "letters of the sum were repaired").when(F.col("_near").isNotNull(), "ambiguous letters of the sum settled by the words").when(F.size("_r") > 0, "ambiguous letters of the sum were not guessed"))
    d, w = F.col("digits"), F.col("words")
    apart = F.abs(d - w)
    verdict = (
        F.when(d.isNull() & w.isNull(), "sum not read")
        .when(w.isNull(), "sum in words not read")
        .when(d.isNull(), "sum in digits not read: the words count")
        .when(apart < 0.01, F.lit(None).cast("string"))
        .when(apart <= 10, "digits and words differ: the words count")
        .otherwise("digits and words differ: the digits count")
    )
    return out.select("doc_id", "digits", "words", slip.decide(d, w).alias("amount"), F.coalesce(apart < 0.01, F.lit(False)).alias("confirmed"), F.array_compact(F.array(guess, verdict)).alias("warnings"))
