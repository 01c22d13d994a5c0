"""Names, labels, dates, document kinds and accounts from text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a company.
STOP_WORDS = ("SRL", "SA", "THE", "COM", "PROD", "IMPEX", "GROUP", "AND")

# Ordered rules, the first that a receipt's text matches names the expense account.
ACCOUNT_RULES = (
    (r"MOTORINA|BENZINA|\bGPL\b|DIESEL|ADBLUE|CARBURANT|\bOMV\b|PETROM|\bMOL\b|ROMPETROL|LUKOIL|SOCAR|GAZPROM|\bAVIA\b", "6022"),
    (r"\bENEL\b|E\.?ON|ENGIE|ELECTRICA|HIDROELECTRICA|CEZ\b|PPC\b|APA\s?NOVA|APAVITAL|COMPANIA\s+DE\s+APA|ENERGIE\s+ELECTRICA|GAZE\s+NATURALE", "605"),
    (r"ORANGE|VODAFONE|TELEKOM|\bDIGI\b|\bRCS\b|RDS\b|POSTA\s+ROMANA|ABONAMENT\s+(MOBIL|INTERNET|TV)", "626"),
    (r"FAN\s?COURIER|SAMEDAY|CARGUS|\bDPD\b|\bGLS\b|\bDHL\b|\bUPS\b|\bTNT\b|CURIER|EXPEDIERE|AWB\b", "624"),
    (r"HOTEL|PENSIUNE|CAZARE|BOOKING|MOTEL|HOSTEL", "625"),
    (r"SERVICE\s+AUTO|VULCANIZARE|\bITP\b|SCHIMB\s+ULEI|REPARATI[EI]|PIESE\s+AUTO|AUTOSERVICE", "611"),
    (r"ASIGURAR|ALLIANZ|GROUPAMA|OMNIASIG|EUROINS|GENERALI|\bRCA\b|CASCO|ASIROM|GRAWE", "613"),
    (r"COMISION\s+BANCAR|BANCA\s+TRANSILVANIA|\bBCR\b|\bBRD\b|\bING\b|RAIFFEISEN|UNICREDIT|CEC\s+BANK|TAXA\s+CONT", "627"),
    (r"NOTAR|AVOCAT|EXECUTOR|EXPERT\s+CONTABIL|ONORARIU|CABINET\s+DE\s+AVOCATURA|TRADUCERI\s+AUTORIZATE", "622"),
    (r"CHIRIE|\bRENT\b|INCHIRIERE\s+SPATIU|LOCATIUNE", "612"),
    (r"GOOGLE\s+ADS|FACEBOOK|META\s+ADS|TIKTOK\s+ADS|PUBLICITATE|RECLAMA|PROMOVARE", "623"),
    (r"RESTAURANT|CATERING|CAFENEA|COFFEE|PIZZA|BISTRO|FAST\s?FOOD|PATISERIE|COFETARIE|PARFUMERIE|DOUGLAS|SEPHORA|\bCADOU|NOTINO|FLORARIE", "623"),
    (r"EMAG|ALTEX|FLANCO|MEDIA\s+GALAXY|\bPC\s?GARAGE|CEL\.RO|LAPTOP|MONITOR|IMPRIMANTA|TELEFON\s+MOBIL|TABLETA", "303"),
    (r"DEDEMAN|HORNBACH|LEROY\s?MERLIN|BRICO|ARABESQUE|MATHAUS|MATERIALE\s+DE\s+CONSTRUCTI", "6028"),
    (r"PAPETARIE|BIROTICA|LIBRARIE|TONER|CARTUS|HARTIE\s+COPIATOR|DIVERTA|AUCHAN\s+PAPETARIE|RECHIZITE", "604"),
    (r"FARMACI|PHARMA|AMERIS|CATENA|HELP\s?NET|SENSIBLU|DR\.?\s?MAX|BENU\b|DONA\b", "604"),
    (r"KAUFLAND|LIDL|CARREFOUR|MEGA\s?IMAGE|PROFI\b|AUCHAN|PENNY|METRO\b|SELGROS|LA\s?DOI\s?PASI", "6028"),
    (r"ROVINIETA|PEAJ|TAXA\s+(DE\s+)?POD|TAXA\s+DRUM|CNAIR", "635"),
    (r"PARCARE|PARKING|SPALATORIE\s+AUTO", "628"),
)
DEFAULT_ACCOUNT = "628"

# What tells a till receipt, fuel and a card transaction from a payment slip, and what tells a slip.
_TILL = r"BON\s*FISCAL|TOTAL\s*TVA|CASA\s+DE\s+MARCAT|NUMAR\s*BON|AMEF|EJTRZ|\bUNPIR\b"
_FUEL = r"MOTORINA|BENZINA|\bGPL\b|DIESEL|ADBLUE|SKID\s*GPL"
_TRANSACTION = r"TRX\s*/\s*CHITANTA|ID\s*TRX\s*/\s*CH"
_TITLE = r"(?:^|\s)CH[I1L][T7L][A-ZĂÂÎȘȚ]{3,}(?:\s|$)|(?:^|\s)CHITAN[TȚ]A(?:\s|$)"
_FORM = r"(?:SERIE|SERIA|SERIC)\s*[/\-]?\s*(?:NUMAR|NWUAR|NOMAR|TOMNAR|NOUAR|NHONAR|SRONAR|ANAR)|(?:AM\s*)?PR[I1U]M[I1U]T\s+DE\s+L[AE]"
_SUM = r"\bSU[MN](?:A|K|KI|AI)\b"
_COURIER = r"CHITANTA\s+RAMBURS|RAMBURS\s+CONT\s+COLECTOR|SERIA\s+RAMB"


# Letters with diacritics, and those without.
DIACRITICS, PLAIN = "ĂÂÀÁÎȘŞȚŢ", "AAAAISSTT"


def fold_upper(c: Column) -> Column:
    """Upper case without diacritics."""
    return F.translate(F.upper(c), DIACRITICS, PLAIN)


def first_rule(text: Column, rules=ACCOUNT_RULES, default: str = DEFAULT_ACCOUNT) -> Column:
    """The value of the first rule whose pattern the text holds."""
    t = F.upper(text)
    out = F.when(F.lit(False), None)
    for pattern, value in rules:
        out = out.when(F.rlike(t, F.lit(pattern)), value)
    return out.otherwise(default)


def document_kind(text: Column) -> Column:
    """One of six kinds, in fixed order of precedence."""
    t = F.upper(text)
    has = lambda *words: F.rlike(t, F.lit("|".join(map(re.escape, words))))
    return (
        F.when(has("FACTURA", "INVOICE"), "Factură")
        .when(has("BON FISCAL", "CASA DE MARCAT", "BF.", "BF "), "Bon Fiscal")
        .when(has("TERMINAL ID", "PIN VERIFICAT", "TRANZACTIE ACCEPTATA", "TRANZACTIE APROBATA", "POS"), "Chitanță POS")
        .when(has("CHITANTA"), "Chitanță de mână")
        .when(has("BENZINA", "MOTORINA", "DIESEL"), "Fișă Combustibil")
        .otherwise("Necunoscut")
    )


def looks_like_slip(text: Column) -> Column:
    """A payment slip: no mark of a till, of fuel or of a card transaction, and enough evidence of the form."""
    t = fold_upper(text)
    is_ = lambda p: F.rlike(t, F.lit(p))
    parts = sum((is_(p).cast("int") for p in (_TITLE, _FORM, _SUM)), F.lit(0))  # any two of title, form and sum
    evidence = is_(_COURIER) | (parts >= 2)
    return F.coalesce(evidence & ~is_(_TILL) & ~is_(_FUEL) & ~is_(_TRANSACTION), F.lit(False))


def is_slip(text: str) -> bool:
    """`looks_like_slip` of one upper-cased text, for tasks that read whole pages."""
    t = text.translate(str.maketrans(DIACRITICS, PLAIN))
    has = lambda p: re.search(p, t) is not None
    # each pattern has one of its words, so a look for those spares most searches
    parts = ("CH" in t and has(_TITLE)) + (("SERI" in t or "PR" in t) and has(_FORM)) + ("SU" in t and has(_SUM))
    return (parts >= 2 or "RAMB" in t and has(_COURIER)) and not (has(_TILL) or has(_FUEL) or has(_TRANSACTION))


def name_tokens(name: Column) -> Column:
    """Telling words of a name, and its first four to eight letters run together."""
    clean = F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", " ")
    words = F.filter(F.split(clean, " "), lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP_WORDS))
    letters = F.replace(clean, F.lit(" "), F.lit(""))
    starts = F.transform(F.filter(F.sequence(F.lit(4), F.lit(8)), lambda n: F.char_length(letters) >= n), lambda n: F.substr(letters, F.lit(1), n))
    return F.array_distinct(F.concat(words, starts))


def name_score(official: Column, read: Column) -> Column:
    """Likeness of an official name and a read one, 0 to 1: shared tokens over the smaller set, plus bonuses for tokens inside the other."""
    a, b = name_tokens(official), name_tokens(read)
    joined = lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))
    inside = lambda tokens, text: F.size(F.filter(tokens, lambda t: (F.char_length(t) >= 4) & F.contains(text, t)))
    base = F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))
    score = F.least(F.lit(1.0), base + 0.15 * inside(a, joined(read)) + 0.10 * inside(b, joined(official)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), score).otherwise(0.0)


def fuzzy_equal(a: Column, b: Column, tolerance: int = 1) -> Column:
    return F.levenshtein(F.upper(a), F.upper(b)) <= tolerance


def _zero_for_eight(v: Column, low: int, high: int) -> Column:
    """v if it lies in the range, else v with the first 8 that helps read as 0; null if none does."""
    s = v.cast("string")
    tries = F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.when(F.substr(s, i, F.lit(1)) == "8", F.concat(F.substr(s, F.lit(1), i - 1), F.lit("0"), F.substr(s, i + 1, F.lit(9)))).cast("int"))
    return F.when(v.between(low, high), v).otherwise(F.get(F.filter(tries, lambda x: x.between(low, high)), F.lit(0)))


def receipt_date(line: Column) -> Column:
    """ISO date of a line, with single 8s of thermal print read as 0; days are checked for 1 to 31 only, null if none is there."""
    pattern = r"\b(\d{1,2})[./-](\d{1,2})[./-](2[08]\d{2})\b"
    # each step is bound once: most lines have no date and cost one look
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    ranges = ((1, 31), (1, 12), (2000, 2099))

    def written(parts: Column) -> Column:
        d, m, y = (F.get(parts, F.lit(i)) for i in range(3))
        return F.when(d.isNotNull() & m.isNotNull() & y.isNotNull(), F.format_string("%04d-%02d-%02d", y, m, d))

    read = bind(F.regexp_extract(line, pattern, 0), lambda s: bind(F.split(s, "[./-]"), lambda p: bind(F.array(*(_zero_for_eight(F.get(p, F.lit(i)).try_cast("int"), *r) for i, r in enumerate(ranges))), written)))
    return F.when(F.rlike(line, F.lit(pattern)), read)


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# What tells a restaurant, and a drink of another rate.
RESTAURANT = ("RESTAURANT", "PIZZ", "FAST FOOD", "CAFEA", "MENIU")
ALCOHOL = ("BERE", "VIN ", "WHISKY", "VODKA", "COCKTAIL", "ALCOOL")


def mixed_rates(text: Column) -> Column:
    """Whether a restaurant's receipt also names alcohol, so that its VAT may be of two rates."""
    says = lambda words: F.rlike(F.upper(F.coalesce(text, F.lit(""))), F.lit("|".join(words)))
    return says(RESTAURANT) & says(ALCOHOL)


def bytes_text(n: Column) -> Column:
    """A number of bytes for people: one decimal below ten, none above, ties to even; B, KB, MB, GB or TB."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    step = F.least(F.lit(4), F.when(n >= 1024, F.floor(F.log2(n.cast("double")) / 10)).otherwise(0)).cast("int")
    v = n.cast("double") / F.pow(F.lit(1024.0), step)
    shown = F.when(v >= 10, F.bround(v, 0).cast("decimal(20,0)").cast("string")).otherwise(F.bround(v, 1).cast("decimal(20,1)").cast("string"))
    return F.concat(shown, F.lit(" "), F.get(units, step))


def treated_as_slip(doc_type: Column, processing_mode: Column, looks_like_one: Column) -> Column:
    """What the uploader chose ("chitanta" or "bon" in any case, doc_type before processing_mode), else what the document looks like."""
    mode = F.lower(F.coalesce(doc_type, processing_mode, F.lit("auto")))
    return F.when(mode == "chitanta", True).when(mode == "bon", False).otherwise(looks_like_one)
