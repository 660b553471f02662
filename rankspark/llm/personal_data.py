"""Personal data by patterns, checksums and words nearby; DataFrame functions alone.

1. A pattern proposes spans, leftmost and without overlap for each kind.  Its matches and the pieces between
   them (the same pattern as a separator) give every place by running sums of lengths, in code points.
2. Validators confirm: parts of addresses, numbers of digits, Luhn's check, the rest by 97 of an account
   number cut to its country's length.
3. Each span has a score in percent: what its kind starts with, more where a word of the kind's stands within
   ``BEFORE`` code points before or ``AFTER`` behind it (not beyond the next match of the kind), less where
   a word of ``AGAINST`` does.

Kinds of ``BASE`` (email, ip, card, phone) are kept whatever their score; the method adds ``iban`` and
``ssn``, kept from ``KEEP`` percent on.  Patterns take no step back and start only where a run starts, so a
long run of digits or letters is read once and not from each of its places.

Edge cases: a null or empty text has no spans; a row with a null doc_id is scanned like any other; repeated
rows give repeated results; spans of different kinds may overlap; those with one start stand in the order of
``KINDS``; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
BEFORE, AFTER, KEEP = 40, 20, 60
BONUS, MALUS = 30, 20
STEP = 256

#: Patterns as Java reads them.  The possessive quantifiers and what must not stand before only save time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this piece has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
SSN_UNUSED = "^(?:000|666|9)|-00-|-0000$"

# Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
# Scores in percent before the words nearby are looked at, and those words.
SCORES = {"email": 90, "ip": 60, "card": 85, "phone": 70, "iban": 90, "ssn": 40}
NEARBY = {
    "email": "email|e-mail|mail|contact|correo|kontakt",
    "ip": "ip|address|host|server|login|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|tel|mobile|call|fax|telefon|telephone|handy",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST = "example|sample|version|test|isbn|order|serial"


def _sums(sizes: Column) -> Column:
    """Sums up to and with each element; each step copies those before it."""
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(sizes, none, lambda acc, x: F.struct(
        (acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")))["all"]


def _running(sizes: Column) -> Column:
    """The same for long arrays: sums in parts of STEP elements, and sums of what the parts come to."""
    many = F.greatest(F.ceil(F.size(sizes) / STEP).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(1), many), lambda k: _sums(F.slice(sizes, (k - 1) * STEP + 1, F.lit(STEP))))
    last = (lambda part: F.coalesce(F.try_element_at(part, F.lit(-1)), F.lit(0).cast("long")))
    shifted = (lambda all_parts: F.flatten(F.zip_with(
        all_parts, _sums(F.transform(all_parts, last)), lambda part, end: F.transform(part, lambda x: x + end - last(part)))))
    return F.transform(F.array(parts), shifted)[0]  # an array of one names the parts, which are used twice


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _rest_by_97(compact: Column) -> Column:
    """The rest by 97 of an account number, its first four characters behind the others, letters from 10 on."""
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    place = (lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(
        (acc * F.when(place(c) < 10, 10).otherwise(100) + place(c)) % 97))


def _confirmed(kind: str, span: Column) -> Column:
    """The code points of a match that count, null where the validator says no."""
    match = span["match"]
    whole = F.char_length(match).cast("long")
    if kind == "email":
        return whole
    if kind == "ip":
        return F.when(match.rlike(IP_PARTS), whole)
    if kind == "card":
        return F.when(F.call_function("luhn_check", _digits(match)), whole)
    if kind == "phone":
        return F.when(F.char_length(_digits(match)).between(10, 15), whole)
    if kind == "ssn":
        return F.when(~match.rlike(SSN_UNUSED), whole)
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    compact, size = F.replace(match, F.lit(" "), F.lit("")), F.try_element_at(lengths, F.substring(match, 1, 2))
    raw = F.when(F.substring(match, 5, 1) == " ", size + F.floor((size - 1) / 4)).otherwise(size).cast("int")
    behind = F.when(raw < F.char_length(match), F.substr(match, raw + 1, F.lit(1))).otherwise(F.substring(span["after"], 1, 1))
    fits = (F.char_length(compact) >= size) & ~behind.rlike("[A-Za-z0-9]")
    return F.when(fits & (_rest_by_97(F.substr(compact, F.lit(1), size)) == 1), raw.cast("long"))


def _score(kind: str, span: Column) -> Column:
    """Percent: the kind's own, more and less for words nearby."""
    near = F.lower(F.concat(F.right(span["before"], F.lit(BEFORE)), F.lit(" "), F.left(span["after"], F.lit(AFTER))))
    word = (lambda words: F.when(near.rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"), 1).otherwise(0))
    return F.least(F.lit(100), F.lit(SCORES[kind]) + BONUS * word(NEARBY[kind]) - MALUS * word(AGAINST)).cast("int")


def _spans(kind: str, found: Column, between: Column) -> Column:
    """The confirmed spans of a kind from its matches and the pieces between them."""
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: (F.char_length(gap) + F.char_length(m)).cast("long"))
    ends = _running(sizes)
    places = F.transform(F.sequence(F.lit(1), F.size(found)), lambda k: F.struct(
        F.element_at(found, k).alias("match"), F.element_at(between, k).alias("before"), F.element_at(between, k + 1).alias("after"), k.alias("k")))
    judged = F.zip_with(places, ends, lambda p, end: F.struct(
        (end - F.char_length(p["match"])).alias("start"), _confirmed(kind, p).alias("size"), _score(kind, p).alias("score")))
    kept = F.filter(judged, lambda s: s["size"].isNotNull() & (F.lit(kind in BASE) | (s["score"] >= KEEP)))
    return F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), (s["start"] + s["size"]).alias("end"),
        F.lit(kind).alias("kind"), s["score"].alias("score")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (start, place, end, kind, score), by start, then by the order of the kinds."""
    frame = texts_of(docs)
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        met = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        frame = frame.withColumn(f"met_{kind}", F.when(met, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        frame = frame.withColumn(f"gap_{kind}", F.when(F.size(f"met_{kind}") > 0, F.split("text", PATTERNS[kind], -1)))
    frame = frame.drop("text")
    empty = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string,score:int>>")
    spans = [F.when(F.size(f"met_{k}") > 0, _spans(k, F.col(f"met_{k}"), F.col(f"gap_{k}"))).otherwise(empty) for k in KINDS]
    return frame.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, all spans and their scores as text."""
    found = personal_data(docs)
    count = (lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}"))
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
