"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Beside the base kinds there are account numbers (kind iban): in one piece, or printed in groups of four
with blanks between, where each group but the first holds a digit. Context words count within 32
characters on either side of a span.

All of it is DataFrame functions. A null text counts as empty and gives no span; empty tables give
empty results; repeated rows are scanned each for itself; further columns of the input are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spans_of, table

# Possessive quantifiers and look-behinds keep each scan linear in the text; they change no match, as
# the character that follows a run is never part of it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+"
    r"|\x20[A-Z0-9]{4}(?:\x20(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}+(?:\x20(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3}+)?)(?![A-Za-z0-9])"
)

IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"

KINDS = ("email", "ip", "card", "phone", "iban")
CONTEXT = {
    "email": r"(?i)mail|contact|write|e-?post|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|addr|client",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"(?i)phone|tel|call|mobile|fax|ruf",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
#: Score of a span whose pattern, and checksum where there is one, holds; context adds 0.2.
BASE_SCORE = {"email": 0.75, "ip": 0.5, "card": 0.75, "phone": 0.5, "iban": 0.75}


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's check."""
    digits = F.reverse(F.split(F.regexp_replace(value, "[ -]", ""), ""))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.ascii(d) - 48).otherwise(2 * (F.ascii(d) - 48) - F.when(F.ascii(d) >= 53, 9).otherwise(0))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    value = F.replace(value, F.lit(" "))
    turned = F.split(F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4)), "")
    rest = F.aggregate(
        turned,
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97),
    )
    return rest == 1


def phone_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and an array of spans (kind, start, end, value, score), by kind and start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = {
        "email": F.when(F.instr(text, "@") > 0, spans_of(text, EMAIL)),
        "ip": spans_of(text, IP, lambda v: v.rlike(IP_PARTS)),
        "card": spans_of(text, CARD, luhn),
        "phone": F.when(F.instr(text, "+") > 0, spans_of(text, PHONE, phone_digits)),
        "iban": spans_of(text, IBAN, mod97),
    }

    def scored(kind: str) -> Column:
        score = lambda s: F.lit(BASE_SCORE[kind]) + F.when(s["b"].rlike(CONTEXT[kind]) | s["f"].rlike(CONTEXT[kind]), 0.2).otherwise(0.0)
        one = lambda s: F.struct(F.lit(kind).alias("kind"), s["s"].alias("start"), s["e"].alias("end"), s["v"].alias("value"), score(s).alias("score"))
        return F.transform(F.coalesce(F.col(f"_{kind}"), F.expr("cast(array() as array<struct<s:int,e:int,v:string,b:string,f:string>>)")), one)

    found = docs.select(F.col(id_col).alias(id_col), *[c.alias(f"_{k}") for k, c in spans.items()])
    return found.select(id_col, F.concat(*[scored(k) for k in KINDS]).alias("spans"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Contract columns of ``find_pii`` over all documents; ``scores`` follows the order of ``spans``."""
    found = find_pii(table(spark, sf_dir, "documents"))
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    return found.select(
        "doc_id",
        *[n(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, mark), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", mark), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
