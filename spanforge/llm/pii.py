"""PII: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

Base kinds (always reported): email, ip, card (Luhn), phone. Added kinds: iban (mod-97), ssn and local_phone, which
need a context word nearby to pass ``MIN_SCORE``. Offsets count code points, ends are exclusive.

Defined cases: a null text counts as an empty one; an empty text has no span; repeated rows are each reported;
extra columns of the input are ignored by ``find_pii`` (only the id and text columns are read) and an empty table gives
an empty result with the same columns. Texts may be of any length: the cost of locating is close to linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.spans import Proposal, alone, joined, masked, near, of_rank, with_spans

#: Spans of the added kinds are kept from this score on.
MIN_SCORE = 0.7
BASE = ("email", "ip", "card", "phone")

# Possessive forms of the plain patterns. A match can begin only where a run of its characters begins or where the
# last match ended (\G), so these find the same matches without trying every place inside a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
LOCAL = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"

PAY_WORDS = "card|visa|credit|debit|karte|carte|tarjeta|payment"
CALL_WORDS = "phone|tel|call|mobile|fax|contact|anruf"
BANK_WORDS = "iban|bank|account|konto|compte|cuenta"
ID_WORDS = "ssn|social security|tax id"
MAIL_WORDS = "mail|contact|@"
HOST_WORDS = "ip|host|server|address"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.when(F.length(number) > 0, F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """Whether an account number in capitals and digits leaves 1 when divided by 97, read as the standard has it."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.left(account, F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def in_range(hit: Column) -> Column:
    """Whether all parts of a dotted number are at most 255, leading zeros aside."""

    def small(part: Column) -> Column:
        n = F.regexp_replace(part, "^0+", "")
        return (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))

    return F.forall(F.split(hit, r"\."), small)


def _score(base: float, words: str):
    return lambda x: F.lit(base) + F.when(near(x, words), 0.1).otherwise(0.0)


def _card(x: Column) -> Column:
    n = digits(x["hit"])
    return F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False)


def _iban(x: Column) -> Column:
    account = F.replace(x["hit"], F.lit(" "), F.lit(""))
    return alone(x) & F.when(F.length(account).between(15, 34), mod97(account)).otherwise(False)


def _ssn(x: Column) -> Column:
    return alone(x) & ~x["hit"].rlike("^(000|666|9)|-00-|0000$") & near(x, ID_WORDS)


def _local(x: Column) -> Column:
    return alone(x) & ~F.right(x["before"], F.lit(8)).rlike(r"[+0-9][-0-9 .()]*$") & near(x, CALL_WORDS)


PROPOSALS = [
    Proposal("email", EMAIL, "@", lambda x: F.lit(True), _score(0.9, MAIL_WORDS)),
    Proposal("ip", IP, r"[0-9]\.[0-9]", lambda x: in_range(x["hit"]), _score(0.7, HOST_WORDS)),
    Proposal("card", CARD, r"[0-9](?:[\x20-]?[0-9]){11}", _card, _score(0.9, PAY_WORDS)),
    Proposal("phone", PHONE, r"\+[0-9]", lambda x: F.length(digits(x["hit"])).between(9, 15), _score(0.8, CALL_WORDS)),
    Proposal("iban", IBAN, "[A-Z][A-Z][0-9][0-9]", _iban, _score(0.9, BANK_WORDS)),
    Proposal("ssn", SSN, SSN, _ssn, _score(0.6, ID_WORDS)),
    Proposal("local_phone", LOCAL, LOCAL, _local, _score(0.6, CALL_WORDS)),
]


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with column out: all spans, struct(start, rank, end, kind, score), by start, then kind as listed."""
    df = df.withColumn("__pii_text", F.coalesce(F.col(text), F.lit("")))
    df = with_spans(df, "__pii_text", PROPOSALS, out)
    sure = F.filter(out, lambda s: (s["rank"] < len(BASE)) | (F.round(s["score"], 4) >= MIN_SCORE))
    return df.withColumn(out, sure).drop("__pii_text")


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span in its text replaced by the kind in brackets; a null text stays null."""
    found = find_pii(df, text, "__pii_spans")
    return found.withColumn(text, masked(F.col(text), F.col("__pii_spans"))).drop("__pii_spans")


def pii_report(documents: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, all spans."""
    found = find_pii(documents.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("pii", of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
