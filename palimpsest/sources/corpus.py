"""Synthetic cases for evaluation, made by rule from a number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``form`` is a text, ``{}`` and ``{2}`` in it its values; ``values`` are SQL over the case's number ``i``. A near miss has no categories."""

    name: str
    form: str
    values: tuple[str, ...]
    categories: tuple[str, ...] = ()


def _pad(digits: int, x: str = "i") -> str:
    return f"lpad({x} % {10**digits}, {digits}, '0')"


#: Fifteen digits; the check digit follows from them.
_CARD = f"'4539' || {_pad(11, 'i * 7919')}"
_DOUBLED = f"transform(sequence(1, 15), k -> (CASE WHEN k % 2 = 1 THEN 2 ELSE 1 END) * cast(substring({_CARD}, k, 1) AS int))"
_CHECK = f"(10 - aggregate({_DOUBLED}, 0, (a, x) -> a + cast(x DIV 10 AS int) + x % 10) % 10) % 10"
_GROUPED = "concat_ws('{sep}', transform(sequence(0, 3), k -> substring({card}, 4 * k + 1, 4)))"
_FULL = f"{_CARD} || {_CHECK}"
_WRONG = f"{_CARD} || ({_CHECK} + 1) % 10"

KINDS = (
    Kind("email", "Please write to {} before noon.", ("'user' || i || '@mail' || i % 7 || '.example'",), ("EMAIL",)),
    Kind("phone", "The desk answers at {} all day.", (f"'202-555-' || {_pad(4)}",), ("PHONE",)),
    Kind("phone-area", "Ring {} or come by.", (f"'(202) 555-' || {_pad(4)}",), ("PHONE",)),
    Kind("phone-country", "From abroad dial {} instead.", (f"'+1 202.555.' || {_pad(4)}",), ("PHONE",)),
    Kind("ssn", "Number on file: {}, checked.", ("'219-' || lpad(i % 89 + 10, 2, '0') || '-' || lpad(i % 8999 + 1000, 4, '0')",), ("SSN",)),
    Kind("ipv4", "Host {} did not reply.", ("'198.51.100.' || i % 256",), ("IP_ADDRESS",)),
    Kind("url", "Read {} first.", ("'https://docs.example/page/' || i",), ("URL",)),
    Kind("url-query", "The page ({}) has moved.", ("'http://docs.example/find?n=' || i || '&all=1'",), ("URL",)),
    Kind("card", "Charged to {}, thank you.", (_FULL,), ("CREDIT_CARD",)),
    Kind("card-blanks", "Charged to {}, thank you.", (_GROUPED.format(sep=" ", card=_FULL),), ("CREDIT_CARD",)),
    Kind("card-dashes", "Charged to {}, thank you.", (_GROUPED.format(sep="-", card=_FULL),), ("CREDIT_CARD",)),
    Kind("api-key", "The old key {} was revoked.", ("'sk-' || lpad(i, 20, 'a')",), ("API_KEY",)),
    Kind("access-key", "Rotate {} soon.", (f"'AKIA' || {_pad(16)}",), ("API_KEY",)),
    Kind("host-token", "It used {} to push.", ("'ghp_' || lpad(i, 24, 'b')",), ("API_KEY",)),
    Kind("token", "token = {} expires.", ("'tk' || i || 'z9'",), ("API_KEY",)),
    Kind("password", "password: {} was set.", ("'pw' || i || 'x'",), ("PASSWORD",)),
    Kind("password-quoted", 'Password = "{}" was set.', ("'two words ' || i",), ("PASSWORD",)),
    Kind("secret", "secret = {} is old.", ("'s3cr3t' || i",), ("SECRET",)),
    Kind("secret-quoted", "SECRET: '{}' is old.", ("'s3 cr3t ' || i",), ("SECRET",)),
    Kind("bearer", "Header {} was logged.", ("'Bearer tok.en_' || i",), ("SECRET",)),
    Kind("jwt", "Session {} ended.", ("'eyJhbGci' || i || '.eyJzdWIi' || i || '.c2ln' || i",), ("SECRET",)),
    Kind("key-header", "Found {} in the archive, file {2}.", ("CASE WHEN i % 2 = 0 THEN '-----BEGIN PRIVATE KEY-----' ELSE '-----BEGIN EC PRIVATE KEY-----' END", "'f' || i"), ("SECRET", None)),
    Kind("combined", "mail {}\npassword={2}", ("'both' || i || '@mail.example'", "'pw-' || i"), ("EMAIL", "PASSWORD")),
    Kind("none", "Order {} has 3 items of 12 pieces.", ("'A' || i",)),
    Kind("near-placeholder", "Left were [EMAIL_{}] and [REDACTED_SSN].", ("i % 9 + 1",)),
    Kind("near-ipv4", "Neither 256.{}.1.1 nor 1.2.3.999 is a host.", ("i % 256",)),
    Kind("near-version", "Version 1.2.3.4.{} is out.", ("i % 90 + 1",)),
    Kind("near-ssn", "Form 000-{}-1234 is void.", ("i % 89 + 10",)),
    Kind("near-ssn-run", "Part 1219-55-{}0 is in stock.", ("i % 8999 + 1000",)),
    Kind("near-card", "Number {} fails its check.", (_WRONG,)),
    Kind("near-card-short", "The card ends in {}.", (_pad(4),)),
    Kind("near-email", "Ask user{}@localhost about it.", ("i",)),
    Kind("near-email-label", "The label EMAIL_{} is no address.", ("i",)),
    Kind("near-phone-run", "Serial 202555{} is no number to call.", (_pad(4),)),
    Kind("near-phone-short", "Extension 555-{} answers.", (_pad(4),)),
    Kind("near-password", "A password policy of {} letters applies.", ("i % 20 + 8",)),
    Kind("near-password-quoted", "The word 'password' occurs {} times.", ("i % 50",)),
    Kind("near-secret", "The secret of soup number {} is time.", ("i",)),
    Kind("near-token", "A token budget of {} units was spent.", ("i",)),
    Kind("near-key", "The prefix sk-{} is short.", ("i % 1000",)),
    Kind("near-key-header", "A private key concept, page {}.", ("i",)),
    Kind("near-bearer", "The scheme of case {} is called Bearer.", ("i",)),
    Kind("near-jwt", "Dotted words alpha{}.beta.gamma are none.", ("i",)),
    Kind("near-digits", "Wide digits １２３４５ in case {}.", ("i",)),
)
_FOUND = "array<struct<category:string,text:string,start:int,end:int,required:boolean>>"


def cases(spark: SparkSession, n: int = 5 * len(KINDS)) -> DataFrame:
    """(``name``, ``text``, ``findings``): ``n`` cases, the kinds in turn, the same on every run; spread over the cluster as any range is."""
    rows = spark.range(n).withColumn("i", F.col("id"))
    kind = F.pmod("id", F.lit(len(KINDS))).cast("int")

    def built(k: Kind) -> Column:
        # the text up to each value, then the value
        parts, rest = [], k.form
        for mark in ("{}", "{2}")[: len(k.values)]:
            head, rest = rest.split(mark, 1)
            parts.append(head)
        values = [F.expr(v).cast("string") for v in k.values]
        text, found, at = F.lit(""), [], F.lit(0)
        for head, value, category in zip(parts, values, k.categories or (None,) * len(values)):
            start = at + len(head)
            at = start + F.length(value)
            text = F.concat(text, F.lit(head), value)
            if category:
                found.append(F.struct(F.lit(category).alias("category"), value.alias("text"), start.alias("start"), at.alias("end"), F.lit(True).alias("required")))
        return F.struct(F.lit(k.name).alias("kind"), F.concat(text, F.lit(rest)).alias("text"), (F.array(*found) if found else F.array()).cast(_FOUND).alias("findings"))

    case = F.when(kind == 0, built(KINDS[0]))
    for number, k in enumerate(KINDS[1:], 1):
        case = case.when(kind == number, built(k))
    made = rows.select("id", case.alias("x"))
    return made.select(F.concat("x.kind", F.lit("-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), "x.text", "x.findings")
