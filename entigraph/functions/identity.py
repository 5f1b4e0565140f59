"""Canonical JSON, hashes and deterministic ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .numbers import let, number_text

#: Stand for an escaped backslash and quote while texts are told from the rest; JSON has no such characters unescaped.
_BACKSLASH, _QUOTE = "\u0001", "\u0002"
_TEXT, _NUMBER = '"[^"]*+"', "-?[0-9][0-9.eE+-]*+"
#: A number that is written as it must be, if it has at most 15 characters: no exponent, no zeros at its ends, not too small.
_SETTLED = r"^(?:0|-?(?:[1-9][0-9]*(?:\.[0-9]*[1-9])?|0\.0{0,5}[1-9](?:[0-9]*[1-9])?))$"
#: Escaped control characters whose number has a letter in it, and no short form.
_LETTERED = [f"\\u00{n:02X}" for n in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))]


def keep_last_keys(spark: SparkSession) -> None:
    """Repeated keys of a JSON object: the last one counts. This is a setting of the session, as Spark has it nowhere else."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parsed_json(raw: Column) -> Column:
    """The value of a JSON text, null if it is malformed; of repeated keys the last one counts."""
    keep_last_keys(SparkSession.active())
    return F.try_parse_json(raw)


def _masked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _number_form(masked: Column) -> Column:
    """Numbers written as doubles; JSON whose numbers are whole and have at most 15 digits is that already."""
    bare = F.regexp_replace(masked, _TEXT, "")
    parts = F.regexp_extract_all(masked, F.lit(f'({_TEXT}|{_NUMBER}|[^"0-9-]++)'), F.lit(1))
    settled = lambda p: (F.length(p) <= 15) & p.rlike(_SETTLED)
    written = F.transform(parts, lambda p: F.when(p.rlike("^[-0-9]") & ~settled(p), number_text(p.try_cast("double"))).otherwise(p))
    return F.when(bare.rlike("[0-9][.eE]|[0-9]{16}"), F.array_join(written, "")).otherwise(masked)


def _too_large(raw: Column, text: Column) -> Column:
    """Whether a number is beyond the doubles: Spark prints it as the text ``Infinity``, which may also be a text."""
    numbers = F.regexp_extract_all(F.regexp_replace(_masked(raw), _TEXT, ""), F.lit(f"({_NUMBER})"), F.lit(1))
    return text.rlike('"-?Infinity"') & F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == float("inf"))


def canonical_json(raw: Column) -> Column:
    """JSON text with keys sorted at every level, without blanks, numbers as the shortest text of their double.

    Equal values have equal texts: ``1e2``, ``100.0`` and ``100`` are one. Null if the JSON is malformed or a number in it
    is beyond the doubles. Halves of surrogate pairs standing alone become ``?``.
    """

    def form(text: Column) -> Column:
        masked = let(_masked(text), _number_form)
        lettered = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c.lower())), _LETTERED, masked)
        plain = F.when(masked.contains("\\u00"), lettered).otherwise(masked)
        whole = F.replace(F.replace(plain, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
        return F.when(~_too_large(raw, text), whole)

    return let(F.to_json(parsed_json(raw)), form)


def json_hash(raw: Column) -> Column:
    return F.sha2(canonical_json(raw), 256)


def stable_id(*parts: Column) -> Column:
    """A deterministic id of its parts, in place of a random one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def key_hash(key: Column) -> Column:
    """Hash under which an access key is stored."""
    return F.sha2(key, 256)


def bearer_key(header: Column) -> Column:
    """The key of an ``Authorization`` header, or null."""
    key = F.regexp_extract(header, r"^(?i:Bearer) +(\S+)$", 1)
    return F.when(key != "", key)
