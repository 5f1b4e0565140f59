"""Normalizers: columns in, columns out. Only rows with non-ASCII characters reach Python."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..policy import LEGAL_SUFFIXES, NAME_PREFIX, PHONE_RULES, SPACES
from ..schemas import ADDRESS_KEYS

_WIDE = "[^\\x00-\\x7F]"


@pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


#: Labels that the standard leaves as they are.
_PLAIN_LABEL = re.compile(r"(?!..--)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")


@lru_cache(maxsize=1 << 16)
def _encoded(host: str) -> str | None:
    """A host or label by the standard; any that it rejects is no domain."""
    try:
        import idna

        return idna.encode(host, uts46=True).decode()
    except Exception:
        return None


def _encoded_host(host: str | None) -> str | None:
    """Label by label, as most hosts differ in plain labels alone; as a whole where a label might not stand for itself."""
    if host is None:
        return None
    labels = [x if _PLAIN_LABEL.fullmatch(x) else "" if x.isascii() or len(x) > 63 else _encoded(x) for x in host.split(".")]
    if len(host) > 253 or not all(x and "." not in x for x in labels):
        return _encoded(host)
    return ".".join(labels) if sum(map(len, labels)) + len(labels) <= 254 else None


@pandas_udf(StringType())
def _punycode(hosts: pd.Series) -> pd.Series:
    return hosts.map(_encoded_host)


def _wide_only(column: Column, function) -> Column:
    """``function`` of the rows with non-ASCII characters; the others never leave the JVM with a value."""
    return F.coalesce(function(F.when(column.rlike(_WIDE), column)), F.when(column.rlike(_WIDE), F.lit(None)).otherwise(column))


def strip(column: Column) -> Column:
    """Without leading and trailing white space of the record format."""
    return F.regexp_replace(column, f"^[{SPACES}]+|[{SPACES}]+$", "")


def collapse_whitespace(column: Column) -> Column:
    """Display form: stripped, runs of white space as one blank."""
    return F.regexp_replace(strip(column), f"[{SPACES}]+", " ")


def present_string(column: Column) -> Column:
    """The value unchanged, or null if it is blank."""
    return F.when(strip(column) != "", column)


def code_point_length(column: Column) -> Column:
    return F.length(column)


def normalize_text(column: Column, wide: bool = True) -> Column:
    """Compatibility form, collapsed; blank is null. ``wide=False`` leaves non-ASCII as it is and stays in the JVM."""
    text = _wide_only(column, _compatible) if wide else column
    text = collapse_whitespace(text)
    return F.when(text != "", text)


def normalize_name(column: Column, wide: bool = True) -> Column:
    return F.lower(normalize_text(column, wide))


def normalize_domain(column: Column, wide: bool = True) -> Column:
    """A bare host or an http(s) URL without more than a host; one leading ``www.`` and trailing dots go."""
    return _domain(_host(F.lower(normalize_text(column, wide)), wide))


def _host(text: Column, wide: bool) -> Column:
    host = _url_host(text)
    return _bare(_wide_only(host, _punycode) if wide else host)


def _url_host(text: Column) -> Column:
    # A URL may end in an empty query or fragment, a bare host may not.
    host = F.regexp_extract(text, r"^(?:(?=[^?#]*$)|(?=https?://))(?:https?://)?([^/?#@:\\\s]+)/?\??#?$", 1)
    return F.when(host.contains("%"), F.lower(F.try_url_decode(host))).otherwise(host)


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")


def _domain(host: Column) -> Column:
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    fits = host.rlike(rf"^{label}(?:\.{label})+$") & (F.length(host) <= 253) & ~host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$")
    return F.when(fits, host)


def normalize_email(column: Column, wide: bool = True) -> Column:
    """Local part as it is, domain normalized; one ``@``, at most 64 and 320 characters."""
    text = normalize_text(column, wide)
    return _email(text, normalize_domain(F.get(F.split(text, "@"), F.lit(1)), wide))


def with_email(rows: DataFrame, column: Column, name: str, wide: bool = True) -> DataFrame:
    """``normalize_email`` as the column ``name``, step by step: each step is a column, so that none is made anew."""
    rows = rows.withColumn("_mail", normalize_text(column, wide))
    rows = rows.withColumn("_mail_host", _url_host(F.lower(F.get(F.split("_mail", "@"), F.lit(1)))))
    if wide:
        rows = rows.withColumn("_mail_host", _wide_only(F.col("_mail_host"), _punycode))
    rows = rows.withColumn("_mail_host", _bare(F.col("_mail_host")))
    return rows.withColumn(name, _email(F.col("_mail"), _domain(F.col("_mail_host")))).drop("_mail", "_mail_host")


def _email(text: Column, domain: Column) -> Column:
    local = F.get(F.split(text, "@"), F.lit(0))
    fits = (F.size(F.split(text, "@")) == 2) & (F.length(local) <= 64) & local.rlike(r"^[A-Za-z0-9!#$%&'*+\-/=?^_{|}~]+(?:\.[A-Za-z0-9!#$%&'*+\-/=?^_{|}~]+)*$")
    email = F.concat(local, F.lit("@"), domain)
    return F.when(fits & (F.length(email) <= 320), email)


def normalize_phone(column: Column, country: Column | None = None, wide: bool = True) -> Column:
    """E.164 by the declared rules: an international number by its code, a national one by its country; else null."""
    text = normalize_text(column, wide)
    return _phone(text, F.regexp_replace(text, "[^0-9]", ""), country)


def _phone(text: Column, digits: Column, country: Column | None) -> Column:
    form = text.rlike(r"^\+?[0-9 ().\-/]+$")
    codes = "|".join(dict.fromkeys(f"{code}{national}" for _, code, _, national in PHONE_RULES))
    international = F.when(digits.rlike(f"^(?:{codes})$"), F.concat(F.lit("+"), digits))
    national = F.lit(None).cast("string")
    if country is not None:
        place = F.upper(strip(country))
        for name, code, trunk, number in PHONE_RULES:
            bare = F.regexp_extract(digits, f"^(?:{trunk})?({number})$" if trunk else f"^({number})$", 1)
            national = F.coalesce(national, F.when((place == name) & (bare != ""), F.concat(F.lit("+" + code), bare)))
    return F.when(form, F.when(text.startswith("+"), international).otherwise(national))


def normalize_company_name(column: Column, wide: bool = True) -> Column:
    """struct(full, base, legal_suffix): the last word is split off if it is a legal suffix and leaves a name."""
    return _company(normalize_name(column, wide))


def _company(full: Column) -> Column:
    pattern = f"^(.*[^, ])[, ]* ({'|'.join(sorted(LEGAL_SUFFIXES, key=len, reverse=True))})\\.?$"
    base, suffix = F.regexp_extract(full, pattern, 1), F.regexp_extract(full, pattern, 2)
    return F.when(full.isNotNull(), F.struct(full.alias("full"), F.when(base != "", base).otherwise(full).alias("base"), F.when(base != "", suffix).alias("legal_suffix")))


def normalize_country(column: Column, wide: bool = True) -> Column:
    code = F.upper(normalize_text(column, wide))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def normalize_address(address: Column, wide: bool = True) -> Column:
    """struct of the six parts, or null if none is left."""
    names = [normalize_name(address[k], wide).alias(k) for k in ("line1", "line2", "city", "region")]
    parts = [*names, F.upper(normalize_text(address["postal_code"], wide)).alias("postal_code"), normalize_country(address["country"], wide).alias("country")]
    return F.when(F.coalesce(*parts).isNotNull(), F.struct(*parts))


def name_prefix(name: Column, size: int = NAME_PREFIX) -> Column:
    return F.substring(name, 1, size)


def registration_id(column: Column, wide: bool = True) -> Column:
    return F.lower(normalize_text(column, wide))


def normalize_records(records: DataFrame, wide: bool = True) -> DataFrame:
    """Add ``normalized`` to records (entity_type, data): one wide struct for both types.

    ``name`` is a person's name or a company's full name; ``company`` parts are a person's company or the company itself.
    A person's ``company_domain`` and a company's ``domain`` share ``domain``. Texts are cleaned in a projection of their
    own, so that what follows reads them as columns.
    """
    data, person = F.col("data"), F.col("entity_type") == "person"
    text = lambda c: normalize_text(c, wide)
    clean = {
        "_name": text(data["name"]), "_company": text(F.when(person, data["company"]).otherwise(data["name"])), "_email": text(data["email"]),
        "_phone": text(data["phone"]), "_domain": F.lower(text(F.when(person, data["company_domain"]).otherwise(data["domain"]))),
        "_registration": text(F.when(~person, data["registration_id"])), **{f"_{k}": text(data["address"][k]) for k in ADDRESS_KEYS},
    }
    rows = records.withColumns(clean)
    rows = rows.withColumns({
        "_host": _url_host(F.col("_domain")), "_mail_host": _url_host(F.lower(F.get(F.split("_email", "@"), F.lit(1)))), "_company": _company(F.lower("_company")),
        "_country": F.when(F.upper("_country").rlike("^[A-Z]{2}$"), F.upper("_country")), "_place": F.upper(strip(data["address"]["country"])), "_digits": F.regexp_replace("_phone", "[^0-9]", ""),
    })
    hosts = ("_host", "_mail_host")
    if wide:
        rows = rows.withColumns({h: _wide_only(F.col(h), _punycode) for h in hosts})
    rows = rows.withColumns({h: _bare(F.col(h)) for h in hosts})
    parts = [*[F.lower(f"_{k}").alias(k) for k in ("line1", "line2", "city", "region")], F.upper("_postal_code").alias("postal_code"), F.col("_country").alias("country")]
    some = F.coalesce(*[F.col(f"_{k}") for k in ADDRESS_KEYS])
    rows = rows.withColumn("_name", F.when(person, F.lower("_name")).otherwise(F.col("_company.full")))
    normalized = F.struct(
        F.col("_name").alias("name"), F.col("_company.full").alias("company_full"), F.col("_company.base").alias("company_base"),
        F.col("_company.legal_suffix").alias("legal_suffix"), _email(F.col("_email"), _domain(F.col("_mail_host"))).alias("email"),
        _phone(F.col("_phone"), F.col("_digits"), F.col("_place")).alias("phone"), _domain(F.col("_host")).alias("domain"),
        F.when(some.isNotNull(), F.struct(*parts)).alias("address"), F.lower("_registration").alias("registration_id"), name_prefix(F.col("_name")).alias("name_prefix"),
    )
    temporary = [*clean, "_host", "_mail_host", "_place", "_digits"]
    return rows.withColumn("normalized", normalized).drop(*temporary)
