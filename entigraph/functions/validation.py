"""Validation as columns: each check gives a reason code or null, and the first failing one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import BATCH_RECORDS, MAX_OPERATION_RECORDS, MAX_VERSION, SOURCE_PRIORITY
from ..schemas import ADDRESS_KEYS, COMPANY_KEYS, PERSON_KEYS
from .identity import parsed_json
from .text import normalize_email, strip

UUID4 = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that is not true (null counts as not), or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in checks])


def source_slug(column: Column) -> Column:
    return column.rlike("^[a-z][a-z0-9_-]*$") & (F.length(column) <= 120)


def external_id(column: Column) -> Column:
    return (strip(column) != "") & (F.length(column) <= 255)


def entity_type(column: Column) -> Column:
    return column.isin("person", "company")


def has_identity(kind: Column, data: Column) -> Column:
    """A person needs a name, email or phone; a company one of these, a domain or a registration id."""
    given = lambda k: F.coalesce(strip(data[k]) != "", F.lit(False))
    common = given("name") | given("email") | given("phone")
    return F.when(kind == "person", common).when(kind == "company", common | given("domain") | given("registration_id")).otherwise(F.lit(False))


def lengths(data: Column) -> Column:
    limits = {"name": 200, "email": 320, "phone": 64, "company": 200, "company_domain": 253, "domain": 253, "registration_id": 160}
    ok = F.lit(True)
    for k, n in limits.items():
        ok = ok & F.coalesce(F.length(data[k]) <= n, F.lit(True))
    return ok


def email_syntax(data: Column) -> Column:
    """Approximated by the normalizer."""
    return data["email"].isNull() | normalize_email(data["email"]).isNotNull()


def address_fields(address: Column) -> Column:
    ok = F.lit(True)
    for k, n in {"line1": 200, "line2": 200, "city": 120, "region": 120, "postal_code": 32}.items():
        ok = ok & F.coalesce(F.length(address[k]) <= n, F.lit(True))
    return ok & F.coalesce(F.upper(strip(address["country"])).rlike("^[A-Z]{2}$"), F.lit(True))


def known_keys(kind: Column, raw: Column) -> Column:
    """No key outside the record's and the address's own, and a JSON object at all."""
    keys = F.json_object_keys(raw)
    allowed = F.when(kind == "person", F.array(*map(F.lit, PERSON_KEYS))).otherwise(F.array(*map(F.lit, COMPANY_KEYS)))
    inner = F.json_object_keys(F.to_json(F.try_variant_get(parsed_json(raw), "$.address", "variant")))
    return (F.size(F.array_except(keys, allowed)) == 0) & F.coalesce(F.size(F.array_except(inner, F.array(*map(F.lit, ADDRESS_KEYS)))) == 0, F.lit(True))


def typed_fields(raw: Column) -> Column:
    """Each text field is a JSON text or null, and the address an object of such."""
    value = parsed_json(raw)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant")), F.lit("VOID"))
    ok = kind("address").startswith("OBJECT") | (kind("address") == "VOID")
    for path in [*dict.fromkeys([*PERSON_KEYS, *COMPANY_KEYS]), *[f"address.{k}" for k in ADDRESS_KEYS]]:
        if path not in ("address", "attributes"):
            ok = ok & kind(path).isin("STRING", "VOID")
    return ok


def record_reason(raw: Column, kind: Column, source: Column, external: Column, data: Column, email: Column | None = None) -> Column:
    """``email``: the normalized one, where it is at hand."""
    known_email = email_syntax(data) if email is None else data["email"].isNull() | email.isNotNull()
    return first_reason(
        (raw.rlike(r"^\s*\{"), "INVALID_REQUEST_BODY"),
        (source_slug(source), "INVALID_SOURCE"),
        (external_id(external), "INVALID_EXTERNAL_ID"),
        (entity_type(kind), "INVALID_ENTITY_TYPE"),
        (known_keys(kind, raw), "UNKNOWN_FIELD"),
        (typed_fields(raw), "INVALID_FIELD_TYPE"),
        (has_identity(kind, data), "IDENTITY_REQUIRED"),
        (lengths(data), "FIELD_TOO_LONG"),
        (known_email, "INVALID_EMAIL"),
        (address_fields(data["address"]), "INVALID_ADDRESS"),
    )


def source_reason(name: Column, kind: Column, priority: Column) -> Column:
    return first_reason(
        (source_slug(name), "INVALID_NAME"),
        ((strip(kind) != "") & (F.length(kind) <= 50), "INVALID_TYPE"),
        (F.coalesce(priority, F.lit(SOURCE_PRIORITY)).between(0, 1000), "INVALID_PRIORITY"),
    )


def idempotency_key(column: Column) -> Column:
    return column.rlike("^[\\x21-\\x7e]{1,255}$")


def operation_reason(reason: Column) -> Column:
    return F.length(strip(reason)).between(1, 500)


def version(column: Column, least: int = 0) -> Column:
    return column.between(least, MAX_VERSION)


def merge_reason(target: Column, source_version: Column, target_version: Column, reason: Column) -> Column:
    return first_reason(
        (target.rlike(UUID4), "INVALID_ID"), (version(source_version), "INVALID_VERSION"),
        (version(target_version), "INVALID_VERSION"), (operation_reason(reason), "INVALID_REASON"),
    )


def split_reason(record_ids: Column, event_id: Column, has_ids: Column, has_event: Column, entity_version: Column, reason: Column) -> Column:
    """``has_ids`` and ``has_event`` tell whether the fields were supplied, null or not: exactly one must be."""
    ids_ok = F.size(record_ids).between(1, MAX_OPERATION_RECORDS) & (F.size(F.array_distinct(F.transform(record_ids, F.lower))) == F.size(record_ids)) & F.forall(record_ids, lambda x: x.rlike(UUID4))
    return first_reason(
        (has_ids != has_event, "EXACTLY_ONE_SELECTION"), (F.when(has_ids, ids_ok).otherwise(event_id.rlike(UUID4)), "INVALID_ID"),
        (version(entity_version), "INVALID_VERSION"), (operation_reason(reason), "INVALID_REASON"),
    )


def review_reason(decision: Column, reason: Column, source_version: Column, candidate_version: Column) -> Column:
    return first_reason(
        (decision.isin("APPROVE", "REJECT"), "INVALID_DECISION"), (operation_reason(reason), "INVALID_REASON"),
        (version(source_version, 1), "INVALID_VERSION"), (version(candidate_version), "INVALID_VERSION"),
    )


def batch_reason(positions: DataFrame) -> DataFrame:
    """Batches (tenant_id, job_id) with their size's reason code."""
    return positions.groupBy("tenant_id", "job_id").agg(F.count("*").alias("n")).withColumn("reason", first_reason((F.col("n").between(1, BATCH_RECORDS), "INVALID_BATCH_SIZE")))


def missing_sources(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct (tenant_id, source) that no registry row has."""
    return records.select("tenant_id", "source").distinct().join(registry.select("tenant_id", F.col("name").alias("source")), ["tenant_id", "source"], "left_anti")


def stored_payload(payload: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose stored JSON does not parse: an integrity error wherever one is used."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & parsed_json(F.col(c)).isNull())
    return payload.where(bad)


def stored_operation(kind: Column, record_ids: Column, reason: Column, policy: Column, expected: str) -> Column:
    return first_reason(
        (kind.isin("MERGE", "SPLIT", "UNMERGE"), "OPERATION_INTEGRITY"), (policy == expected, "OPERATION_INTEGRITY"),
        (F.size(record_ids).between(1, MAX_OPERATION_RECORDS) & (F.size(F.array_distinct(record_ids)) == F.size(record_ids)), "OPERATION_INTEGRITY"),
        (F.length(reason) <= 500, "OPERATION_INTEGRITY"),
    )


def stored_provenance(rule: Column, priority: Column, completeness: Column, observed: Column) -> Column:
    rules = ["ONLY_CANDIDATE", "SOURCE_PRIORITY", "COMPLETENESS", "RECENCY", "STABLE_TIE_BREAK"]
    return first_reason(
        (rule.isin(*rules), "PROVENANCE_INTEGRITY"), (priority.between(0, 1000), "PROVENANCE_INTEGRITY"),
        (completeness.between(0, MAX_VERSION), "PROVENANCE_INTEGRITY"), (observed.isNotNull(), "PROVENANCE_INTEGRITY"),
    )


def unit_interval(column: Column) -> Column:
    return column.between(0, 1)
