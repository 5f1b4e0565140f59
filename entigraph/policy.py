"""Versioned policies: weights, thresholds and limits that every derived row depends on."""

# Policy names, weights and limits that results must carry or equal.
NORMALIZATION = "normalization-v1"
BLOCKING = "blocking-v1"
FEATURES = "features-v1"
SCORING = "rules-0.1.0"
SURVIVORSHIP = "canonicalization-v1"
OPERATIONS = "entity-operations-v1"
REVIEW = "review-v1"

PERSON, COMPANY = "person", "company"
AUTO_MATCH, REVIEW_DECISION, NO_MATCH = "AUTO_MATCH", "REVIEW", "NO_MATCH"

WEIGHTS = {"email": 0.40, "phone": 0.25, "name": 0.20, "company": 0.10, "location": 0.05}
AUTO_THRESHOLD, REVIEW_THRESHOLD = 0.92, 0.72
WARNING_PENALTY = 0.15

#: Blocking passes in order of priority.
SIGNALS = ["EXACT_EMAIL", "EXACT_PHONE", "COMPANY_DOMAIN", "NAME_LOCATION"]
MAX_CANDIDATES, MAX_CANDIDATES_LIMIT = 100, 1000
NAME_PREFIX = 64

MAX_OPERATION_RECORDS = 1000
MAX_VERSION = 2147483647
BATCH_RECORDS = 100
JOB_ATTEMPTS = 3
UNFINISHED_JOBS = ["QUEUED", "RUNNING", "RETRYING"]
DUE_JOBS, DISPATCH_SECONDS = 25, 5
PAGE_LIMIT, PAGE_DEFAULT = 100, 25
SOURCE_PRIORITY = 100

LEGAL_SUFFIXES = ["plc", "ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation", "co", "company"]

#: White space as the record format defines it (a Unicode set of its own).
SPACES = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"

#: Country, calling code, trunk prefix, national number. Partial: only what the published examples pin down, and a few.
PHONE_RULES = [
    ("ET", "251", "0", "[1-9][0-9]{8}"),
    ("ES", "34", "", "[5-9][0-9]{8}"),
    ("US", "1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"),
    ("CA", "1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"),
    ("GB", "44", "0", "[1-9][0-9]{8,9}"),
    ("KE", "254", "0", "[1-9][0-9]{8}"),
    ("FR", "33", "0", "[1-9][0-9]{8}"),
    ("DE", "49", "0", "[1-9][0-9]{5,10}"),
]


def max_candidates(value: int | None = None) -> int:
    """The candidate cap, checked."""
    n = MAX_CANDIDATES if value is None else value
    if not 1 <= n <= MAX_CANDIDATES_LIMIT:
        raise ValueError(f"the candidate cap must be 1 to {MAX_CANDIDATES_LIMIT}")
    return n


def page_limit(value: int | None = None) -> int:
    n = PAGE_DEFAULT if value is None else value
    if not 1 <= n <= PAGE_LIMIT:
        raise ValueError(f"a page has 1 to {PAGE_LIMIT} rows")
    return n
