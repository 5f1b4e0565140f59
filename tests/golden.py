"""Golden pairs. The published records, pair decisions, and labels of the whole pipeline."""

CASES = [
    ("person-email-phone-format-auto-match", "person", {"name": "Abdulkerim Hassen", "email": "abdul@example.com", "phone": "+251911223344"},
     {"name": "  ABDULKERIM   HASSEN ", "email": "abdul@EXAMPLE.COM", "phone": "0911 223 344", "address": {"country": "ET"}}, "AUTO_MATCH", "AUTO_MATCH", 1, True),
    ("person-email-with-missing-phone-auto-match", "person", {"name": "Marta Bekele", "email": "marta@example.com", "phone": "+251911000111"},
     {"name": "Marta B.", "email": "marta@example.com"}, "AUTO_MATCH", "AUTO_MATCH", 1, True),
    ("person-unicode-name-review", "person", {"name": "José Álvarez", "phone": "+34910000001"}, {"name": "Jose Alvarez", "phone": "+34910000002"}, "REVIEW", "NO_MATCH", 0, True),
    ("person-shared-name-no-match", "person", {"name": "John Smith", "email": "john.one@example.com", "phone": "+12025550101"},
     {"name": "John Smith", "email": "john.two@example.com", "phone": "+12025550199"}, "NO_MATCH", "NO_MATCH", 0, False),
    ("company-abbreviation-domain-auto-match", "company", {"name": "Acme Trading PLC", "domain": "acmetrading.example"},
     {"name": "ACME Trading", "domain": "www.acmetrading.example"}, "AUTO_MATCH", "AUTO_MATCH", 1, True),
    ("company-registration-conflict-review", "company", {"name": "Blue Nile Imports", "domain": "bluenile.example", "registration_id": "ET-1001"},
     {"name": "Blue Nile Imports", "domain": "bluenile.example", "registration_id": "ET-9009"}, "REVIEW", "REVIEW", 1, False),
    ("company-common-name-country-no-match", "company", {"name": "Global Services Ltd", "domain": "global-ke.example", "address": {"country": "KE"}},
     {"name": "Global Services Ltd", "domain": "global-gb.example", "address": {"country": "GB"}}, "NO_MATCH", "NO_MATCH", 0, False),
    ("company-renamed-domain-review", "company", {"name": "Rift Valley Logistics", "domain": "riftlogistics.example"},
     {"name": "Rift Transport Group", "domain": "riftlogistics.example"}, "REVIEW", "REVIEW", 1, True),
]
