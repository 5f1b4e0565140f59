"""Record shapes, as DDL."""

ADDRESS = "struct<line1:string,line2:string,city:string,region:string,postal_code:string,country:string>"
PERSON_DATA = f"struct<name:string,email:string,phone:string,company:string,company_domain:string,address:{ADDRESS},attributes:string>"
COMPANY_DATA = f"struct<name:string,domain:string,email:string,phone:string,registration_id:string,address:{ADDRESS},attributes:string>"
#: Both at once: a person has company and company_domain, a company domain and registration_id.
DATA = f"struct<name:string,email:string,phone:string,company:string,company_domain:string,domain:string,registration_id:string,address:{ADDRESS},attributes:string>"
#: What ``functions.text.normalize_records`` makes of DATA.
NORMALIZED = f"struct<name:string,company_full:string,company_base:string,legal_suffix:string,email:string,phone:string,domain:string,address:{ADDRESS},registration_id:string,name_prefix:string>"
ENVELOPE = "tenant_id string, source string, external_id string, entity_type string, arrival_seq bigint, raw string"

PERSON_KEYS = ["name", "email", "phone", "company", "company_domain", "address", "attributes"]
COMPANY_KEYS = ["name", "domain", "email", "phone", "registration_id", "address", "attributes"]
ADDRESS_KEYS = ["line1", "line2", "city", "region", "postal_code", "country"]
