"""Table schemas of the inventory (DDL strings for ``StructType.fromDDL``)."""

from pyspark.sql.types import StructType

DOMAINS_DDL = (
    "domain STRING, registrar STRING, status STRING, expiry_date DATE, "
    "discovery_date DATE, last_seen DATE, raw_data STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
DOMAIN_KEY = ["domain", "registrar"]

DNS_DDL = (
    "domain STRING, subdomain STRING, record_type STRING, data STRING, ttl INT, "
    "priority INT, source STRING, status STRING, discovery_date DATE, "
    "last_seen DATE, raw_data STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
DNS_KEY = ["domain", "subdomain", "record_type", "data", "source"]

RUN_LOG_DDL = (
    "run_id STRING, collector_name STRING, service_type STRING, status STRING, "
    "started_at TIMESTAMP, completed_at TIMESTAMP, records_found INT, "
    "records_added INT, records_updated INT, records_removed INT, "
    "error_message STRING, trigger_type STRING, event_seq BIGINT"
)

REMOVED_DDL = (
    "asset_type STRING, name STRING, provider STRING, details STRING, "
    "discovery_date DATE, removed_date DATE, status STRING"
)

# Landed provider responses.
GODADDY_DOMAIN_PAGE_DDL = "ARRAY<STRUCT<domain: STRING, expires: STRING>>"
GODADDY_RECORD_PAGE_DDL = (
    "ARRAY<STRUCT<name: STRING, type: STRING, data: STRING, ttl: DOUBLE, priority: DOUBLE>>"
)
CLOUDFLARE_ENVELOPE_DDL = (
    "success BOOLEAN, result ARRAY<STRING>, "
    "result_info STRUCT<page: INT, per_page: INT, total_pages: INT, count: INT, total_count: INT>, "
    "errors ARRAY<STRUCT<code: INT, message: STRING>>"
)

METADATA_DDL = (
    "services MAP<STRING, STRUCT<name: STRING, provider: STRING, schedule: STRING, "
    "last_updated: STRING, services: MAP<STRING, STRUCT<last_updated: STRING, count: BIGINT>>>>, "
    "last_updated STRING"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
