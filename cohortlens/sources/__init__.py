"""Typed table sources and sinks."""
from cohortlens.sources.codes import harmonize_codes, unmapped_codes
from cohortlens.sources.tables import DOMAIN_SCHEMAS, TABLE_SCHEMAS, load, write_table

__all__ = ["DOMAIN_SCHEMAS", "TABLE_SCHEMAS", "harmonize_codes", "load", "unmapped_codes", "write_table"]
