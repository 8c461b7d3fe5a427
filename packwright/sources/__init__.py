"""Reading tables and writing packages."""

from packwright.sources.footers import footer_counts, footer_profile, zone_map
from packwright.sources.package import (
    DESCRIPTOR_KEY,
    annotate,
    make_dir,
    pack_catalog,
    pack_read,
    pack_write,
    read_descriptor,
)
from packwright.sources.records import BadRecords, CsvRecords, read_csv_records
from packwright.sources.readers import audit_sizes, file_size_audit, load, read_csv, read_parquet

__all__ = [
    "BadRecords", "CsvRecords", "DESCRIPTOR_KEY", "annotate", "audit_sizes", "file_size_audit", "footer_counts",
    "footer_profile", "load", "make_dir", "pack_catalog", "pack_read", "pack_write", "read_csv", "read_csv_records", "read_descriptor", "read_parquet",
    "zone_map",
]
