"""Whole workflows: validating datasets, exporting packages and reporting."""

from packwright.plans.export import ExportRefused, export_package
from packwright.plans.publish import Published, publish
from packwright.plans.report import findings_report, inconsistency_sink
from packwright.plans.validate import Dataset, data_findings, validate_all, with_level

__all__ = [
    "Dataset", "ExportRefused", "Published", "data_findings", "export_package", "findings_report",
    "inconsistency_sink", "publish", "validate_all", "with_level",
]
