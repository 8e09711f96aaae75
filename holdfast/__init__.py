"""Evaluation audits on Spark."""

from holdfast.plans.report import Report, audit, audit_manifest
from holdfast.table import AuditTable, DatasetError, audit_table, clamp_threshold, ignore_list

__all__ = [
    "AuditTable", "DatasetError", "Report", "audit", "audit_manifest", "audit_table",
    "clamp_threshold", "ignore_list",
]
