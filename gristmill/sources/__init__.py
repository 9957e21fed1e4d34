"""Readers and writers: CSV, XLSX, Parquet, policy documents, reports."""

from .documents import load_policy_json, load_v02_json, load_warning_json
from .report import ReportArtifact, write_report
from .tables import load_csv, load_excel, load_parquet

__all__ = ["ReportArtifact", "load_csv", "load_excel", "load_parquet", "load_policy_json", "load_v02_json", "load_warning_json", "write_report"]
