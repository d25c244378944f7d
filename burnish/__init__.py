"""Burnish: data preparation on Spark, from raw table to model-ready table."""

from burnish.operators.columns import drop_columns
from burnish.operators.compare import compare
from burnish.operators.dates import date_features
from burnish.operators.dedupe import duplicate_report, remove_duplicates
from burnish.operators.dtypes import repair_types
from burnish.operators.encode import encode
from burnish.operators.features import add_features
from burnish.operators.missing import fill_missing, missing_report
from burnish.operators.outliers import outlier_report, treat_outliers
from burnish.operators.profile import profile
from burnish.operators.scale import scale, scaling_report
from burnish.operators.text import text_features
from burnish.operators.validate import quality_gate, validate
from burnish.plans.plan import Plan
from burnish.plans.prepare import prepare
from burnish.sources.catalog import file_catalog, preview
from burnish.sources.readers import read_any, read_csv, read_json_array, read_json_lines, read_parquet, read_text, read_tsv
from burnish.sources.sinks import write_csv, write_output

__all__ = [
    "Plan", "add_features", "compare", "date_features", "drop_columns", "duplicate_report", "encode", "file_catalog",
    "fill_missing", "missing_report", "outlier_report", "prepare", "preview", "profile", "quality_gate", "read_any",
    "read_csv", "read_json_array", "read_json_lines", "read_parquet", "read_text", "read_tsv", "remove_duplicates",
    "repair_types", "scale", "scaling_report", "text_features", "treat_outliers", "validate", "write_csv",
    "write_output",
]
