"""tessera - customer segmentation and churn features on Spark DataFrames."""

from tessera.operators.features import feature_matrix, fit_scaler, recommend_features
from tessera.operators.insights import describe_segments, export_results
from tessera.operators.profile import analysis, preview, profile, profile_summary
from tessera.plans.churn_store import activity_features, churn_features
from tessera.plans.segmentation import SegmentResult, run_record, segment
from tessera.sources.csv_files import read_csv, write_csv
from tessera.sources.json_files import read_json, write_json
from tessera.sources.run_store import RunStore

__all__ = [
    "RunStore",
    "SegmentResult",
    "activity_features",
    "analysis",
    "churn_features",
    "describe_segments",
    "export_results",
    "feature_matrix",
    "fit_scaler",
    "preview",
    "profile",
    "profile_summary",
    "read_csv",
    "read_json",
    "recommend_features",
    "run_record",
    "segment",
    "write_csv",
    "write_json",
]
