from cardwatch.sources.ingest import ingest_csv_folder, ingest_metrics, read_raw
from cardwatch.sources.lookups import read_json_map, read_zip_centroids
from cardwatch.sources.months import MonthTable
from cardwatch.sources.sinks import with_column_comments, write_by_month, write_clustered, write_interleaved
from cardwatch.sources.snapshots import DimensionTable, SnapshotTable

__all__ = [
    "DimensionTable",
    "MonthTable",
    "SnapshotTable",
    "ingest_csv_folder",
    "ingest_metrics",
    "read_json_map",
    "read_raw",
    "read_zip_centroids",
    "with_column_comments",
    "write_by_month",
    "write_clustered",
    "write_interleaved",
]
