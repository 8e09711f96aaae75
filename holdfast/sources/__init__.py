from holdfast.sources.manifest import manifest, manifest_entry, manifest_params
from holdfast.sources.readers import load_csv, load_parquet, load_table, with_file_position, with_row_position
from holdfast.sources.sinks import write_dataset, write_manifest, write_report

__all__ = [
    "load_csv", "load_parquet", "load_table", "manifest", "manifest_entry", "manifest_params",
    "with_file_position", "with_row_position", "write_dataset", "write_manifest", "write_report",
]
