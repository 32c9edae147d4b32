from skewprobe.sources.flows import merge_by_name, read_flows, trim_header
from skewprobe.sources.sets import (
    export_labels,
    load_groups,
    load_index,
    load_vectors,
    load_warmup,
    load_workload,
    select_workload,
    workload_table,
    write_clean,
    write_index,
    write_sets,
    write_vectors,
    write_workloads,
)

__all__ = [
    "export_labels",
    "load_groups",
    "load_index",
    "load_vectors",
    "load_warmup",
    "load_workload",
    "merge_by_name",
    "read_flows",
    "select_workload",
    "trim_header",
    "workload_table",
    "write_clean",
    "write_index",
    "write_sets",
    "write_vectors",
    "write_workloads",
]
