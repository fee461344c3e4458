from bitextkit.sources.readers import (  # noqa: F401
    read_parallel_csv, csv_quality, load_parallel, read_triplets, read_line_pairs, read_ledger,
    scrape_metric, scrape_metric_value, with_row_ids, PANDAS_DEFAULT_NA,
)
from bitextkit.sources.sinks import (  # noqa: F401
    write_csv, write_triplets, write_metrics, metrics_json, write_funnel, write_split,
)
