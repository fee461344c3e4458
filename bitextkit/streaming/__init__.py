from bitextkit.streaming.clean_stream import (  # noqa: F401
    label_stream, clean_stream, funnel_counts_stream, dedup_stream,
)
