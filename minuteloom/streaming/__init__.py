"""An extension: incremental ingestion with Structured Streaming."""
