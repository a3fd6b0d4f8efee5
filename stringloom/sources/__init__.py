"""Where encoded columns are kept: Parquet folders and packed blobs."""
