"""Tables on storage: versioned Parquet files behind an atomic manifest, catalog, transactions."""
