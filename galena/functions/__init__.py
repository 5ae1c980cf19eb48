"""Row-level functions on vectors and metadata, as columns."""
