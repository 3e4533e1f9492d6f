"""Community similarity on Spark: how alike are two communities' texts, authors and metadata."""
