"""Changes of keyed tables, and relations kept up to date by micro-batches."""
