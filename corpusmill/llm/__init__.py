"""Training-data operators: search, deduplication, filtering, mixing and packing of documents."""
