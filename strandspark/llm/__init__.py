"""Training-data operators: filters, classifiers, deduplication, mixing, archives and chat formatting."""
