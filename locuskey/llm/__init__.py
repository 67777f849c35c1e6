"""Training-data operators: WARC archives, classifiers, deduplication, packing, search and tokenizing."""
