"""Training-data operators: quality rules, dedup, archives, tokens, packing, classifier, nearest neighbours."""
