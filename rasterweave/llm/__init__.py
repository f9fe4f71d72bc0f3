"""Training-data preparation: sharding, search, deduplication, filters, tokens and scoring over text tables."""
