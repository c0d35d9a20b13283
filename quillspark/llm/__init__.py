"""Training-data operators: deduplication, quality, filtering, sharding, packing and scanning of text corpora."""
