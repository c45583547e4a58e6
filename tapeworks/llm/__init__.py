"""Training-data operators: sharding, language ID, deduplication, decontamination,
personal data, archives, packing and quality rules. Nothing else in the library imports this."""
