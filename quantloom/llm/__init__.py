"""Training-data operators: scoring, deduplication, decontamination, pseudonyms and mixing."""
