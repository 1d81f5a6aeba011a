"""Training-data operators on Spark: dedup, quality, decontamination, tokens, archives, chat."""
