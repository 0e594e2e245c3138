"""Training-data operators: quality, decontamination, PII, language, WARC, LM scoring, mixing, and three kinds of dedup."""
