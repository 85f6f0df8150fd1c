"""Training-data operators: PII, packing, dedup, toxicity, decontamination, LM scores, chat, URLs, joins, language ID."""
