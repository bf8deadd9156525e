"""Training-data operators: token output, HTML extraction, language ID, PII, decontamination,
toxicity, near-duplicates, source mixing and secret scans. Nothing else in ``strata`` imports this."""
