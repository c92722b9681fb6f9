"""Training-data operators: language ID, de-duplication, decontamination, tokens, chat, PII."""
