"""Training-data operators: dedup, decontamination, language models, classifiers, mixing, chat, PII, ANN."""
