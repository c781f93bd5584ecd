"""Training-data operators: personal data, toxicity, duplicates, mixing, quality, chat, language, HTML, pieces."""
