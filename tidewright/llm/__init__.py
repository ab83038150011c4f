"""Text operators: tokenizer encoding, source mixing, subject assignment."""
