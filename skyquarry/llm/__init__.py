"""Operators for text: canonical names, tokenizer ids, mixtures and subjects. Nothing outside imports this."""
