"""Text and vector operators for training data: sentences, pieces, tokens, packing, languages, neighbours."""
