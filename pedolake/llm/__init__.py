"""Training-data operators over text, embedding and benchmark tables."""
