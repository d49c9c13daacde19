"""Column functions: text normalisation, similarity, pair arithmetic."""
