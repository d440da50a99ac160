"""cairn: DataFrame operators for listing-style data, the places around it and the articles about it."""
