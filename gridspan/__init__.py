"""Analytics over value grids (entity x period x lane x step) and text corpora, on Spark."""
