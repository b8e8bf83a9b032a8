"""Column functions: time, side, price and exact decimals, and the folds of technical indicators."""
