"""Conditions over the graph as plain objects, and the DataFrames that answer them."""
