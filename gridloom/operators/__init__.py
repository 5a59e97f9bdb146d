"""Operators over DataFrames: parse, chunk, summarize, index, retrieve, route, evaluate."""
