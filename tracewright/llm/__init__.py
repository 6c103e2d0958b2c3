"""Training-data operators: each takes and returns DataFrames; see the README for the list.

Nothing outside this folder imports it.
"""
