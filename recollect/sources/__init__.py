"""Readers that turn conversation files into DataFrames."""
