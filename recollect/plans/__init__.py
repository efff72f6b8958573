"""Composite queries: retrieval strategies, packing plans and studies."""
