"""Registered queries with their oracles, and the panel that they run over."""
