"""Retrieval and knowledge analytics over document collections as DataFrame plans."""
