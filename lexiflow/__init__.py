"""Morphological analysis and corpus preparation as DataFrame plans."""
