"""Operators for building training corpora; the rest of the library does not import them."""
