"""Operators that prepare text corpora for model training; no other part of the library imports them."""
