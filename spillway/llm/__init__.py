"""Operators for preparing text corpora; nothing outside this folder imports them."""
