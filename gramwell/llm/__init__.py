"""Operators for building language-model training data; nothing else in gramwell imports them."""
