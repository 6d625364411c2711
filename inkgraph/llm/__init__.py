"""Operators for preparing training data from case texts; nothing outside this folder imports them."""
