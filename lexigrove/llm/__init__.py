"""Operators for preparing training data: each module is one method, ``queries`` registers them."""
