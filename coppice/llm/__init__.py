"""Operators for preparing language-model training text.

Nothing outside this folder imports it; it can be deleted as a whole.
"""
