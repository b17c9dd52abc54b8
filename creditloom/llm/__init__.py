"""Operators for preparing training text: ten methods and their registered queries."""
