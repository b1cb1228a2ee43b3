"""Operators for preparing training text: one module an operator, and ``queries`` for their registered forms."""
