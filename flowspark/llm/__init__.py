"""Operators for preparing training text: one module for each operator, with its registered queries in ``queries``."""
