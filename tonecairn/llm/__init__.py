"""Operators for preparing training text: one module for each, none imported from outside this subpackage."""
