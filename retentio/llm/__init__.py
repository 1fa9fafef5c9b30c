"""Operators for preparing training data at scale; see the README's section on ``llm``.

Nothing else in the library imports this subpackage.
"""
