"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; its queries are gathered in
:mod:`leafmill.llm.queries`.
"""
