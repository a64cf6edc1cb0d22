"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each operator lives in its own module with a general
interface; :mod:`contractlens.llm.queries` derives the registered ``opN_`` queries from them.
"""
