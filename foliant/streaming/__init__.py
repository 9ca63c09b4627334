"""Room for streaming forms of operators; the query surface has none: no windows, watermarks or state.

The predicates of ``operators.queries`` and the expressions of ``functions`` are plain columns and work on a
streaming DataFrame as they are (see ``tests/test_streaming.py``).
"""
