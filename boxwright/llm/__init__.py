"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries only when it is there.
"""
