"""Corpus preparation for language-model training: ten operators over document tables, one module each.

Every module holds the operator with its own interface, the thin registered query `opN_<name>` and, where SQL can
express it, the query's DuckDB text. `registry` gathers them; nothing outside this folder imports it but the entry file
and `corpus_pipeline`.
"""
