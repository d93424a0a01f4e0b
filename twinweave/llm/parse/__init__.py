"""Syntax checking with table-driven parsers generated from bundled grammars."""
