"""Lexers, bundled grammars and a table-driven chart parser for six file kinds."""
