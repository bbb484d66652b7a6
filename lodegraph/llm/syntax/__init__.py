"""Table-driven parsing of source files from bundled grammars."""
