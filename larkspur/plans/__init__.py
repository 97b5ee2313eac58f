"""Text to logical plan: lexer, parser, syntax tree, binder, cost report."""
