"""Query text to plan: lexer, parser, syntax tree, compiler."""
