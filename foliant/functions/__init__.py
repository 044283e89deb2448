"""Pure functions: text and XML grammars in Python, and column expressions."""
