"""DataFrame operators over documents, blocks, packages and rules."""
