"""The stateless operators over streams of documents."""
