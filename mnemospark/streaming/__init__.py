"""streaming of mnemospark."""
