"""sources of mnemospark."""
