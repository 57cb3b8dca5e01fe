"""Binary block streams, dictionary and basis files, generated signals."""
