"""The stateful streaming form of pairing."""
