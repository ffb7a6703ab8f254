"""The metric tables wired to concrete inputs, each with an equivalent SQL text."""
