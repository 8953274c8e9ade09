"""Operators on text for training language models. Nothing outside this subpackage imports it."""
