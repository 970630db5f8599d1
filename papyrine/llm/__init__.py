"""Operators for text that trains language models. Nothing outside this folder imports it."""
