"""Operators that prepare text and code for training; nothing else in the library imports this subpackage."""
