"""Operators for preparing training corpora; nothing outside imports this subpackage."""
