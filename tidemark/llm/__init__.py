"""Operators over the text corpus. Nothing outside this subpackage imports it."""
