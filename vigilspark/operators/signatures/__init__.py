"""Signature rules as text: parser, strings, conditions, and the matcher that runs whole packs over files."""
