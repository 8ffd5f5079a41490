"""Relational operators over documents, lines, regions, attempts and stores."""
