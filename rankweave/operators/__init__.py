"""Relational operators over games, series and ratings."""
