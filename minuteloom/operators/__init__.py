"""Relational operators over councils, meetings and materials."""
