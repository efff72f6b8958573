"""Operators over turns, facts and evaluation rows, as DataFrame functions."""
