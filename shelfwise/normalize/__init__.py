"""Normalisation of captured payloads into product rows."""
