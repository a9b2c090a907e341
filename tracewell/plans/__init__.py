"""Registered queries over the shared tables and their SQL counterparts."""
