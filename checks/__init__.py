"""Checks of the engine: input views, registered queries and their SQL counterparts."""
