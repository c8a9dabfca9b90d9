"""Errors raised on the driver before any job starts."""


class SpecError(ValueError):
    """The specification asks for something that cannot be planned."""
