"""Errors of readers and writers."""


class InputError(ValueError):
    """A file that cannot be used, with the line or rule that shows why."""
