"""Deliberate failures."""


class MigrationError(Exception):
    """Base of every failure that the library raises on purpose."""


class SpecError(MigrationError):
    """A spec or config that can't be used; the message lists every fault."""


class TableNotFound(MigrationError):
    pass


class SetupError(MigrationError):
    pass


class LogError(MigrationError):
    """A change log that can't be decoded or applied."""
