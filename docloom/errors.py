"""Errors raised by the engine."""


class DocloomError(Exception):
    """Base of all errors of this package."""


class QueryError(DocloomError):
    """A malformed query, aggregation or index definition."""


class InvalidKeyError(DocloomError):
    """An empty or reserved key."""


class SerializationError(DocloomError):
    """A value that can't be stored, or isn't of the requested type."""


class ConflictError(DocloomError):
    """A commit that lost against another one."""


class ArchiveError(DocloomError):
    """An archive that is damaged, incomplete or not one of ours."""


class ClosedError(DocloomError):
    """Use of an engine or hub after it was closed."""


class SchemaVersionError(DocloomError):
    """A stored schema version that can't be opened as asked."""
