"""Errors: bad arguments are ValueError, everything the engine itself refuses is EngineError."""


class EngineError(RuntimeError):
    """The engine could not do what was asked: missing table, damaged log, dead row."""
