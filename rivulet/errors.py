"""Errors of the engine."""


class EngineError(Exception):
    """Base of all."""


class ConfigError(EngineError):
    """A configuration that can't be built."""


class ReadError(EngineError):
    """A source or payload that can't be read."""


class ProcessError(EngineError):
    """A processor that can't do its work."""


class QueryError(ProcessError):
    """A query that isn't one SELECT, or that the dialect can't express."""


class Unavailable(ConfigError):
    """A connector whose client library or Spark package isn't installed."""
