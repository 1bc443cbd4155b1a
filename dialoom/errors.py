"""Errors of the library."""


class EngineError(Exception):
    """Any failure that the library reports itself."""


class ValidationError(EngineError):
    """Input rows or arguments break a rule of their schema."""


class PipelineError(EngineError):
    """A pipeline cannot be put together."""


class ModelError(EngineError):
    """A model is missing, or does not fit its input."""


class RuleError(EngineError):
    """Rule text that cannot be read."""


class ConfigurationError(EngineError):
    """A setting is out of its range."""
