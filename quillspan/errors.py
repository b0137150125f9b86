"""Coded errors: every refusal names what was asked for and can't be done."""


class EngineError(Exception):
    """Base of all refusals; ``code`` is stable, ``path`` says where in the request."""

    def __init__(self, code: str, message: str = "", path: str = ""):
        self.code, self.path = code, path
        super().__init__(f"{code}: {message}" + (f" (at {path})" if path else ""))


class DefinitionError(EngineError):
    """A definition that can't be used."""


class RequestError(EngineError):
    """A request that can't be run."""


class DocumentError(EngineError):
    """A document or change that can't be taken in."""
