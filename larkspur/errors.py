"""One hierarchy for all errors of the engine."""


class EngineError(Exception):
    """Base of everything that the engine raises on its own."""


class SyntaxProblem(EngineError):
    """The statement is not in the dialect; carries the position in the text."""

    def __init__(self, message: str, position: int) -> None:
        super().__init__(f"{message} at position {position}")
        self.position = position


class BindError(EngineError):
    """A table, column or value does not fit the catalog."""


class CatalogError(EngineError):
    """A definition cannot be added: it exists already or refers to nothing."""


class TransactionError(EngineError):
    """A lock could not be had, or somebody else has committed meanwhile."""


class ClosedError(EngineError):
    """The connection, statement or result set was closed."""


class TransportError(EngineError):
    """The server cannot be reached or its answer cannot be read."""
