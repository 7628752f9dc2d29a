"""What can go wrong, by cause."""


class EngineError(Exception):
    """Base of all errors of this package."""


class EmptyLink(EngineError):
    """Two ends of a link have no format in common."""


class Unfixable(EngineError):
    """A link's format stays open, such as a CRS that nobody states."""


class InvalidGraph(EngineError):
    """Wrong number of inputs, or an unknown node."""


class SourceError(EngineError):
    """A source has no data, or data of the wrong form."""


class ComputeError(EngineError):
    """An operator was given parameters that do not fit its input."""


class ProjectionError(EngineError):
    """No transform between two CRSs."""


class KindError(EngineError):
    """A node gives another kind of data than is asked for."""


class PullTooLarge(EngineError):
    """A window touches more tiles than a pull may."""
