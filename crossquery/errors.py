"""What can be wrong with a plan, a source, or the rows of a guarded relation."""


class PlanError(ValueError):
    """The plan is malformed or asks for something that is not supported; nothing degrades silently."""


class SourceError(LookupError):
    """A source is unknown, of an unknown kind, or lacks a parameter."""


class CardinalityError(RuntimeError):
    """A guarded relation has more rows than it may have."""
