"""What can go wrong in a run, under one base."""


class LineageError(Exception):
    """A run can't be made, or a part of it."""


class SourceError(LineageError):
    """A source can't answer."""


class OverBudget(SourceError):
    """The requests of a run are used up."""


class ReplyError(LineageError, ValueError):
    """A model's reply can't be used."""
