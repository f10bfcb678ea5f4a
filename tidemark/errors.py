"""What can go wrong with a dataset, beside the standard exceptions."""


class TidemarkError(Exception):
    """Base of this package's errors."""


class CorruptionError(TidemarkError):
    """A control record or an owned path is not as it must be; nothing is guessed."""


class UnsupportedFormatError(TidemarkError):
    """The folder belongs to another format or kind."""


class ConflictError(TidemarkError):
    """The dataset is at another revision than the caller expects."""


class RecoveryRequiredError(TidemarkError):
    """An operation was interrupted; recover before anything else."""


class NoRollbackError(TidemarkError):
    """There is no publication to undo."""
