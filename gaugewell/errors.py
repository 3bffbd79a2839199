"""Errors raised when an audit cannot be carried out on the given input."""


class AuditError(ValueError):
    """The table or the arguments cannot be audited."""


class TargetError(AuditError):
    """The target column is missing, ambiguous or unusable."""


class TrainingError(AuditError):
    """Baseline training cannot produce a result."""
