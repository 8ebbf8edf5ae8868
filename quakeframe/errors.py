"""Errors raised when a plan is built, and warnings for arguments outside the reference conditions.

What depends on data is checked at run time (raise_error) or shown in flag columns.
"""


class GroundMotionError(ValueError):
    """Base of the package's errors."""


class InvalidAccelerationError(GroundMotionError):
    """Wrong component count or a sample that is not finite."""


class InsufficientDataError(GroundMotionError):
    """Fewer samples than the duration rule needs."""


class UnstableFilterError(GroundMotionError):
    """A pole on or outside the unit circle."""


class DataFormatError(GroundMotionError):
    """A malformed record, trace or download."""


class GroundMotionWarning(UserWarning):
    """Base of the package's warnings."""


class NonstandardSamplingRateWarning(GroundMotionWarning):
    """A rate other than 100 Hz, or a corner frequency at or above Nyquist."""


class NonstandardProcessingWarning(GroundMotionWarning):
    """Processing outside the reference conditions."""


class MissingComponentWarning(GroundMotionWarning):
    """One or two components where three are usual."""


class FractionalDurationWarning(GroundMotionWarning):
    """A duration that isn't a whole number of samples."""
