"""What can go wrong as a whole; what is wrong with one file, sheet or record comes out as a row instead."""


class ValidationError(Exception):
    """Any error of this library."""


class FileReadError(ValidationError):
    """A path that has no file."""


class ProcessingError(ValidationError):
    """Steps that do not fit together."""


class StructureDetectionError(ValidationError):
    """Cells that are no grid."""


class CleaningError(ValidationError):
    """Values that can't be cleaned."""


class ParsingError(ValidationError):
    """Text that has no meaning in its format."""


class ConfigurationError(ValidationError):
    """A setting that is unknown or out of its range."""
