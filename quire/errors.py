"""Errors a user can act on. Errors of one file become rows of an ingest report."""


class QuireError(Exception):
    """Base of all."""


class CourseNotFound(QuireError):
    """The folder is missing or is a file."""


class NoDocuments(QuireError):
    """The folder holds nothing readable."""


class UnsupportedFormat(QuireError):
    """No reader takes the extension."""


class EmbeddingFailed(QuireError):
    """All attempts failed, or the counts differ."""


class IndexMissing(QuireError):
    """A read of an index that does not exist."""


class IndexMismatch(QuireError):
    """The stored profile differs from the live one."""

    def __init__(self, differing: dict[str, tuple]):
        self.differing = differing
        super().__init__("index built with other settings: " + "; ".join(f"{k}: stored {a!r}, now {b!r}" for k, (a, b) in sorted(differing.items())) + "; rebuild it")


class IndexConflict(QuireError):
    """Another writer changed the index in the meantime; try again."""


class ExtractionFailed(QuireError):
    """A reader failed on a file."""


class EmptyExtraction(QuireError):
    """All pages of a file are blank, as in scans."""


class GenerationFailed(QuireError):
    """No valid reply after all attempts."""
