"""Where queries write files that they read again."""

from ledgerlens.store import folder as scratch  # noqa: F401
