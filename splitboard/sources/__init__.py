"""Readers, staged tables and sinks."""

from splitboard.sources.tables import dealt, discard, empty, load, local_session, small_batches, stage

__all__ = ["dealt", "discard", "empty", "load", "local_session", "small_batches", "stage"]
