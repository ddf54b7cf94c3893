"""Exceptions of the engine."""


class MemoryError_(Exception):
    """Base of the engine's errors."""


class StorageError(MemoryError_):
    pass


class EmbedError(MemoryError_):
    pass


class InvalidInput(MemoryError_):
    pass
