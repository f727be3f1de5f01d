"""The library's exception."""


class FrameError(Exception):
    """A frame or a file that cannot be used as asked; equal to another error of the same message."""

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message

    def __str__(self) -> str:
        return self.message

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FrameError) and self.message == other.message

    def __hash__(self) -> int:
        return hash(self.message)
