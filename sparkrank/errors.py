"""Requests that cannot be answered exactly are refused by name."""


class Refused(ValueError):
    """The request is not one this library answers; the message says why."""


class UnknownColumn(Refused):
    """No column of that name: an unknown value gives no rows, an unknown column is an error."""

    def __init__(self, table: str, column: str):
        super().__init__(f"{table} has no column {column}")


def require(condition: bool, why: str) -> None:
    if not condition:
        raise Refused(why)
