"""Errors raised by the library."""


class LacunaError(ValueError):
    """Base of the library's errors."""


class AllMissingColumn(LacunaError):
    def __init__(self, column: str):
        super().__init__(f"column {column} holds no value at all")


class TypeNotHandled(TypeError):
    def __init__(self, column: str, kind: str):
        super().__init__(f"column {column} has the type {kind}, which is not handled here")


class NotDataFrame(TypeError):
    def __init__(self, kind: type):
        super().__init__(f"a Spark DataFrame is expected, not {kind.__name__}")


class SchemaChanged(LacunaError):
    pass


class OrderRequired(LacunaError):
    def __init__(self, what: str):
        super().__init__(f"{what} depends on the order of rows: give order_by")


class SubsetIsAString(LacunaError):
    def __init__(self, subset: str):
        super().__init__(f"subset must be a list of columns, not the string {subset!r}")


class NotEnoughSamples(LacunaError):
    def __init__(self, largest: int, least: int):
        super().__init__(f"the largest pattern has {largest} rows; {least} are needed")


class EstimatorNotDefined(LacunaError):
    pass


class UnknownDataset(LacunaError):
    pass
