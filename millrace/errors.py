class QueryError(Exception):
    """A statement failed to parse, resolve or run."""


class TableFunctionError(QueryError):
    """A table function is unknown, called wrongly or declared wrongly."""


class CatalogError(QueryError):
    """A catalog change is not allowed."""
