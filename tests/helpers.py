"""Small comparisons shared by the tests."""


def rows(df, *columns):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
