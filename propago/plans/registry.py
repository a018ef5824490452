"""Where query modules put their queries and DuckDB twins."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its twin."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "WITH " + sql.strip() if not sql.lstrip().startswith(("SELECT", "WITH")) else sql.strip()
        return f

    return put
