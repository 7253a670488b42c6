"""Database tables over JDBC. Connection facts come from the caller; nothing is stored here."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Dialect -> (JDBC name, default port, driver class).
DIALECTS = {
    "postgresql": ("postgresql", 5432, "org.postgresql.Driver"),
    "greenplum": ("postgresql", 5432, "org.postgresql.Driver"),
    "mysql": ("mysql", 3306, "com.mysql.cj.jdbc.Driver"),
    "sqlserver": ("sqlserver", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("oracle", 1521, "oracle.jdbc.OracleDriver"),
    "hsqldb": ("hsqldb", 9001, "org.hsqldb.jdbc.JDBCDriver"),
}

#: What to do when the target table exists.
MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


@dataclass(frozen=True)
class Database:
    dialect: str
    host: str
    database: str
    user: str
    password: str = field(repr=False, default="")
    port: int | str | None = None
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.dialect not in DIALECTS:
            raise ValueError(f"unknown database {self.dialect}; one of {sorted(DIALECTS)}")
        for name in ("host", "database", "user"):
            if not getattr(self, name):
                raise ValueError(f"{name} must not be empty")

    def url(self) -> str:
        name, default_port, _ = DIALECTS[self.dialect]
        at = f"{self.host}:{self.port or default_port}"
        forms = {
            "oracle": f"jdbc:oracle:thin:@//{at}/{self.database}",
            "sqlserver": f"jdbc:sqlserver://{at};databaseName={self.database}",
            "hsqldb": f"jdbc:hsqldb:hsql://{at}/{self.database}",
        }
        return forms.get(name, f"jdbc:{name}://{at}/{self.database}")

    def options(self) -> dict[str, str]:
        driver = DIALECTS[self.dialect][2]
        return {"url": self.url(), "driver": driver, "user": self.user, "password": self.password, **self.extra}


def jdbc_read(
    spark: SparkSession,
    source: Database | Mapping[str, str],
    table: str | None = None,
    query: str | None = None,
    split: tuple[str, object, object, int] | None = None,
    fetch_rows: int = 10_000,
) -> DataFrame:
    """A table, or the result of query text that runs in the database.

    ``split = (column, low, high, parts)`` reads a table through that many connections; filters and
    columns asked for later are pushed into the database either way.
    """
    if bool(table) == bool(query):
        raise ValueError("give either a table or a query")
    options = dict(source.options() if isinstance(source, Database) else source)
    options["fetchsize"] = str(fetch_rows)
    if split:
        column, low, high, parts = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
        # a query can be split only as a derived table
        options["dbtable"] = table or f"({query}) as split_source"
    else:
        options["dbtable" if table else "query"] = table or query
    return spark.read.format("jdbc").options(**options).load()


def jdbc_write(
    df: DataFrame, target: Database | Mapping[str, str], table: str, mode: str = "append", connections: int = 8, batch_rows: int = 10_000
) -> None:
    """Append to, replace or create a table; ``connections`` bounds the load on the database."""
    if not table:
        raise ValueError("table must not be empty")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {sorted(MODES)}")
    options = dict(target.options() if isinstance(target, Database) else target)
    options |= {"dbtable": table, "numPartitions": str(connections), "batchsize": str(batch_rows)}
    df.write.format("jdbc").options(**options).mode(MODES[mode]).save()
