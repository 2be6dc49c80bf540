import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made


@pytest.fixture
def oracle():
    """Runs DuckDB SQL over the parquet tables of a folder; rows as tuples, sorted by column name and value."""

    def run(sql, sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        return names, got.fetchall()

    return run


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables (name=(rows, schema)) to a folder as the given tables are laid out."""

    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def same(df, names, rows, digits=6):
    """Whether the DataFrame has just these rows, in any order."""
    assert sorted(df.columns) == sorted(names)
    tidy = lambda x: round(x, digits) if isinstance(x, float) else x
    key = lambda r: tuple((x is not None, x) for x in r)
    mine = sorted((tuple(tidy(r[n]) for n in sorted(names)) for r in df.collect()), key=key)
    order = [names.index(n) for n in sorted(names)]
    theirs = sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=key)
    assert len(mine) == len(theirs)
    assert mine == theirs
