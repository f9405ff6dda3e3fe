import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    return session("local[4]", shuffle_partitions=4, memory="3g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}"})


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB SQL over the tables of a folder."""
    import duckdb

    def run(sql: str, folder: str):
        c = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        return c.execute(sql).df()

    return run


def as_rows(df) -> list:
    df = df.toPandas() if hasattr(df, "toPandas") else df
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))
