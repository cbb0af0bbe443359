"""The registered queries against their SQL, over whole tables."""

import duckdb
import pyarrow as pa
import pytest

from lakeloom.llm import oracle, queries

SF = "/root/testdata/sf0.001"


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in (r[i] for i in order)) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_vector_sql_and_query_agree_where_there_are_links(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.standard_normal((300, 16))
    x = np.concatenate([x, x[:30] + 0.05 * r.standard_normal((30, 16)), x[:5], x[0] + 0.02 * r.standard_normal((40, 16))]).astype(np.float32)
    t = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.nulls(len(x), pa.int32())})
    import pyarrow.parquet as pq

    pq.write_table(t, tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.register("embeddings", t)
    want = sorted(db.execute(oracle.similar_vectors()).fetchall())
    assert sum(n for _, _, n in want) > 1000
    assert sorted(map(tuple, queries.op7_vector_graph(spark, str(tmp_path)).collect())) == want
