import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from losslens.plans import catalog


@pytest.mark.parametrize("name", ["packed_stage_inputs", "padded_batches"])
def test_float_products_are_rounded_as_floats(spark, tmp_path, name):
    """A float's product with 1000 may be a whole number where a double's is just below one."""
    vectors = [[-0.196, 0.5, 0.25], [0.053, -0.1589999943971634, 1.0], [0.1, -0.1], [0.0]]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = con.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())
