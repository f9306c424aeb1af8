"""op13 on a table without rows: ``test_empty_tables`` makes no ``embeddings``, so that it ends at a path that is missing."""

from millrace.llm import queries as Q

from .test_operators import SF


def test_no_vectors_give_no_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    have = Q.op13_ball_tree(spark, str(tmp_path))
    assert have.columns[:2] == ["vec_id", "cluster"] and have.count() == 0
