"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.ball_kmeans import OP11_SQL, op11_ball_kmeans
from lumenframe.llm.byte_bpe import op10_ranked_merges
from lumenframe.llm.chat_format import OP7_SQL, op7_preference_pairs
from lumenframe.llm.embedding_dedup import op3_pca_tiles
from lumenframe.llm.lexical_search import OP13_SQL, op13_wand_shards
from lumenframe.llm.mixing import op6_golden_mix
from lumenframe.llm.order_minhash import op5_order_minhash
from lumenframe.llm.probe_search import op12_multiprobe_products
from lumenframe.llm.quality_model import op8_random_indexing
from lumenframe.llm.quality_rules import op4_divergence_rules
from lumenframe.llm.sharding import op1_feistel_shards
from lumenframe.llm.substring_dedup import op9_doubling_windows
from lumenframe.llm.token_codes import op2_addressable_ids


OPERATORS = (
    op1_feistel_shards,
    op2_addressable_ids,
    op3_pca_tiles,
    op4_divergence_rules,
    op5_order_minhash,
    op6_golden_mix,
    op7_preference_pairs,
    op8_random_indexing,
    op9_doubling_windows,
    op10_ranked_merges,
    op11_ball_kmeans,
    op12_multiprobe_products,
    op13_wand_shards,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each takes (spark, sf_dir) and works on whole tables."""
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query; the others are tested against brute force in tests/llm."""
    return {"op7_preference_pairs": OP7_SQL, "op11_ball_kmeans": OP11_SQL, "op13_wand_shards": OP13_SQL}
