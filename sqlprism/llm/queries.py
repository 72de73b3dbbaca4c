"""Registered queries of this subpackage and their DuckDB SQL."""

from sqlprism.llm import collocations, url_filter, warc
from sqlprism.llm.ann import op8_one_bit_codes
from sqlprism.llm.collocations import op11_son_collocations
from sqlprism.llm.conversations import op13_four_russians_repair
from sqlprism.llm.lm_scoring import op10_backoff_automaton_scores
from sqlprism.llm.near_dedup import op4_superminhash_near_dedup
from sqlprism.llm.packing import op1_sum_of_squares_packing
from sqlprism.llm.pieces import op2_sentencepiece_chunks
from sqlprism.llm.quality import op5_boosted_tree_quality
from sqlprism.llm.substring_dedup import op3_recompression_substring_dedup
from sqlprism.llm.topk import op6_impact_ordered_topk
from sqlprism.llm.toxicity import op12_noisy_channel_toxicity
from sqlprism.llm.url_filter import op7_temporal_url_filter
from sqlprism.llm.warc import op9_splittable_warc

QUERIES = {f.__name__: f for f in (
    op1_sum_of_squares_packing, op2_sentencepiece_chunks, op3_recompression_substring_dedup, op4_superminhash_near_dedup,
    op5_boosted_tree_quality, op6_impact_ordered_topk, op7_temporal_url_filter, op8_one_bit_codes, op9_splittable_warc,
    op10_backoff_automaton_scores, op11_son_collocations, op12_noisy_channel_toxicity, op13_four_russians_repair)}

ORACLES = {
    "op6_impact_ordered_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    **collocations.ORACLES,
    **url_filter.ORACLES,
    **warc.ORACLES,
}
