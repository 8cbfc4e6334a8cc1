"""Routes over the real region cards of all chunks (R rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.operators import regions as G
from memspark.operators import routing as RT
from memspark.plans import entities as E
from memspark.plans.scratch import written
from memspark.queries_retrieval import _CHUNK_REGIONS, asked
from memspark.registry import query

_CARDS = f"""{_CHUNK_REGIONS}, rterms AS (SELECT family, region, term, row_number() OVER (PARTITION BY family, region ORDER BY count(*) DESC, term) AS n FROM (SELECT family, region, unnest({O.tokens('text')}) AS term FROM regions) WHERE term NOT IN {O.STOP} GROUP BY family, region, term QUALIFY n <= 3),
rnamed AS (SELECT family, region, string_agg(term, ' / ' ORDER BY n) AS terms FROM rterms GROUP BY ALL),
card AS (SELECT family || '-' || region AS region_id, lower(left(upper(family[1]) || family[2:] || ': ' || coalesce(terms, 'memory'), 72) || ' ' || 'Hierarchical source-aware region with semantic terms ' || coalesce(terms, 'memory') || '; source type ' || family) AS name, lower(family) AS val FROM (SELECT DISTINCT family, region FROM regions) LEFT JOIN rnamed USING (family, region)),
tok AS (SELECT item_id, unnest({O.tokens('text')}) AS tok FROM benchmark)"""


def cards(spark, d):
    """region_id, label, summary, values of the regions of all chunks."""
    made = G.region_cards(G.assign_regions(E.embedded_chunks(spark, d)))
    return written(made.select(F.concat_ws("-", "family", "region").alias("region_id"), "label", "summary", F.array("family").alias("values")), "cards")


@query("r1_region_routes", f"""WITH {_CARDS}, s AS (SELECT item_id, region_id, sum(CASE WHEN contains(name, tok) THEN 2.0 ELSE 0 END + CASE WHEN contains(val, tok) THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM tok, card GROUP BY ALL)
SELECT item_id AS query_id, region_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, region_id))::INT AS rank FROM s QUALIFY rank <= 3""")
def r1_regions(spark, d):
    """The three best regions of each query by its tokens in their cards."""
    return RT.routes(asked(spark, d), cards(spark, d))


@query("r13_region_traces", f"""WITH {_CARDS} SELECT item_id AS query_id, region_id, string_agg(DISTINCT tok, ' ' ORDER BY tok) AS matched_terms FROM tok JOIN card ON contains(name, tok) OR contains(val, tok) GROUP BY ALL""")
def r13_regions(spark, d):
    """Which words of a query each region's card holds."""
    return RT.matched_terms(asked(spark, d), cards(spark, d))
