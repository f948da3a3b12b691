"""The ends of the longer query chains against their twins; whatever stands before them in a chain is in their rows."""

import duckdb
import pytest

from reelspark.plans import catalogue, documents, enrichment, genres, incremental, parsing, reviewing, selection, series, weighting  # noqa: F401  (they register)

from .test_catalogue import SF, TABLES, rows

ENDS = [
    "enriched_decisions", "enriched_roles", "enriched_lines", "rejects_file", "full_fusion", "filter_pools", "spread_selection", "role_cuts", "scaled_templates", "timeline_documents", "quality_documents",
    "edit_list_file", "genre_fingerprints", "genre_verdict", "genre_consensus", "classic_ranking", "protagonist_cut", "golden_weights", "episode_split", "calibration_round", "merged_load", "reviewed_selection", "flat_lines", "label_rescue",
    "series_speech", "series_quotes", "series_stages", "series_review_keys", "media_scan", "spread_bands", "growing_bands", "cached_labels", "first_arrivals", "mixed_replies", "legacy_sentences", "unsupported_facts", "named_leads", "episode_parts",
    "genre_direction_scores", "role_word_cut", "review_files", "flat_fields",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ENDS)
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
