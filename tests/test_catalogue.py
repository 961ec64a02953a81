import pytest

from cinetable import queries as catalogue

SMALL = "/root/testdata/sf0.001"


def test_names_and_sql():
    names = set(catalogue.queries())
    assert {"p1_found", "p6_found", "interval_join_names"} <= names
    assert set(catalogue.oracle_sql()) <= names


@pytest.mark.parametrize("name", [
        "p1_found", "p6_found", "p6_file_records", "interval_join_names", "time_windows", "bm25_topk", "frame_aggregate", "word_index", "passages", "frame_sample", "speaker_prefix",
        "spelling", "seen_periods", "mmr_rerank", "search_hybrid", "search_context", "srt_strict", "srt_lenient", "detections_csv", "frames_csv", "chunks_jsonl", "words_jsonl",
        "store_views", "fts_join", "stored_index", "edge_degrees", "one_hop", "merged_entities", "within_budget", "kept_segments", "evidence", "suppressed_boxes",
    ])
def test_equals_sql_on_the_smallest_tables(spark, name):
    from tools.compare import digest, views

    df = catalogue.queries()[name](spark, SMALL)
    cursor = views(SMALL).execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert digest([r.asDict(recursive=True) for r in df.collect()]) == digest([dict(zip(columns, r)) for r in cursor.fetchall()])
    assert sorted(df.columns) == sorted(columns)
