"""The registered queries: names, SQL, and the flagship query."""

import duckdb
import pytest

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["entry_id", "author_pos", "affil_pos"] and df.count() > 0


@pytest.mark.parametrize("name", [
        "p4_found", "decade_sums", "bag_merge", "doc2bow", "count_cooc_by_bidecade", "tfidf_cooc_by_bidecade", "pmi_normalised", "pmi_filled", "tfidf_manual",
        "tfidf_l2", "assoc_rank", "assoc_rank_halfdecades", "freq_by_bidecade", "mean_freq_ranking", "lemma_dictionary", "vocabulary_cleaned", "trigram_bow",
        "clean_examples",
    ])
def test_query_equals_sql(spark, sf_dir, name):
    import compare

    db = duckdb.connect()
    for table in ("metadata_df", "unigrams_lemmata_dict", "entries_df", "entries_raw", "documents", "bidecades"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    result = db.execute(entry.oracle_sql()[name])
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of([d[0] for d in result.description], result.fetchall())
