"""A query of each section against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from quillog.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
#: One or two of each section; the whole list runs in the driver's comparison.
NAMES = [
    "src_pgn_headers", "src_movetext_plies", "eval_cp_loss", "fen_pawn_structure", "uci_move_flags", "chk_candidate_set", "split_chrono_70_15_15", "smp_greedy_pack", "smp_whole_game_prefix",
    "win_tendency_encoder", "win_opportunity_profile", "join_donor_asof", "prob_baseline_history", "prob_inverse_cdf", "rank_panel", "style_cells", "qual_summary", "gate_width_sequential", "ml_listwise_gradient", "st_player_profile",
    "src_game_files", "chk_join_consistency", "chk_complete_games", "chk_split_overlap", "win_history_encoder", "join_feature_table", "sel_sequential_acceptance", "rank_metrics_topk", "agg_style_profile", "style_vector", "traj_compare",
    "boot_paired_masked", "st_incremental_ingest", "ml_preprocess", "st_player_tendencies", "style_identity", "join_next_cyclic", "agg_strength_profile", "sink_sharded_by_player",
]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(registry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
