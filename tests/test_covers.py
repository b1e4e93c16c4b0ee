"""A query that claims a row of the inventory calls the function that is that row."""

import sys

import pytest

from playbill.plans import registry

SF = "/root/testdata/sf0.001"
#: Row -> function that does it.
DONE_BY = {
    "F-2": "nested_showtimes", "F-3": "coded_showtimes", "F-4": "month_feed", "F-5": "event_feed", "F-7": "with_details", "F-8": "label_tags", "F-9": "agenda", "F-10": "credits", "F-11": "event_title",
    "F-12": "programme_suffix", "F-13": "shift_suffix", "F-14": "poster_title", "F-15": "showtime_line", "F-16": "valid_year", "F-17": "expand_schedule", "F-18": "weekly_grid", "F-19": "next_weekday",
    "F-20": "spanish_date", "F-21": "inferred_year", "F-22": "carry_months", "F-23": "weekday_year", "F-24": "wall_to_utc", "F-25": "release_week", "F-26": "merge_details", "F-28": "host_allowed",
    "F-31": "largest_image", "F-32": "longest_block", "F-33": "anchor_year", "F-34": "showtime_days", "F-35": "blocks", "F-36": "keyword_tags", "F-37": "film_blocks", "F-38": "calendar", "F-39": "unchanged",
    "S-1": "fold", "S-2": "title_key", "S-4": "slug", "S-6": "key_similarity", "S-8": "strip_noise", "S-10": "title_forms", "S-12": "display_title", "S-13": "person_case", "S-16": "split_directors",
    "S-17": "directors_match", "S-18": "comparable_scripts", "S-19": "latin_name", "S-20": "year_acceptable", "S-23": "non_feature_reason",
    "J-8": "lookup_override", "J-9": "title_pairs", "J-10": "score", "J-11": "director_pivot", "J-15": "proposals", "J-16": "seed_if_absent",
    "W-5": "assign_slugs", "W-6": "rank", "W-8": "vote_champions", "W-15": "only_one", "W-9": "dominates", "W-10": "answers", "W-11": "featured", "W-12": "first_days", "W-17": "next_showing",
    "M-1": "upsert_films", "M-2": "upsert_films", "M-4": "replace_future", "M-6": "merge_duplicates", "M-7": "winners", "M-8": "write_matches", "M-9": "write_misses", "M-10": "reopen",
    "M-12": "upsert_keyed", "M-14": "assign_by_hand", "M-15": "set_flag", "M-16": "set_flag", "M-17": "latest_state", "M-18": "fold_run_events", "M-20": "reset_programme", "M-21": "assign_slugs", "M-22": "catalog_delta",
    "R-1": "matches", "R-2": "resolve", "R-3": "gate", "R-4": "proposals", "R-6": "ingest", "R-7": "golden_set", "K-1": "ingest_stream", "K-2": "without_duplicates", "K-3": "stuck_runs", "K-4": "day_counts",
    "X-1": "fetch", "X-4": "featured",
}


@pytest.fixture(scope="module")
def called(spark):
    """Query -> functions of the library that it calls, directly or through others."""
    out = {}
    for name, query in registry.queries().items():
        names = set()

        def seen(frame, event, arg, names=names):
            if event == "call" and "playbill" in frame.f_code.co_filename:
                names.add(frame.f_code.co_name)

        sys.setprofile(seen)
        try:
            query(spark, SF)
        finally:
            sys.setprofile(None)
        out[name] = names
    return out


@pytest.mark.parametrize("row", sorted(DONE_BY))
def test_row_is_done_by_its_query(called, row):
    claiming = [q for q, rows in registry.covers().items() if row in rows.split()]
    assert claiming and any(DONE_BY[row] in called[q] for q in claiming), (row, claiming)
