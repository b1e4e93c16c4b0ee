"""Queries without SQL run over their whole tables."""

from playbill.plans import registry

SF = "/root/testdata/sf0.001"


def test_resolution_takes_all_listings(spark):
    parts = sorted(r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect())
    found = registry.queries()["enrichment_cascade"](spark, SF).select("listing_id", "reason").collect()
    assert sorted(r[0] for r in found) == parts
    # Each misspelt or noisy listing shares its head with its own part, so none is without candidates.
    assert "no-candidates" not in {r[1] for r in found}
    matched = {r[0] for r in registry.queries()["best_matches"](spark, SF).select("listing_id").collect()}
    assert matched <= set(parts) and {k % 5 for k in matched} == {0, 1, 2, 3, 4}
