"""Ingest of batches, at once and as they land."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from playbill.operators import catalog
from playbill.sources import feeds, pages
from playbill.streaming import jobs

NOW = datetime(2024, 1, 15, 12)
FILMS = "id long, scraped_title string, scraped_year int, director string, runtime int, synopsis string, skip boolean, match_source string, ext_id long"
SHOWS = "id long, film_id long, venue_id string, starts_at timestamp_ntz, program_name string, tags array<string>"
BATCH = "scraped_title string, scraped_year int, venue_id string, starts_at timestamp_ntz, program_name string, director string, runtime int, synopsis string, skip boolean, tags array<string>, feed_pos int"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_ingest_merges_films_of_one_id_and_is_idempotent(spark):
    day = lambda n: NOW + timedelta(days=n)
    films = spark.createDataFrame([(1, "A", 2000, None, None, None, False, "auto", 9), (2, "A bis", None, None, None, None, False, "none", None)], FILMS)
    shows = spark.createDataFrame([(1, 1, "v", day(-1), None, []), (2, 1, "v", day(1), "P", []), (3, 2, "w", day(1), None, [])], SHOWS)
    new = [("A bis", None, "v", day(1), "Q", ["new"], 0), ("A", 2000, "v", day(1), "R", [], 1), ("B", None, "v", day(2), "B", [], 2), ("B", None, "v", day(2), "last", ["x"], 3), (None, None, "w", None, None, None, 4)]
    batch = spark.createDataFrame([(t, y, v, at, p, None, None, None, False, g, i) for t, y, v, at, p, g, i in new], BATCH)
    found = spark.createDataFrame([("A bis", None, 9), ("B", None, 8)], "scraped_title string, scraped_year int, ext_id long")
    once = catalog.ingest(films, shows, batch, NOW, found)
    assert rows(once["films"], "id", "scraped_title", "ext_id") == [(1, "A", 9), (3, "B", 8)]
    want = [(1, 1, "v", day(-1), None), (3, 1, "w", day(1), None), (5, 1, "v", day(1), "R"), (6, 3, "v", day(2), "last")]
    assert rows(once["screenings"], "id", "film_id", "venue_id", "starts_at", "program_name") == want
    assert rows(once["runs"], "venue_id", "status", "scraped", "warning") == [("v", "success", 4, None), ("w", "failure", 0, "empty batch, kept 1 future rows")]
    twice = catalog.ingest(once["films"], once["screenings"], batch, NOW, found)
    assert rows(twice["films"], "scraped_title", "ext_id") == [("A", 9), ("B", 8)]
    key = ("film_id", "venue_id", "starts_at", "program_name")
    assert rows(twice["screenings"], *key) == rows(once["screenings"], *key)


def landed(spark, folder, name, films):
    show = lambda at: {"at": at, "shown": "1", "expired": False}
    body = [(v, spark.createDataFrame([(t, 0, 90, [show(a) for a in at])], "title string, release int, minutes int, showtimes array<struct<at:string,shown:string,expired:boolean>>").select(F.to_json(F.struct("*"))).first()[0]) for v, t, at in films]
    spark.createDataFrame(body, "source string, body string").coalesce(1).write.mode("append").parquet(str(folder / name))


def test_continuous_ingest(spark, tmp_path):
    source, root = tmp_path / "landed", str(tmp_path / "out")
    Path(source).mkdir()
    stream = lambda: spark.readStream.schema("source string, body string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    run = lambda start=None: jobs.ingest_stream(spark, stream(), feeds.SOURCES["nested"], NOW, root, start)
    empty = run()
    assert empty["films"].count() == 0 and empty["screenings"].count() == 0
    start = {
        "films": spark.createDataFrame([(7, "Old", None, None, None, None, None, False, "none")], jobs.SNAPSHOTS["films"]),
        "screenings": spark.createDataFrame([(3, 7, "v", NOW - timedelta(days=9), None, [], None, None), (4, 7, "v", NOW + timedelta(days=9), None, [], None, None)], jobs.SNAPSHOTS["screenings"]),
    }
    assert rows(run(start)["films"], "id") == [(7,)]
    for n, film in enumerate(("New", "Old", "Newer")):
        landed(spark, source, f"f{n}", [("v", film, ["2024-01-20 20:00:00"])])
        out = run(start)
    assert rows(out["films"], "id", "scraped_title") == [(7, "Old"), (8, "New"), (9, "Newer")]
    assert rows(out["screenings"], "film_id", "starts_at") == [(7, NOW - timedelta(days=9)), (9, datetime(2024, 1, 20, 23))]
    assert sorted(p.name for p in Path(root, "commits").glob("0*")) == ["000000000002", "000000000003"]


def days_of(spark, df):
    return sorted({f.split("part=")[1].split("/")[0] for f in df.inputFiles()})


def test_a_batch_touches_the_parts_of_its_days_alone(spark, tmp_path, monkeypatch):
    """Past days keep the files of the version that wrote them and are in no plan of a batch; ids go on from the mark."""
    store = jobs.snapshots(spark, str(tmp_path / "s"))
    day = lambda n: NOW + timedelta(days=n)
    batch = "scraped_title string, scraped_year int, venue_id string, starts_at timestamp_ntz, program_name string, director string, title_original string, runtime int, synopsis string, skip boolean, tags array<string>, source_url string, scraped_at timestamp_ntz, feed_pos int"
    rows_ = lambda *r: spark.createDataFrame([(t, None, v, at, None, None, None, None, None, False, [], None, NOW, i) for i, (t, v, at) in enumerate(r)], batch)
    one = jobs.ingest_batch(store, rows_(("A", "v", day(-40)), ("B", "v", day(-3)), ("A", "v", day(2)), ("A", "w", day(2))), NOW, 1)
    assert set(one["parts"]["screenings"].values()) == {1} and one["top"] == {"films": 2, "screenings": 4}
    read = []
    plain = store.read
    monkeypatch.setattr(store, "read", lambda *a: read.append(plain(*a)) or read[-1])
    two = jobs.ingest_batch(store, rows_(("C", "v", day(5))), NOW, 2)
    monkeypatch.undo()
    assert {d for df in read if "venue_id" in df.columns for d in days_of(spark, df)} == {"2024-01-17"}
    assert two["parts"]["screenings"] == {"2023-12-06": 1, "2024-01-12": 1, "2024-01-17": 2, "2024-01-20": 2} and two["top"] == {"films": 3, "screenings": 5}
    assert rows(store.read("screenings"), "id", "film_id", "venue_id") == [(1, 1, "v"), (2, 2, "v"), (4, 1, "w"), (5, 3, "v")]
    again = jobs.ingest_batch(store, rows_(("C", "v", day(5))), NOW, 2)
    assert again == two and store.read("screenings").count() == 4


def test_readers_see_whole_versions_only(spark, tmp_path):
    """Killed between its two tables, a version is not there; made again, it is as if nothing had been."""
    store = jobs.snapshots(spark, str(tmp_path / "s"))
    film = lambda i, t: (i, t, None, None, None, None, None, False, "none")
    show = lambda i, f: (i, f, "v", NOW, None, [], None, None)
    frames = lambda n: {"films": spark.createDataFrame([film(i, f"F{i}") for i in range(1, n + 1)], jobs.SNAPSHOTS["films"]), "screenings": spark.createDataFrame([show(i, i) for i in range(1, n + 1)], jobs.SNAPSHOTS["screenings"])}
    assert store.read("films").count() == 0 and store.versions() == []
    touched = lambda n: {"films": {r[0] for r in frames(n)["films"].select(jobs.film_part(F.col("scraped_title"))).collect()}, "screenings": {"2024-01-15"}}
    first = store.commit(1, store.mark(), frames(2), touched(2))

    class Killed(Exception):
        pass

    class Broken:
        def withColumn(self, *a):
            raise Killed

    try:
        store.commit(2, first, {"films": frames(5)["films"], "screenings": Broken()}, touched(5))
        raise AssertionError
    except Killed:
        pass
    assert store.versions() == [1] and store.mark() == first
    assert store.read("films").count() == store.read("screenings").count() == 2
    second = store.commit(2, store.mark(2), frames(3), touched(3))
    assert store.versions() == [1, 2] and store.read("films").count() == store.read("screenings").count() == 3
    assert store.read("screenings", first).count() == 2  # a reader of the version before still finds its files
    store.commit(3, second, frames(4), touched(4))
    assert store.versions() == [2, 3] and store.read("films").count() == 4 and store.mark()["top"] == {"films": 4, "screenings": 4}


def test_resolution_inside_the_chain(spark):
    """Films that wait are handed to the resolver; matches write catalog columns, misses the version, errors nothing; a tried film waits again for a later version only."""
    schema = "id long, scraped_title string, scraped_year int, director string, title_original string, runtime int, synopsis string, skip boolean, match_source string, match_version int, ext_id long, title string"
    films = spark.createDataFrame([
        (1, "Matched", None, "X", "O", 90, None, False, "manual", None, 9, "Matched"), (2, "Tried", None, None, None, None, None, False, "none-attempted", 3, None, None),
        (3, "Old try", None, None, None, None, " ", False, "none-attempted", 2, None, None), (4, "Skipped", None, None, None, None, None, True, "none", None, None, None),
    ], schema)
    shows = spark.createDataFrame([], SHOWS)
    batch = spark.createDataFrame([("New", 2001, "v", NOW + timedelta(days=1), None, None, 80, None, False, [], 0), ("Matched", None, "v", NOW + timedelta(days=1), None, "Y", 1, "told", False, [], 1), ("Odd", None, "v", NOW + timedelta(days=2), None, None, None, None, False, [], 2)], BATCH)
    batch = batch.withColumn("title_original", F.lit("New O"))
    asked = []

    def resolver(pending):
        asked.extend(sorted(r["scraped_title"] for r in pending.collect()))
        found = [("New", 2001, 50, "ok", "The new one", 2002, "text", 7.5), ("Old try", None, 9, "ok", "M", None, "text", 1.0), ("Odd", None, None, "error", None, None, None, None)]
        return spark.createDataFrame(found, "scraped_title string, scraped_year int, ext_id long, reason string, title string, year int, synopsis string, popularity double")

    out = catalog.ingest(films, shows, batch, NOW, resolver, version=3)
    assert asked == ["New", "Odd", "Old try"]
    assert rows(out["films"], "id", "scraped_title", "match_source", "match_version", "ext_id", "title", "synopsis", "popularity") == [
        (1, "Matched", "manual", None, 9, "Matched", "told", None), (2, "Tried", "none-attempted", 3, None, None, None, None), (4, "Skipped", "none", None, None, None, None, None),
        (5, "New", "auto", None, 50, "The new one", "text", 7.5), (6, "Odd", "none", None, None, None, None, None),
    ]
    assert rows(out["films"].filter("id IN (1, 5)"), "id", "director", "title_original", "runtime") == [(1, "X", "O", 90), (5, None, "New O", 80)]
    assert out["enrichment"].first().asDict() == {"enriched": 2, "merged": 1, "skipped": 1}
    assert rows(out["summary"], "venue_id", "scraped", "distinct_rows", "inserted", "upserted") == [("v", 3, 3, 3, 3)]
    missed = catalog.ingest(films, shows, batch, NOW, lambda p: p.select("scraped_title", "scraped_year", F.lit(None).cast("long").alias("ext_id"), F.lit("low-confidence").alias("reason")), version=3)
    assert rows(missed["films"].filter("match_source = 'none-attempted'"), "id", "match_version") == [(2, 3), (3, 3), (5, 3), (6, 3)]


def test_event_titles(spark):
    cases = {
        "Ciclo SUR: “Alita” (Gunnm)": ("Alita", "Gunnm", None, None, "Ciclo SUR"),
        "NIRVANNA: “The Band”": ("NIRVANNA: The Band", None, None, None, None),
        "EL BUENO - EL MALO Y EL FEO": ("EL BUENO - EL MALO Y EL FEO", None, None, None, None),
        "TORSO (1973)": ("TORSO", None, None, 1973, None),
        "Sombras (Juan Sosa, 1959)": ("Sombras", None, "Juan Sosa", 1959, None),
        "SOMBRAS Dir. Ana Paz · Perú · 1990 · 97 min": ("SOMBRAS", None, "Ana Paz", 1990, None),
        "VHS PRESENTA:Bola Z: El Ataque": ("Bola Z: El Ataque", None, None, None, "VHS PRESENTA"),
        "PERROS DE LA CALLE": ("PERROS DE LA CALLE", None, None, None, None),
        "UN TÍTULO - ANA RUIZ": ("UN TÍTULO", None, "ANA RUIZ", None, None),
        "“76 89 23” y (1700)": ("76 89 23 y", None, None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", pages.event_title(F.col("raw")).alias("t")).select("raw", "t.*")
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == cases
