"""Sources on payloads that lack things, and event titles in all their forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from playbill.operators import listings
from playbill.sources import feeds, pages

NOW = datetime(2024, 1, 15, 12)
LANDED = "payload_id string, source string, body string"


def lanes(spark, name, *bodies):
    feed = feeds.fetch(name, spark, spark.createDataFrame([(str(i), "room", b) for i, b in enumerate(bodies)], LANDED), NOW)
    results = {r["payload_id"]: (r["status"], r["rows"], r["warnings"]) for r in feed.results.collect()}
    return feed.rows.orderBy("film_title", "starts_at").collect(), sorted(r["message"] for r in feed.warnings.collect()), results


def test_what_a_feed_does_not_say_hides_nothing(spark):
    shows = '{"at":"2024-02-01 21:30:00.000000"},{"at":"2024-02-02 20:00","shown":"1"},{"at":"2024-02-03 20:00","shown":"0"},{"at":"2024-02-04 20:00","expired":true},{"at":"soon"},{}'
    rows, warnings, results = lanes(spark, "nested", f'{{"title":" El sur - CICLO Erice ","release":1,"showtimes":[{shows}]}}', '{"title":" ","showtimes":[{"at":"2024-02-01 20:00"}]}', '{"title":"No list"}', "{oops", None)
    assert [(r["film_title"], r["program_name"], r["starts_at"], r["tags"]) for r in rows] == [("El sur", "CICLO Erice", datetime(2024, 2, 2, 0, 30), ["premiere"]), ("El sur", "CICLO Erice", datetime(2024, 2, 2, 23), ["premiere"])]
    assert warnings == ["El sur - CICLO Erice: unreadable time null", "El sur - CICLO Erice: unreadable time soon"]
    assert results == {"0": ("success", 2, 2), "1": ("success", 0, 0), "2": ("success", 0, 0), "3": ("failure", 0, 0), "4": ("success", 0, 0)}


def test_other_sources_fail_one_payload_alone(spark):
    coded = '{"day":"2024-02-01","complex":"m","films":[{"code":"a","name":"A"},{"code":"a","name":"B"}],"shows":[{"code":"a","hour":"24:00","complex":"m"},{"code":"z","hour":"18:00","complex":"m"},{"code":"a","hour":"99:99","complex":"m"}]}'
    rows, warnings, results = lanes(spark, "coded", coded, '{"films":[]}', "[")
    assert [(r["film_title"], r["starts_at"]) for r in rows] == [("A", datetime(2024, 2, 2, 3))]
    assert warnings == ["A: unreadable time 99:99", "unknown film z"] and results == {"0": ("success", 1, 2), "1": ("failure", 0, 0), "2": ("failure", 0, 0)}
    rows, warnings, results = lanes(spark, "month", '[{"id":"1","area":"room","title":"A","start":"2024-02-01 20:00"},{"id":"2","area":"room","title":" "},{"id":"3","area":"bar"}]', "null", "[]")
    assert [r["film_title"] for r in rows] == ["A"] and warnings == ["event 2: no title"] and results == {"0": ("success", 1, 1), "1": ("failure", 0, 0), "2": ("success", 0, 0)}
    rows, warnings, results = lanes(spark, "printed", "A\nJueves 28 y viernes 29 de febrero, 20.30 horas\nFicha\nLunes 31 de febrero a las 20 horas\nmás de dos horas", "", "B")
    assert [(r["film_title"], r["starts_at"]) for r in rows] == [("A", datetime(2024, 2, 28, 23, 30)), ("A", datetime(2024, 2, 29, 23, 30))]
    assert warnings == ["no such day: Lunes 31 de febrero a las 20 horas", "unreadable line: más de dos horas"] and results == {"0": ("success", 2, 2), "1": ("failure", 0, 0), "2": ("success", 0, 0)}


def test_a_source_that_throws_or_is_not_there_is_a_result(spark, monkeypatch):
    def thrower(spark, landed, now):
        return landed.select("no such column")

    monkeypatch.setitem(feeds.SOURCES, "thrower", thrower)
    for name in ("thrower", "nobody"):
        rows, warnings, results = lanes(spark, name, "a", "b")
        assert rows == [] and warnings == [] and results == {"0": ("failure", 0, 0), "1": ("failure", 0, 0)}
    assert set(feeds.SOURCES) >= {"nested", "coded", "month", "events", "printed"}


def test_labels_that_come_twice(spark):
    c = spark.range(1).select(feeds.credits(F.lit("Director: A\nnoise\nDIRECTOR: B\nAño: 1999\n: x")).alias("c")).first()["c"]
    assert c == {"director": "A", "ano": "1999", "": "x"}


@pytest.mark.parametrize(
    ("raw", "title", "program"),
    [
        ("SUEÑO - CICLO ANA RUIZ", "SUEÑO", "CICLO ANA RUIZ"), ("Luz — RETROSPECTIVA Ana Ruiz", "Luz", "RETROSPECTIVA Ana Ruiz"), ("Mar - foco Ruiz - 2", "Mar", "foco Ruiz - 2"),
        ("Mar–MUESTRA", "Mar", "MUESTRA"), ("Mar - The Final Cut", "Mar - The Final Cut", None), ("CICLO ANA", "CICLO ANA", None), (" - CICLO ANA", " - CICLO ANA", None), ("Mar - CICLOS", "Mar - CICLOS", None),
    ],
)
def test_programme_suffixes(spark, raw, title, program):
    s = spark.range(1).select(feeds.programme_suffix(F.lit(raw)).alias("s")).first()["s"]
    assert (s["title"], s["program"]) == (title, program)


TITLES = [
    ('"LUZ, 23 CALLE"', "LUZ, 23 CALLE", None, None, None, None),
    ('"ARAÑA - AL OTRO LADO"(2023)', "ARAÑA - AL OTRO LADO", None, None, 2023, None),
    ('NIRVANNA: "La banda,el show"', "NIRVANNA: La banda,el show", None, None, None, None),
    ('NOCHE RARA: "Luz" (Lux), de Ana Ruiz.', "Luz", "Lux", "Ana Ruiz", None, "NOCHE RARA"),
    ('Gran Traje: "Char\'s Revenge"  Dir. Ana Ruiz', "Char's Revenge", None, "Ana Ruiz", None, "Gran Traje"),
    ("MAR (Parte Dos)", "MAR (Parte Dos)", None, None, None, None),
    ("VHS RARO : EL FIN de Ana Ruiz & Eva PaZ (1997)", "EL FIN", None, "Ana Ruiz & Eva PaZ", 1997, "VHS RARO"),
    ('"76 89 23"  EL DOC  - Dir. Ana Ruiz', "76 89 23 EL DOC", None, "Ana Ruiz", None, None),
    ("ALGO PRESENTA:Bola Z: El Ataque", "Bola Z: El Ataque", None, None, None, "ALGO PRESENTA"),
    ("PERROS DE LA CALLE", "PERROS DE LA CALLE", None, None, None, None),
    ("EL VIAJE DE ANA  (Eva Paz,2003)", "EL VIAJE DE ANA", None, "Eva Paz", 2003, None),
    ('SUSTO. POR MUJERES: "HUESO"', "HUESO", None, None, None, "SUSTO. POR MUJERES"),
    ("AQUÍ! EL SHOW - Dir. Ana Ruiz", "AQUÍ! EL SHOW", None, "Ana Ruiz", None, None),
    ("YOUNG LUZ - ANA RUIZ (1974)", "YOUNG LUZ", None, "ANA RUIZ", 1974, None),
    ("EL BUENO - EL MALO Y EL FEO", "EL BUENO - EL MALO Y EL FEO", None, None, None, None),
    ('#AÑO2016: "LUZ"', "LUZ", None, None, None, "#AÑO2016"),
    ("LUZ Dir. Ana Ruiz · Japón · 1964 ·", "LUZ", None, "Ana Ruiz", 1964, None),
    ("LA LUZ / EL MAR Dir. Ana Ruiz · 1983 · 97 min", "LA LUZ / EL MAR", None, "Ana Ruiz", 1983, None),
    ("Luz (1700)", "Luz", None, None, None, None),
    ('"Luz" (1999) (Lux)', "Luz", "Lux", None, 1999, None),
    ('"Uno" y "Dos"', "Uno y Dos", None, None, None, None),
    ('"Uno" + "Dos"', "Uno Dos", None, None, None, None),
    ("  ", "", None, None, None, None),
]


def test_event_titles_in_all_forms(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, raw string").select("i", pages.event_title(F.col("raw")).alias("t")).select("i", "t.*")
    got = {r["i"]: (r["title"], r["original"], r["director"], r["year"], r["program"]) for r in df.collect()}
    assert [got[i] for i in range(len(TITLES))] == [t[1:] for t in TITLES]


def test_weekly_runs_by_minutes_and_clock(spark):
    local = lambda d, h, m: datetime(2024, 6, d, h, m) + timedelta(hours=3)
    shows = [(1, local(3, 20, 30)), (1, local(4, 20, 45)), (2, local(3, 23, 30)), (2, local(3, 14, 0)), (2, local(3, 0, 30)), (3, local(5, 14, 0)), (3, local(6, 14, 0))]
    rows = spark.createDataFrame(shows, "film_id int, starts_at timestamp_ntz")
    got = sorted((r["film_id"], r["times"], r["n_days"], r["uniform"]) for r in listings.weekly_runs(rows).collect())
    assert got == [(1, "20:30", 1, False), (1, "20:45", 1, False), (2, "14:00 23:30 00:30", 1, True), (3, "14:00", 2, True)]
