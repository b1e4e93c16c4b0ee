"""Landed payloads to rows of one schedule: JSON feeds, HTML pages, text schedules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, times

#: The row that every source must give.
CANONICAL = (
    "venue_id string, film_title string, film_title_original string, director string, year int, country string, runtime_min int, starts_at timestamp_ntz, tags array<string>, "
    "synopsis string, source_url string, film_detail_url string, program_name string, skip boolean, feed_pos int"
)

#: Name -> job from landed payloads (payload_id, source, body) and the time of the run to rows in lanes.
SOURCES: dict[str, Callable[[SparkSession, DataFrame, datetime], DataFrame]] = {}

#: What a job gives beside the canonical columns: a payload's listing rows, its warnings, and an error where it can't be read.
ROW, WARNING, ERROR = "row", "warning", "error"


def none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def source(name: str):
    def add(job):
        SOURCES[name] = job
        return job

    return add


def canonical_columns(df: DataFrame) -> list[Column]:
    from pyspark.sql.types import StructType

    return [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(CANONICAL).fields]


def canonical(df: DataFrame) -> DataFrame:
    """df with all canonical columns, null where it has none."""
    return df.select(*canonical_columns(df))


def in_lanes(df: DataFrame, lane: Column, message: Column) -> DataFrame:
    """df (with payload_id) as canonical rows with their lane and, for warnings and errors, a message."""
    rows = df.withColumns({"lane": lane.cast("string"), "message": message.cast("string")})
    return rows.select("payload_id", "lane", "message", *canonical_columns(rows))


def identified(landed: DataFrame) -> DataFrame:
    """Payloads with an id: that which they have, else their checksum."""
    return landed if "payload_id" in landed.columns else landed.withColumn("payload_id", F.sha2(F.concat_ws("\n", "source", "body"), 256))


def dealt(landed: DataFrame, *keys: str) -> DataFrame:
    """Payloads dealt out by keys to as many partitions as shuffles have: files of short payloads are few, and taking a payload apart costs far more than reading it. The number is
    given, as adaptive execution would join partitions by their bytes."""
    return landed.repartition(int(landed.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parsed(body: str, schema: str) -> Column:
    """A JSON payload as a struct, whose _broken is the text of one that can't be read."""
    return F.from_json(body, schema[:-1] + ",_broken:string>", {"columnNameOfCorruptRecord": "_broken"})


@dataclass(frozen=True)
class Feed:
    """What a source gave: canonical rows; warnings (payload_id, message); a result for each payload (payload_id, source, status, rows, warnings, error)."""

    rows: DataFrame
    warnings: DataFrame
    results: DataFrame


def fetch(name: str, spark: SparkSession, landed: DataFrame, now: datetime) -> Feed:
    """Runs a source on landed payloads. Nothing is thrown: a payload that can't be read fails alone, by a row in the error lane; where there is no such
    source, or its job can't be planned, all payloads fail with the reason."""
    landed = dealt(identified(landed), "payload_id")  # which the counts below need anyway
    failed = lambda why: in_lanes(landed.select("payload_id"), F.lit(ERROR), F.lit(why))
    try:
        lanes = SOURCES[name](spark, landed, now) if name in SOURCES else failed(f"no source {name}")
    except Exception as e:  # whatever a plug-in raises is a result of the run
        lanes = failed(f"{type(e).__name__}: {e}".split("\n")[0][:500])
    of = lambda lane: F.col("lane") == lane
    counts = lanes.groupBy("payload_id").agg(F.count_if(of(ROW)).alias("rows"), F.count_if(of(WARNING)).alias("warnings"), F.min(F.when(of(ERROR), F.col("message"))).alias("error"))
    results = landed.select("payload_id", "source").join(counts, "payload_id", "left")
    status = F.when(F.col("error").isNull(), "success").otherwise("failure")
    results = results.select("payload_id", "source", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("warnings", F.lit(0)).alias("warnings"), "error")
    return Feed(canonical(lanes.filter(of(ROW))), lanes.filter(of(WARNING)).select("payload_id", "message"), results)


NESTED = "struct<title:string,release:int,minutes:int,showtimes:array<struct<at:string,shown:string,expired:boolean>>>"
UNREADABLE = "payload can't be read"


@source("nested")
def nested_lanes(spark: SparkSession, landed: DataFrame, now: datetime | None = None) -> DataFrame:
    """A film with its showtimes in one JSON object: a row for each that isn't marked as hidden or over; what the feed doesn't say hides nothing.

    Times are the local clock. One that can't be read is a warning. A programme at the title's end is split off; a film without title has no rows.
    """
    b = identified(landed).select("payload_id", "source", parsed("body", NESTED).alias("b")).select("payload_id", "source", "b.*")
    open_ = F.filter("showtimes", lambda x: F.coalesce(x["shown"] != "0", F.lit(True)) & ~F.coalesce(x["expired"], F.lit(False)))
    shows = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.transform(open_, lambda x, i: F.struct(x["at"].alias("at"), i.alias("feed_pos"))))
    each = b.select("payload_id", F.col("source").alias("venue_id"), "release", "_broken", F.trim("title").alias("title"), F.col("minutes").alias("runtime_min"), F.explode_outer(shows).alias("s"))
    each = each.withColumns({"starts_at": F.expr("try_cast(s.at AS timestamp_ntz)") + F.make_interval(hours=F.lit(times.OFFSET_HOURS)), "_t": programme_suffix(F.col("title"))})
    tags = F.when(F.col("release") == 1, F.array(F.lit("premiere"))).otherwise(F.array().cast("array<string>"))
    each = each.withColumns({"film_title": F.col("_t.title"), "program_name": F.col("_t.program"), "tags": tags, "feed_pos": F.col("s.feed_pos")})
    lane = F.when(F.col("_broken").isNotNull(), ERROR).when(F.col("s").isNull(), None).when(F.col("starts_at").isNull(), WARNING).otherwise(ROW)
    message = F.when(F.col("_broken").isNotNull(), UNREADABLE).when(F.col("starts_at").isNull(), F.concat("title", F.lit(": unreadable time "), F.coalesce("s.at", F.lit("null"))))
    return in_lanes(each, lane, message).filter("lane IS NOT NULL")


def nested_showtimes(spark: SparkSession, landed: DataFrame) -> DataFrame:
    """The canonical rows of nested feeds."""
    return canonical(nested_lanes(spark, landed).filter(F.col("lane") == ROW))


TWO_LISTS = "struct<films:array<struct<code:string,name:string>>,shows:array<struct<code:string,hour:string,complex:string>>>"


def coded_showtimes(landed: DataFrame, complex_id: str) -> tuple[DataFrame, DataFrame]:
    """Shows joined to films by code within a payload, and the shows of unknown films."""
    b = landed.select("source", "day", F.from_json("body", TWO_LISTS).alias("b"))
    films = b.select("source", "day", F.explode("b.films").alias("f")).select("source", "day", F.col("f.code").alias("code"), F.col("f.name").alias("name"))
    shows = b.select("source", "day", F.explode("b.shows").alias("s")).select("source", "day", "s.*").filter(F.col("complex") == complex_id)
    return shows.join(films, ["source", "day", "code"]), shows.join(films, ["source", "day", "code"], "left_anti")


@source("coded")
def coded_lanes(spark: SparkSession, landed: DataFrame, now: datetime | None = None) -> DataFrame:
    """A day's films and shows ('HH:mm' or 'HHmm', local) as two lists of one JSON object (day, complex, films, shows): a row for each show of the payload's complex, under the first film
    of its code. A show of an unknown film or with an unreadable hour is a warning; a payload without a day can't be read."""
    schema = TWO_LISTS[:-1] + ",day:string,complex:string>"
    b = identified(landed).select("payload_id", "source", parsed("body", schema).alias("b")).select("payload_id", "source", "b.*").withColumn("_day", F.expr("try_cast(day AS date)"))
    broken = F.col("_broken").isNotNull() | F.col("_day").isNull()
    shows = F.when(~broken, F.filter(F.transform("shows", lambda x, i: F.struct(x["code"].alias("code"), x["hour"].alias("hour"), x["complex"].alias("place"), i.alias("feed_pos"))), lambda x: x["place"] == F.col("complex")))
    each = b.select("payload_id", F.col("source").alias("venue_id"), "films", "_day", broken.alias("_bad"), F.explode_outer(shows).alias("s"))
    name = F.get(F.filter("films", lambda f: f["code"] == F.col("s.code")), F.lit(0))["name"]
    clock = [F.regexp_extract("s.hour", r"^(\d{1,2}):?(\d{2})$", i).try_cast("int") for i in (1, 2)]
    each = each.withColumns({"film_title": none(F.trim(name)), "starts_at": F.when((clock[0] < 25) & (clock[1] < 60), wall_to_utc(F.col("_day"), *clock)), "feed_pos": F.col("s.feed_pos")})
    lane = F.when(F.col("_bad"), ERROR).when(F.col("s").isNull(), None).when(F.col("film_title").isNull() | F.col("starts_at").isNull(), WARNING).otherwise(ROW)
    message = F.when(F.col("_bad"), UNREADABLE).when(F.col("film_title").isNull(), F.concat(F.lit("unknown film "), F.coalesce("s.code", F.lit("null")))).when(F.col("starts_at").isNull(), F.concat("film_title", F.lit(": unreadable time "), F.coalesce("s.hour", F.lit("null"))))
    return in_lanes(each, lane, message).filter("lane IS NOT NULL")


def merge_details(listing: DataFrame, details: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Listing rows whose missing fields come from one detail for each key."""
    one = details.withColumn("_i", F.row_number().over(W.partitionBy(on).orderBy(*[F.col(c).asc_nulls_last() for c in columns]))).filter("_i = 1")
    d = one.select(on, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = listing.join(d, on, "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def cards(pages: DataFrame) -> DataFrame:
    """Links of a listing page with their labels, each address of a page once."""
    found = F.regexp_extract_all("html", F.lit(r'(?s)<a href="[^"]*">[^<]*</a>'), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    rows = each.select("page_id", "pos", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("label"))
    return rows.withColumn("_i", F.row_number().over(W.partitionBy("page_id", "href").orderBy("pos"))).filter("_i = 1").drop("_i")


def agenda(pages: DataFrame, venue: str, kind: str) -> DataFrame:
    """Cards (article elements) of an agenda page that are of the venue and of the class `kind`, each address of a page once:
    page_id, pos, date, href, title. A card without a date 'yyyy-MM-dd' or a list of places is none."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<article\b.*?</article>"), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("pos", "card")).withColumn("tag", F.regexp_extract("card", r"(?s)^(<article\b[^>]*>)", 1))
    attribute = lambda name: F.regexp_extract("tag", rf"""(?s)\b{name}=["']([^"']*)["']""", 1)
    places = F.regexp_extract_all(F.regexp_replace(attribute("data-locations"), "&quot;", '"'), F.lit(r'"([^"]+)"|([\w-]+)'), F.lit(0))
    here = F.exists(places, lambda x: F.trim(F.translate(x, '"', "")) == venue)
    rows = each.select(
        "page_id", "pos", attribute("data-date").alias("date"), here.alias("here"), F.array_contains(F.split(attribute("class"), r"\s+"), kind).alias("shown"),
        F.regexp_extract("card", r"""(?s)<a\b[^>]*\bhref=["']([^"']*)["']""", 1).alias("href"), F.trim(F.regexp_extract("card", r"(?s)<h3[^>]*>(.*?)</h3>", 1)).alias("title"),
    )
    real = rows.filter(F.col("here") & F.col("shown") & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return real.withColumn("_i", F.row_number().over(W.partitionBy("page_id", "href").orderBy("pos"))).filter("_i = 1").drop("_i", "here", "shown")


def credits(block: Column) -> Column:
    """Labelled lines ('Label: value') as a map from folded labels; of a label that comes twice the first holds."""
    lines = F.filter(F.split(block, r"\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(text.search_fold(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, 1 << 20)).alias("v"))
    first = lambda es: F.filter(es, lambda e, i: F.array_position(F.transform(es, lambda x: x["k"]), e["k"]) == i + 1)
    return F.map_from_entries(text.let(F.transform(lines, entry), first))


def split_title(c: Column) -> Column:
    """A raw event title as (title, director, year, programme): quoted span, (director, year), bare year, Dir., de Name."""
    head = F.regexp_extract(c, r'^([^:"“]{2,40}):\s*.*["“]', 1)
    body = F.when(head != "", F.regexp_replace(c, r'^[^:"“]{2,40}:\s*', "")).otherwise(c)
    pair, bare = r"\(([^(),]+),\s*((?:18|19|20)\d\d)\)", r"\(((?:18|19|20)\d\d)\)"
    quoted = F.regexp_extract(body, r'["“]([^"”]+)["”]', 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, pair, ""), bare, ""), r"\s+(?:Dir\.\s*.+|de\s+\p{Lu}\S+(?:\s+\p{Lu}\S+)+)$", ""))
    none = lambda x: F.nullif(x, F.lit(""))
    return F.struct(
        F.coalesce(none(quoted), none(plain), c).alias("title"),
        F.coalesce(none(F.regexp_extract(body, pair, 1)), none(F.regexp_extract(body, r"\bDir\.\s*(.+)$", 1)), none(F.regexp_extract(body, r"\bde\s+(\p{Lu}\S+(?:\s+\p{Lu}\S+)+)$", 1))).alias("director"),
        valid_year(F.coalesce(none(F.regexp_extract(body, pair, 2)), none(F.regexp_extract(body, bare, 1))).cast("int")).alias("year"),
        none(F.trim(head)).alias("program"),
    )


def valid_year(year: Column, this_year: int = 2024) -> Column:
    return F.when(year.between(1888, this_year + 2), year)


# Words that begin a programme's name behind a title.
SUFFIX_WORDS = ("CICLO", "RETROSPECTIVA", "FOCO", "MUESTRA", "HOMENAJE")


def programme_suffix(c: Column) -> Column:
    """(title, programme) of 'TITLE - CICLO X': what stands behind the first dash that a programme's word follows; a title is never left empty."""
    whole = rf"(?is)^(.*?)\s*[-–—]\s*((?:{'|'.join(SUFFIX_WORDS)})\b.*)$"
    head = F.trim(F.regexp_extract(c, whole, 1))
    return F.struct(F.when(head != "", head).otherwise(c).alias("title"), F.when(head != "", F.trim(F.regexp_extract(c, whole, 2))).alias("program"))


def shift_suffix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\d{1,2}/\d{1,2}\s*-\s*(?:Primer|Segundo|Tercer) Turno\s*$", ""))


def poster_title(c: Column) -> Column:
    """A title without outer quotes and a year at its end, stripped in turn until nothing changes: each time takes two characters or more."""
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\(\d{4}\)\s*$", ""), r'^["“«](.*)["”»]$', "$1"))
    times_ = F.sequence(F.lit(1), F.floor(F.length(c) / 2).cast("int") + 1)
    return F.aggregate(times_, F.trim(c), lambda x, _: strip(x))


def showtime_line(c: Column) -> Column:
    """(time, title, director) of '18:00 Title (95') de Director'."""
    s = F.regexp_replace(c, r"\s*\(\d+['’]\)", "")
    return F.struct(F.regexp_extract(s, r"^(\d{1,2}:\d{2})", 1).alias("time"), F.trim(F.regexp_extract(s, r"^\d{1,2}:\d{2}\s+(.+?)(?:\s+de\s+\p{Lu}.*)?$", 1)).alias("title"),
                    F.nullif(F.regexp_extract(s, r"\s+de\s+(\p{Lu}.*)$", 1), F.lit("")).alias("director"))


def expand_schedule(films: DataFrame, first: str, last: str, times_column: str) -> DataFrame:
    """Every film on every day of its range at each of its times."""
    days = films.withColumn("day", F.explode(F.sequence(F.col(first), F.col(last))))
    return days.withColumn("time", F.explode(times_column))


#: Short weekday names of weekly grids, from Thursday, when the cinema week starts.
GRID_DAYS = ("Ju", "Vi", "Sa", "Do", "Lu", "Ma", "Mi")


def weekly_grid(df: DataFrame, line: str, today: Column) -> DataFrame:
    """'Ju - Vi | 16:55, 19:10' on the most recent Thursday's week: one row for each distinct day and time."""
    anchor = F.date_sub(today, F.pmod(F.dayofweek(today) - 5, F.lit(7)))
    offset = lambda d: F.array_position(F.array(*[F.lit(x) for x in GRID_DAYS]), F.trim(d)) - 1
    parts = F.split(F.col(line), r"\|")
    days = F.array_distinct(F.filter(F.transform(F.split(parts[0], "-"), offset), lambda i: i >= 0))
    hours = F.array_distinct(F.regexp_extract_all(parts[1], F.lit(r"(\d{1,2}:\d{2})"), F.lit(1)))
    each = df.withColumn("_d", F.explode(days)).withColumn("time", F.explode(hours))
    return each.withColumn("day", F.date_add(anchor, F.col("_d").cast("int"))).drop("_d")


def wall_to_utc(day: Column, hour: Column, minute: Column) -> Column:
    """The instant of a local wall time; hour 24 is the next day's midnight."""
    return day.cast("timestamp_ntz") + F.make_interval(hours=hour + times.OFFSET_HOURS, mins=minute)


def spanish_date(c: Column) -> Column:
    """'5 de marzo de 2024, 20:30' as an instant; null for a day that isn't."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(times.MONTHS) for x in (m, i + 1)])
    part = lambda i: F.regexp_extract(F.lower(c), r"(\d{1,2}) de (\p{L}+) de (\d{4}),? (\d{1,2}):(\d{2})", i)
    day = F.try_make_timestamp(F.nullif(part(3), F.lit("")).cast("int"), names[part(2)], F.nullif(part(1), F.lit("")).cast("int"), F.lit(0), F.lit(0), F.lit(0.0), F.lit("UTC"))
    return wall_to_utc(F.to_date(day), F.nullif(part(4), F.lit("")).cast("int"), F.nullif(part(5), F.lit("")).cast("int"))


def inferred_year(df: DataFrame, start: Column, end: Column | None, now: datetime) -> DataFrame:
    """Month-day ranges ('MM-dd') with the year that fits: a dated run not over by more than 30 days, an
    open one that starts within 240; a start over 120 days ahead gives null."""
    today = F.lit(f"{now:%Y-%m-%d}").cast("date")
    date = lambda md: F.expr("try_to_date(x, 'yyyy-MM-dd')") if md is None else F.try_to_date(F.concat(F.col("_y").cast("string"), F.lit("-"), md), "yyyy-MM-dd")
    each = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_y", F.explode(F.array(*[F.lit(now.year + k) for k in (-1, 0, 1)])))
    first, last = date(start), date(end) if end is not None else F.lit(None).cast("date")
    last = F.when(last < first, F.add_months(last, 12)).otherwise(last)
    fits = F.when(last.isNotNull(), F.datediff(today, last) <= 30).otherwise(F.abs(F.datediff(first, today)) <= 240)
    keys = [c for c in each.columns if c not in ("_y",)]
    best = each.groupBy(*keys).agg(F.min(F.when(fits, first)).alias("first_day"))
    return best.withColumn("first_day", F.when(F.datediff("first_day", today) <= 120, F.col("first_day"))).drop("_id")


def carry_months(lines: DataFrame, page: str, pos: str, day: str, month: str, first_month: Column) -> DataFrame:
    """Days down a page, some without month: a lower day than the one before starts the next month; a stated month holds on.

    Gives `carried`, the month, and `years`, how many years later than the first line: a lower month than the line before is next year's.
    """
    order = W.partitionBy(page).orderBy(pos)
    stated = F.count(F.col(month)).over(order)
    run = W.partitionBy(page, "_stated").orderBy(pos)
    base = lines.withColumn("_stated", stated)
    turn = (F.col(month).isNull() & (F.col(day) < F.lag(day).over(order))).cast("int")
    base = base.withColumn("_turn", F.coalesce(turn, F.lit(0)))
    start = F.coalesce(F.first(F.col(month), ignorenulls=True).over(run), first_month)
    carried = start + F.sum("_turn").over(run.rowsBetween(W.unboundedPreceding, 0))
    base = base.withColumn("carried", F.pmod(carried - 1, F.lit(12)) + 1)
    base = base.withColumn("_new", F.coalesce((F.col("carried") < F.lag("carried").over(order)).cast("int"), F.lit(0)))
    years = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return base.withColumn("years", years).drop("_stated", "_turn", "_new")


def weekday_year(df: DataFrame, month: str, day: str, weekday: str, years: list[int]) -> DataFrame:
    """The year in which the date has that weekday (0: Monday), if there is exactly one."""
    dates = F.transform(F.array(*[F.lit(y) for y in years]), lambda y: F.struct(y.alias("y"), F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(F.col(month).cast("string"), 2, "0"), F.lpad(F.col(day).cast("string"), 2, "0")), "yyyy-MM-dd").alias("d")))
    fit = F.filter(dates, lambda x: F.weekday(x["d"]) == F.col(weekday))
    return df.withColumn("year", F.when(F.size(fit) == 1, fit[0]["y"]))


def blocks(lines: DataFrame, page: str, pos: str, header: Column, time: Column, shorts: Column | None = None) -> DataFrame:
    """Lines of a page folded into blocks that each start with a header: its text, its times, its number of lines.

    A block with a line of `shorts` is a programme of short films, which no single film stands for: it is left out, and the
    page's number of those is `skipped` in each row of the page.
    """
    order = W.partitionBy(page).orderBy(pos)
    numbered = lines.withColumn("_h", header).withColumn("block", F.sum(header.cast("int")).over(order)).filter("block > 0")
    short = F.lit(False) if shorts is None else F.coalesce(shorts, F.lit(False))
    folded = numbered.groupBy(page, "block").agg(
        F.min_by("line", F.when(F.col("_h"), F.col(pos))).alias("title"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(time != "", F.struct(pos, time.alias("t"))))), lambda x: x["t"]), " ").alias("times"),
        F.max(short).alias("_short"),
    )
    return folded.withColumn("skipped", F.count_if("_short").over(W.partitionBy(page))).filter(~F.col("_short")).drop("_short")


def largest_image(pages: DataFrame, marker: str = "", fallback: str = "") -> DataFrame:
    """Of a page's images (name-WxH.ext) with the marker in their name the largest, one of unknown size last, the first of equals; else
    the first whose name has the fallback."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<img src="([^"]+)"'), F.lit(1))).alias("pos", "src"))
    area = F.regexp_extract("src", r"-(\d+)x\d+\.", 1).try_cast("long") * F.regexp_extract("src", r"-\d+x(\d+)\.", 1).try_cast("long")
    best = F.max_by("src", F.when(F.col("src").contains(marker), F.struct(F.coalesce(area, F.lit(0).cast("long")), -F.col("pos"))))
    return each.groupBy("page_id").agg(F.coalesce(best, F.min_by("src", F.when(F.col("src").contains(fallback), F.col("pos")))).alias("src"))


# How a text's writer is credited at its end.
ATTRIBUTION = r"(?i)\s+Texto\s*(?:de|:)\s+[^.]+\.?\s*$"


def longest_block(parts: Column, floor: int) -> Column:
    """The longest of an array of texts, the first of equals, without its writer's credit, if it then has `floor` letters."""
    ordered = F.array_sort(F.transform(parts, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    plain = F.trim(F.regexp_replace(F.get(ordered, F.lit(0))["x"], ATTRIBUTION, ""))
    return text.let(plain, lambda x: F.when(F.length(x) >= floor, x))


def anchor_year(html: Column) -> Column:
    """The year that a page's metadata gives as that of its publication: its linked data, else its meta element."""
    script = F.array_join(F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1)), " ")
    linked = F.regexp_extract(script, r'"datePublished"\s*:\s*"(\d{4})-', 1)
    meta = F.regexp_extract(html, r'<meta[^>]*property="article:published_time"[^>]*content="(\d{4})-', 1)
    return F.coalesce(none(linked), none(meta)).cast("int")


def earliest_month(c: Column) -> Column:
    """The number of the month that a text names first."""
    at = [F.struct(F.nullif(F.locate(m, F.lower(c)), F.lit(0)).alias("at"), F.lit(i + 1).alias("m")) for i, m in enumerate(times.MONTHS)]
    return F.array_min(F.filter(F.array(*at), lambda x: x["at"].isNotNull()))["m"]


def label_tags(labels: Column) -> Column:
    """Tags from an array of labels: a premiere, a single showing, and a cycle where there is any label."""
    folded = F.transform(labels, text.search_fold)
    has = lambda p: F.exists(folded, lambda x: x.startswith(p))
    return F.array_compact(F.array(F.when(has("estreno"), F.lit("premiere")), F.when(has("funcion especial"), F.lit("unique")), F.when(F.size(labels) > 0, F.lit("cycle"))))


def keyword_tags(c: Column) -> Column:
    f = text.search_fold(c)
    return F.array_compact(F.array(F.when(f.contains("retrospectiva"), F.lit("retrospective")), F.when(f.contains("restaurad"), F.lit("restored")), F.when(f.contains("estreno"), F.lit("premiere"))))


def release_week(day: Column, release: Column) -> Column:
    return (F.datediff(day, release) >= 0) & (F.datediff(day, release) < 7)


def series_key(url: Column) -> Column:
    """The address of an event without the date at its end."""
    return F.regexp_replace(url, r"[-/]\d+(?:-\d+)*(?:\.html)?/?(?:[?#].*)?$", "")


def host_allowed(url: Column, hosts: list[str]) -> Column:
    host = F.parse_url(url, F.lit("HOST"))
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return F.coalesce(out, F.lit(False))


def unchanged(landed: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """Payloads whose content and parser version were not processed before."""
    stamp = F.sha2(F.concat("body", F.lit(version)), 256)
    return landed.withColumn("stamp", stamp).join(ledger.select("stamp"), "stamp", "left_anti")
