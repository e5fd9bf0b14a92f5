"""Operator 12: times written in mixed layouts as UTC microseconds.

Each layout is guarded by its shape and read by try_to_timestamp, and the layouts are coalesced. Slashed dates that are dates
in both orders are the only rows that branch off: they are joined with the votes of their source, counted before the join.
Rows whose zone decides are joined with one row for each distinct zone and wall minute, whose offset is worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import join_unique, materialize, named, table

BLANKS = " \t\n\x0b\x0c\r"
_DATE = r"20[0-9]{2}-[0-9]{2}-[0-9]{2}|20[0-9]{6}|[0-9]{2}\.[0-9]{2}\.20[0-9]{2}|[0-9]{2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}|[0-9]{2}/[0-9]{2}/20[0-9]{2}"
_TIME = r"(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP]M))?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?"
STAMP = rf"\A({_DATE}){_TIME}\z"
#: Shape of the date and how it is read; slashed dates are read in both orders.
LAYOUTS = (("____-__-__", "yyyy-MM-dd"), ("________", "yyyyMMdd"), ("__.__.____", "dd.MM.yyyy"), ("__ ___ ____", "dd MMM yyyy"))
SLASHED = "__/__/____"
DAY_FIRST, MONTH_FIRST = "dd/MM/yyyy", "MM/dd/yyyy"
#: Tasks over which the open rows of a source are spread.
SALTS = 64
SECOND = 1_000_000
MINUTE = 60 * SECOND
DAY = 86_400 * SECOND


def _wall(date: Column, clock: Column, layout: str) -> Column:
    """Microseconds of the wall time as if it were in UTC, whatever the session's zone; null if there is no such time."""
    return F.unix_micros(F.try_to_timestamp(F.concat(date, F.lit(" "), clock, F.lit("Z")), F.lit(f"{layout} HH:mm:ssXXX")))


def parsed(stamps: DataFrame, keep: list[str], raw_col: str, zone_col: str, source_col: str) -> DataFrame:
    """k0.. (the columns `keep`), zone, source, state (bad, epoch, plain, open), utc, shift, wall, day_first, month_first and a salt of every row.

    utc is known of epochs, shift (microseconds of the written offset) where there is one, wall of plain stamps. Open stamps have
    both of day_first and month_first, plain slashed ones of a single order just that one.
    """
    text = F.btrim(named(raw_col).cast("string"), F.lit(BLANKS))
    held = stamps.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(zone_col).cast("string").alias("zone"), named(source_col).cast("string").alias("source"), text.alias("raw"))
    digits, fits = F.col("raw").rlike(r"\A[0-9]+\z"), F.col("raw").rlike(STAMP)
    seconds, millis = digits & (F.length("raw") == 10), digits & (F.length("raw") == 13)
    epoch = F.when(seconds, F.col("raw").cast("long") * SECOND).when(millis, F.col("raw").cast("long") * 1_000)
    cut = held.withColumns({"utc": epoch, "part": F.when(fits, F.split(F.regexp_replace("raw", STAMP, "$1|$2|$3|$4|$5|$6"), r"\|"))})
    date, h, m, s, half, shift = (F.get("part", i) for i in range(6))
    hour = F.when(half == "", h).when(h.between("01", "12"), F.lpad((h.cast("int") % 12 + F.when(half == "PM", 12).otherwise(0)).cast("string"), 2, "0"))
    clock = F.when(h == "", "00:00:00").otherwise(F.concat(hour, F.lit(":"), m, F.lit(":"), F.when(s == "", "00").otherwise(s)))
    far_h, far_m = F.substring(shift, 2, 2), F.substring(shift, -2, 2)
    far = (far_h.cast("long") * 60 + far_m.cast("long")) * MINUTE * F.when(shift.startswith("-"), -1).otherwise(1)
    offset = F.when(shift == "Z", F.lit(0).cast("long")).when(far_h.between("00", "14") & far_m.between("00", "59"), far)
    read = cut.select("*", date.alias("date"), clock.alias("clock"), offset.alias("shift"), ((shift != "") & offset.isNull()).alias("broken"))
    date, clock = F.col("date"), F.col("clock")
    sure = F.coalesce(*[F.when(date.like(shape), _wall(date, clock, layout)) for shape, layout in LAYOUTS])
    walls = read.withColumns({"wall": sure, **{name: F.when(date.like(SLASHED), _wall(date, clock, layout)) for name, layout in (("day_first", DAY_FIRST), ("month_first", MONTH_FIRST))}})
    placed = F.col("shift").isNotNull() | F.coalesce(known_zone(F.col("zone"), stamps.sparkSession), F.lit(False))
    some = F.coalesce("wall", "day_first", "month_first")
    two = F.coalesce(F.col("day_first") != F.col("month_first"), F.lit(False))
    state = F.when(F.col("utc").isNotNull(), "epoch").when(some.isNull() | F.coalesce("broken", F.lit(False)) | ~placed, "bad").when(two, "open").otherwise("plain")
    return walls.select(*[f"k{i}" for i in range(len(keep))], "zone", "source", state.alias("state"), "utc", "shift", F.when(~two, some).alias("wall"), "day_first", "month_first", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))


def known_zone(zone: Column, spark: SparkSession) -> Column:
    """Whether it is a region of the zone database (some 600 names) or an offset such as +05:30."""
    names = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return zone.isin(sorted(names)) | zone.rlike(r"\A[+-](0[0-9]|1[0-7]):[0-5][0-9]\z")


def source_votes(rows: DataFrame) -> DataFrame:
    """(source key, winner): d or m for a source of which slashed dates of a single order show more of one than of the other."""
    single = rows.filter("state = 'plain' and (day_first is null) <> (month_first is null)")
    counts = single.groupBy(_source().alias("of")).agg(F.count("day_first").alias("d"), F.count("month_first").alias("m"))
    return counts.filter("d <> m").select("of", F.when(F.col("d") > F.col("m"), "d").otherwise("m").alias("winner"))


def _source() -> Column:
    """A source as a join key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def offsets(places: DataFrame) -> DataFrame:
    """(place, before, odd) of distinct places (zone, minute): microseconds by which the zone is ahead at that wall minute, before
    the change if the zone skips or repeats it, and whether it does."""
    zone, wall = F.col("place.zone"), F.col("place.minute") * MINUTE
    local = lambda utc: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))
    first = places.withColumn("utc", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone)))
    later = local(F.col("utc") + DAY) - F.col("utc") - DAY  # no zone changes twice within a day
    seen = first.select("place", "utc", (wall - F.col("utc")).alias("before"), later.alias("later"))
    skipped = local(F.col("utc")) != wall
    repeated = (F.col("later") != F.col("before")) & (local(wall - F.col("later")) == wall)
    return seen.select("place", "before", (skipped | repeated).alias("odd"))


def normalise(stamps: DataFrame, keep: list[str], raw_col: str = "raw", zone_col: str = "zone", source_col: str = "source") -> DataFrame:
    """The columns `keep`, utc_us (null if bad), rule (bad, epoch, votes, default, plain) and ambiguous, of every row.

    Null, empty, impossible and other texts are bad, however long they are; so is a stamp without an offset whose zone is null
    or unknown. Bad stamps never vote. A null source is a source of its own. Equal counts of votes, none included, are
    no majority. Repeated rows are kept and vote each; an empty table gives no rows. A kept column that is called like an
    output gives way to it, and other columns may have any names.
    """
    keep = [c for c in keep if c.lower() not in ("utc_us", "rule", "ambiguous")]
    rows = materialize(parsed(stamps, keep, raw_col, zone_col, source_col))
    kept = [f"k{i}" for i in range(len(keep))]
    open_rows = rows.filter("state = 'open'").select(*kept, "zone", "shift", "day_first", "month_first", "salt", _source().alias("of"))
    # Each source's winner goes to all salts, so that no source's rows meet in one task.
    winners = source_votes(rows).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    voted = open_rows.join(winners, ["of", "salt"], "left")
    wall = F.when(F.col("winner") == "d", F.col("day_first")).otherwise(F.col("month_first"))
    rule = F.when(F.col("winner").isNull(), "default").otherwise("votes")
    decided = voted.select(*kept, "zone", "shift", wall.alias("wall"), rule.alias("rule"))
    plain = rows.filter("state = 'plain'").select(*kept, "zone", "shift", "wall", F.lit("plain").alias("rule"))
    done = rows.filter("state in ('bad', 'epoch')").select(*kept, "utc", F.col("state").alias("rule"), F.lit(False).alias("ambiguous"))
    place = F.when(F.col("shift").isNull(), F.struct("zone", F.floor(F.col("wall") / MINUTE).cast("long").alias("minute")))
    dated = materialize(decided.unionByName(plain).select(*kept, "shift", "wall", "rule", place.alias("place")))
    choice = F.col("rule") != "plain"
    written = dated.filter("shift is not null").select(*kept, (F.col("wall") - F.col("shift")).alias("utc"), "rule", choice.alias("ambiguous"))
    zoned = dated.filter("shift is null").select(*kept, "wall", "rule", "place")
    met = join_unique(zoned, offsets(zoned.select("place").distinct()), "place")
    resolved = met.select(*kept, (F.col("wall") - F.col("before")).alias("utc"), "rule", (choice | F.col("odd")).alias("ambiguous"))
    return done.unionByName(written).unionByName(resolved).toDF(*keep, "utc_us", "rule", "ambiguous")


def op12_mixed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(table(spark, sf_dir, "stamps"), ["stamp_id"])


_HOUR = "CASE WHEN half = '' THEN h WHEN h BETWEEN '01' AND '12' THEN lpad(CAST(CAST(h AS INT) % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END AS VARCHAR), 2, '0') END"
OP12_SQL = rf"""
WITH raw AS (SELECT stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS raw FROM stamps),
cut AS (SELECT *, regexp_extract(raw, '^({_DATE}){_TIME}$', ['day', 'h', 'm', 's', 'half', 'far']) AS p, regexp_full_match(raw, '({_DATE}){_TIME}') AS fits FROM raw),
part AS (SELECT stamp_id, source, zone, raw, fits, p.day AS day, p.h AS h, p.m AS m, p.s AS s, p.half AS half, p.far AS far FROM cut),
clocked AS (
  SELECT *, CASE WHEN h = '' THEN '00:00:00' ELSE {_HOUR} || ':' || m || ':' || CASE s WHEN '' THEN '00' ELSE s END END AS clock,
    CASE WHEN far = '' THEN NULL WHEN far = 'Z' THEN 0 WHEN far[2:3] <= '14' AND far[-2:] <= '59'
      THEN (CAST(far[2:3] AS BIGINT) * 60 + CAST(far[-2:] AS BIGINT)) * 60000000 * CASE far[1] WHEN '-' THEN -1 ELSE 1 END END AS shift
  FROM part),
walls AS (
  SELECT *, epoch_us(CASE WHEN day LIKE '____-__-__' THEN try_strptime(day || ' ' || clock, '%Y-%m-%d %H:%M:%S') WHEN day LIKE '________' THEN try_strptime(day || ' ' || clock, '%Y%m%d %H:%M:%S')
      WHEN day LIKE '__.__.____' THEN try_strptime(day || ' ' || clock, '%d.%m.%Y %H:%M:%S') WHEN day LIKE '__ ___ ____' THEN try_strptime(day || ' ' || clock, '%d %b %Y %H:%M:%S') END) AS sure,
    epoch_us(CASE WHEN day LIKE '__/__/____' THEN try_strptime(day || ' ' || clock, '%d/%m/%Y %H:%M:%S') END) AS dm,
    epoch_us(CASE WHEN day LIKE '__/__/____' THEN try_strptime(day || ' ' || clock, '%m/%d/%Y %H:%M:%S') END) AS md
  FROM clocked),
sorted AS (
  SELECT *, CASE WHEN regexp_full_match(raw, '[0-9]{{10}}|[0-9]{{13}}') THEN 'epoch' WHEN NOT coalesce(fits, false) OR coalesce(sure, dm, md) IS NULL OR (far <> '' AND shift IS NULL) OR (shift IS NULL AND zone IS NULL) THEN 'bad'
    WHEN dm <> md THEN 'open' ELSE 'plain' END AS state
  FROM walls),
votes AS (SELECT source, count(dm) AS d, count(md) AS m FROM sorted WHERE state = 'plain' AND (dm IS NULL) <> (md IS NULL) GROUP BY source),
decided AS (
  SELECT stamp_id, raw, zone, state, shift, CASE WHEN state <> 'open' THEN state WHEN coalesce(d, 0) <> coalesce(votes.m, 0) THEN 'votes' ELSE 'default' END AS rule,
    CASE WHEN state = 'open' THEN CASE WHEN coalesce(d, 0) > coalesce(votes.m, 0) THEN dm ELSE md END ELSE coalesce(sure, dm, md) END AS wall
  FROM sorted LEFT JOIN votes ON sorted.source IS NOT DISTINCT FROM votes.source),
around AS (
  SELECT *, epoch_us(timezone(zone, make_timestamptz(wall - 86400000000))) - wall + 86400000000 AS o1, epoch_us(timezone(zone, make_timestamptz(wall + 86400000000))) - wall - 86400000000 AS o2
  FROM decided WHERE rule NOT IN ('bad', 'epoch') AND shift IS NULL),
met AS (SELECT *, epoch_us(timezone(zone, make_timestamptz(wall - o1))) = wall AS v1, epoch_us(timezone(zone, make_timestamptz(wall - o2))) = wall AS v2 FROM around)
SELECT stamp_id, CASE WHEN NOT v1 AND v2 THEN wall - o2 ELSE wall - o1 END AS utc_us, rule, rule <> 'plain' OR (o1 <> o2 AND v1 = v2) AS ambiguous FROM met
UNION ALL
SELECT stamp_id, CASE WHEN rule = 'bad' THEN NULL WHEN rule = 'epoch' THEN CAST(raw AS BIGINT) * CASE length(raw) WHEN 10 THEN 1000000 ELSE 1000 END ELSE wall - shift END, rule, rule IN ('votes', 'default')
FROM decided WHERE rule IN ('bad', 'epoch') OR shift IS NOT NULL
"""
