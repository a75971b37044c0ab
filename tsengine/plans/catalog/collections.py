"""Queries on collections of ragged series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.operators import series_sets
from tsengine.plans import competition
from tsengine.plans.catalog.registry import digest, query, r
from tsengine.plans.tables import GROUP_FREQUENCY, GROUP_HORIZON, GROUP_NAMES, ragged, series_file, vectors
from tsengine.session import scratch_path
from tsengine.sources import readers, writers

_E = """e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS j FROM embeddings)"""
# The series-per-row file after coercion and compaction: surviving cells, renumbered.
_CELLS = f"""{_E},
cells AS (SELECT vec_id, round(v,6) AS v, row_number() OVER (PARTITION BY vec_id ORDER BY j)-1 AS pos FROM e
          WHERE j < 40+vec_id%25 AND (vec_id+j)%17<>0 AND (vec_id+j)%13<>0 AND (vec_id+j)%29<>0)"""


def _pick(values) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"[{items}][vec_id%6+1]"


# Ragged numeric series with their group.
_RAGGED = f"""{_E},
ragged AS (SELECT vec_id AS series_id, {_pick(GROUP_NAMES)} AS grp, {_pick(GROUP_FREQUENCY)} AS frequency,
                  {_pick(GROUP_HORIZON)} AS horizon, 40+vec_id%25 AS len, j AS pos, v FROM e WHERE j < 40+vec_id%25)"""


SIX = (6, 6)  # text cells have six decimals: coarser rounding would meet ties


def _sum(name: str, keep: str = "TRUE", pos: str = "pos", digits: tuple[int, int] = (5, 4)) -> str:
    """Digest figures over the rows that satisfy ``keep``; zero rows give zeros."""
    return (
        f"(count(*) FILTER ({keep}))::INT AS {name}_n, round(coalesce(sum(v) FILTER ({keep}),0),{digits[0]})+0.0 AS {name}_sum, "
        f"round(coalesce(sum(({pos}+1)*v) FILTER ({keep}),0),{digits[1]})+0.0 AS {name}_weighted"
    )


def _land(spark, folder, keep=None):
    path = scratch_path(spark, "series")
    df = series_file(spark, folder)
    (df.filter(keep) if keep is not None else df).write.option("header", True).csv(path)
    return path


@query("scan_series_rows", f"WITH {_CELLS} SELECT 'S' || vec_id AS series_id, {_sum('values', digits=SIX)} FROM cells GROUP BY vec_id")
def scan_series_rows(spark, folder):
    return readers.series_rows(spark, _land(spark, folder)).select("series_id", *digest("values", SIX))


@query("compact_series", f"WITH {_CELLS} SELECT 'S' || vec_id AS series_id, pos::INT AS pos, round(v,6)+0.0 AS v FROM cells")
def compact_series(spark, folder):
    raw = series_file(spark, folder)
    made = raw.select(F.col("V1").alias("series_id"), series_sets.coerce_values(F.array(*raw.columns[1:])).alias("values"))
    return made.select("series_id", F.posexplode("values").alias("pos", "v")).select("series_id", "pos", r("v").alias("v"))


def _land_info(spark, folder):
    """Info rows for nine of ten ids, and for some ids that have no series."""
    rows = ragged(spark, folder).select(
        F.concat(F.when(F.col("series_id") % 10 == 9, "N").otherwise("S"), "series_id").alias("M4id"),
        F.col("grp").alias("SP"),
        F.col("frequency").alias("Frequency"),
        F.col("horizon").alias("Horizon"),
    )
    path = scratch_path(spark, "info")
    rows.select("M4id", F.lit("note").alias("category"), "Frequency", "Horizon", "SP").write.option("header", True).csv(path)
    return path


_INFO = f"""info AS (SELECT CASE WHEN vec_id%10=9 THEN 'N' ELSE 'S' END || vec_id AS series_id, {_pick(GROUP_NAMES)} AS grp,
            {_pick(GROUP_FREQUENCY)} AS frequency, {_pick(GROUP_HORIZON)} AS horizon FROM embeddings)"""


@query("load_info", f"WITH {_INFO} SELECT * FROM info")
def load_info(spark, folder):
    return readers.info(spark, _land_info(spark, folder)).drop("info_ord")


@query(
    "info_series_join",
    f"""WITH {_CELLS}, {_INFO},
        s AS (SELECT 'S' || vec_id AS series_id, {_sum('values', 'vec_id%3<>0 OR pos<5', digits=SIX)} FROM cells GROUP BY vec_id)
        SELECT series_id, grp, frequency, horizon, coalesce(values_n,0) AS values_n, coalesce(values_sum,0) AS values_sum,
               coalesce(values_weighted,0) AS values_weighted, info.series_id IS NULL AS unknown
        FROM info FULL JOIN s USING (series_id)""",
)
def info_series_join(spark, folder):
    """Every third id comes again in a later file with its first five values; the later row wins."""
    first = readers.series_rows(spark, _land(spark, folder), 0)
    again = first.filter(F.substring("series_id", 2, 20).cast("bigint") % 3 == 0).select(
        "series_id", F.slice("values", 1, 5).alias("values"), F.lit(1).alias("file_ord"), "row_ord"
    )
    joined = series_sets.attach_info(first.unionByName(again), readers.info(spark, _land_info(spark, folder)))
    return joined.select("series_id", "grp", "frequency", "horizon", *digest("values", SIX), F.col("ord")["unknown"].alias("unknown"))


@query(
    "info_output_order",
    f"""WITH {_INFO}, ids AS (SELECT series_id, 0 AS part, CAST(substr(series_id, 2) AS BIGINT) AS k FROM info
        UNION ALL SELECT 'S' || vec_id, 1, vec_id FROM embeddings WHERE vec_id % 10 = 9)
        SELECT series_id, row_number() OVER (ORDER BY part, k) - 1 AS position FROM ids""",
)
def info_output_order(spark, folder):
    """Ids of the info table in its order, then unknown ids in the order they were first read; several files of each."""
    by_id = lambda c: F.substring(c, 2, 20).cast("bigint")
    paths = []
    for table, key in ((spark.read.option("header", True).csv(_land_info(spark, folder)), "M4id"), (series_file(spark, folder), "V1")):
        path = scratch_path(spark, "ordered")
        table.repartitionByRange(4, by_id(key)).sortWithinPartitions(by_id(key)).write.option("header", True).csv(path)
        paths.append(path)
    joined = series_sets.attach_info(readers.series_rows(spark, paths[1]), readers.info(spark, paths[0]))
    return series_sets.output_order(joined).select("series_id", "position")


@query(
    "group_meta_join",
    f"WITH {_RAGGED} SELECT DISTINCT series_id, grp, horizon AS grp_horizon, frequency AS grp_frequency FROM ragged",
)
def group_meta_join(spark, folder):
    joined = series_sets.attach_meta(ragged(spark, folder), series_sets.group_meta(spark))
    return joined.select("series_id", "grp", "grp_horizon", "grp_frequency")


_SHEETS = ["M3Year", "M3Quart", "M3Month", "M3Other"]


@query(
    "scan_grouped_sheets",
    f"""WITH {_CELLS} SELECT 'N' || vec_id AS series_id, ['M3Year','M3Quart','M3Month','M3Other'][vec_id%4+1] AS grp,
        (vec_id%4)::INT AS grp_ord, [6,8,18,8][vec_id%4+1] AS horizon, {_sum('values', digits=SIX)} FROM cells GROUP BY vec_id""",
)
def scan_grouped_sheets(spark, folder):
    landed = _land_sheets(spark, folder)
    return readers.grouped_sheets(spark, landed).select("series_id", "grp", "grp_ord", "horizon", *digest("values", SIX))


def _land_sheets(spark, folder):
    """The series file as four sheets, one per group."""
    raw = series_file(spark, folder).withColumn("_id", F.substring("V1", 2, 20).cast("bigint"))
    horizons = {g: h for g, h, _ in series_sets.GROUPS}
    landed = []
    for i, group in enumerate(_SHEETS):
        path = scratch_path(spark, group)
        # The six leading columns of a sheet.
        head = [F.concat(F.lit(" N"), "_id").alias("Series"), F.lit(64).alias("N"), F.lit(horizons[group]).alias("NF"),
                F.lit("MICRO").alias("Category"), F.lit(1990).alias("Starting Year"), F.lit(1).alias("Starting Month")]
        cells = [F.col(f"V{k + 2}").alias(str(k + 1)) for k in range(64)]
        raw.filter(F.col("_id") % 4 == i).select(*head, *cells).write.option("header", True).csv(path)
        landed.append((group, path))
    return landed


@query(
    "build_grouped_collection",
    f"""WITH {_CELLS}, g AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS len, [6,8,18,8][vec_id%4+1] AS h FROM cells)
        SELECT 'N' || vec_id AS series_id, ['M3Year','M3Quart','M3Month','M3Other'][vec_id%4+1] AS grp, any_value(h) AS horizon,
        {_sum('train', 'pos < len-2*h', digits=SIX)}, {_sum('test', 'pos >= len-h', '(pos-len+h)', SIX)}
        FROM g WHERE len > h GROUP BY vec_id""",
)
def build_grouped_collection(spark, folder):
    """Sheets to cache; the train part is read back as the subset without another horizon."""
    cache = competition.build_grouped(spark, _land_sheets(spark, folder), scratch_path(spark, "grouped"))
    train = competition.training_subset(writers.load_series_cache(spark, cache)).withColumnRenamed("values", "train")
    test = writers.load_series_cache(spark, cache, training=False).select("series_id", F.col("values").alias("test"))
    return train.join(test, "series_id").select("series_id", "grp", "horizon", *digest("train", SIX), *digest("test", SIX))


@query(
    "build_indexed_collection",
    f"""WITH {_CELLS}, {_INFO}, s AS (SELECT 'S' || vec_id AS series_id, {_sum('values', digits=SIX)} FROM cells WHERE vec_id%2=0 GROUP BY vec_id),
        t AS (SELECT 'S' || vec_id AS series_id, {_sum('values', digits=SIX)} FROM cells WHERE vec_id%2=1 GROUP BY vec_id),
        b AS (SELECT 'train' AS part, series_id, grp, horizon, values_n, values_sum, values_weighted FROM info FULL JOIN s USING (series_id)
              UNION ALL SELECT 'test', series_id, grp, horizon, values_n, values_sum, values_weighted FROM info FULL JOIN t USING (series_id))
        SELECT part, series_id, grp, horizon, coalesce(values_n,0) AS values_n, coalesce(values_sum,0) AS values_sum,
               coalesce(values_weighted,0) AS values_weighted FROM b""",
)
def build_indexed_collection(spark, folder):
    """Even ids as the train files, odd ones as the test files."""
    number = F.substring("V1", 2, 20).cast("bigint")
    train, test = (_land(spark, folder, number % 2 == k) for k in (0, 1))
    cache = competition.build_indexed(spark, _land_info(spark, folder), [train], [test], scratch_path(spark, "indexed"))
    return spark.read.parquet(cache).select("part", "series_id", "grp", "horizon", *digest("values", SIX))


@query("series_length", f"WITH {_RAGGED} SELECT series_id, any_value(len)::INT AS n FROM ragged GROUP BY 1")
def series_length(spark, folder):
    return ragged(spark, folder).select("series_id", F.size("values").alias("n"))


@query("min_length_series", f"WITH {_RAGGED} SELECT DISTINCT series_id, len::INT AS n, horizon FROM ragged WHERE len > horizon")
def min_length_series(spark, folder):
    kept = series_sets.longer_than(ragged(spark, folder), "values", "horizon")
    return kept.select("series_id", F.size("values").alias("n"), "horizon")


@query(
    "holdout_split",
    f"""WITH {_RAGGED} SELECT series_id, {_sum('train', 'pos < len-horizon')},
        {_sum('test', 'pos >= len-horizon', '(pos-len+horizon)')} FROM ragged WHERE len > horizon GROUP BY series_id""",
)
def holdout_split(spark, folder):
    kept = series_sets.longer_than(ragged(spark, folder), "values", "horizon")
    return series_sets.holdout(kept).select("series_id", *digest("train"), *digest("test"))


def _subset(times):
    def run(spark, folder):
        kept = series_sets.train_part(F.col("values"), F.col("horizon"), times)
        return ragged(spark, folder).select("series_id", kept.alias("train")).select("series_id", *digest("train"))

    return run


query("training_subset", f"WITH {_RAGGED} SELECT series_id, {_sum('train', 'pos < len-horizon')} FROM ragged GROUP BY 1")(_subset(1))
query("hp_search_subset", f"WITH {_RAGGED} SELECT series_id, {_sum('train', 'pos < len-2*horizon')} FROM ragged GROUP BY 1")(_subset(2))


@query(
    "series_cache_roundtrip",
    f"""WITH {_RAGGED} SELECT series_id, grp, frequency, horizon, {_sum('train', 'pos < len-horizon')},
        {_sum('test', 'pos >= len-horizon', '(pos-len+horizon)')} FROM ragged WHERE len > horizon GROUP BY ALL""",
)
def series_cache_roundtrip(spark, folder):
    path = scratch_path(spark, "cache")

    def build():
        return series_sets.holdout(series_sets.longer_than(ragged(spark, folder), "values", "horizon"))

    train = writers.cached_series(spark, path, build).withColumnRenamed("values", "train")
    test = writers.cached_series(spark, path, build, training=False).select("series_id", F.col("values").alias("test"))
    both = train.join(test, "series_id")
    return both.select("series_id", "grp", "frequency", "horizon", *digest("train"), *digest("test"))


@query("export_wide", f"WITH {_RAGGED} SELECT pos::INT AS pos, round(v,5)+0.0 AS v FROM ragged")
def export_wide(spark, folder):
    path = scratch_path(spark, "export")
    writers.export_wide(ragged(spark, folder), path)
    back = spark.read.option("header", True).csv(path)
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in back.columns])
    return back.select(F.posexplode(cells).alias("pos", "v")).filter("v IS NOT NULL").select("pos", r("v", 5).alias("v"))


@query(
    "union_frequencies",
    f"""WITH {_E} SELECT vec_id%3 AS file_ord, 'S' || vec_id AS series_id,
        max(CASE WHEN j=0 THEN round(v,6)+0.0 END) AS a, max(CASE WHEN j=1 AND vec_id%3>=1 THEN round(v,6)+0.0 END) AS b,
        max(CASE WHEN j=2 AND vec_id%3=2 THEN round(v,6)+0.0 END) AS c FROM e GROUP BY vec_id""",
)
def union_frequencies(spark, folder):
    wide = vectors(spark, folder).select("series_id", *[r(F.col("x")[i]).alias(c) for i, c in enumerate("abc")])
    named = wide.withColumn("id", F.concat(F.lit("S"), "series_id"))
    frames = [
        named.filter(F.col("series_id") % 3 == i).select(F.col("id").alias("series_id"), *"abc"[: i + 1]) for i in range(3)
    ]
    return series_sets.union_frequencies(frames).select(F.col("file_ord").cast("bigint").alias("file_ord"), "series_id", "a", "b", "c")
