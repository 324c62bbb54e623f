"""Every operator as a query over the whole test tables."""

from __future__ import annotations

import dataclasses
import datetime
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areashare.functions.codes import CodeSet, code_prefix
from areashare.functions.prefixes import PrefixSet
from areashare.functions.scalars import (
    as_percent,
    case_items,
    ieee_divide,
    parse_period,
    period_label,
    scale_clamp,
)
from areashare.functions.sql import register_sql_functions
from areashare.operators import bands, digests, sketches, snapshot, views
from areashare.operators.measure import ShareMeasure
from areashare.plans.report import share_report
from areashare.sources import staging
from areashare.sources.cache import ResultCache
from areashare.sources.footers import latest_rows_in
from areashare.sources.layout import cell_sums, write_bucketed, write_clustered
from areashare.sources.partials import PartialSums
from areashare.sources.storage import scratch_table, shared_folder
from areashare.sources.text import read_own_text, read_text_parts, write_text_table

Query = Callable[[SparkSession, str], DataFrame]

# The brands stand in for drug codes; a prefix of 7 characters groups them.
NUMERATOR = CodeSet.of("Brand#1", "Brand#3", "Brand#4")
# Codes of several lengths, far apart.
MIXED = PrefixSet.of("Brand#12", "Brand#3", "Brand#31", "Brand#55")
BRAND_SHARE = ShareMeasure(
    numerator=NUMERATOR,
    denominator=NUMERATOR | CodeSet.of("Brand#5"),
    area_type="CCG",
    since=datetime.date(1996, 1, 1),
)
# The same share with another group of brands in the denominator: what a saved
# table is compared with after a change of definition.
REVISED_SHARE = dataclasses.replace(
    BRAND_SHARE, denominator=NUMERATOR | CodeSet.of("Brand#2")
)
SCALE = (10, 90)

MEASURE_SQL = """
SELECT m.period AS month, m.pct, m.doacs, 100 * ieee_divide(m.doacs, m.total) AS perc_doacs
FROM (
  SELECT
    trunc(rx.month, 'month') AS period,
    rx.pct,
    sum(CASE WHEN left(rx.bnf_code, 7) IN ('Brand#1', 'Brand#3', 'Brand#4')
        THEN rx.items ELSE 0 END) AS doacs,
    sum(rx.items) AS total
  FROM {rx} AS rx JOIN {areas} AS area ON rx.pct = area.code
  WHERE left(rx.bnf_code, 7) IN ('Brand#1', 'Brand#3', 'Brand#4', 'Brand#5')
    AND area.org_type = 'CCG'
    AND rx.month >= DATE '1996-01-01'
  GROUP BY trunc(rx.month, 'month'), rx.pct
) AS m
"""


def measure_from_tables(
    spark: SparkSession, sf_dir: str, share: ShareMeasure = BRAND_SHARE
) -> DataFrame:
    return share.build(staging.prescribing(spark, sf_dir), staging.areas(spark, sf_dir))


def measure_table(
    spark: SparkSession,
    sf_dir: str,
    share: ShareMeasure = BRAND_SHARE,
    format: str = "parquet",
    refresh: bool = False,
) -> DataFrame:
    """The measure, kept in the shared folder for the life of the application."""
    return ResultCache(f"{shared_folder(spark)}/areashare/measure-{format}", format).get(
        spark,
        f"{spark.sparkContext.applicationId} {share!r}",
        lambda: views.ordered(measure_from_tables(spark, sf_dir, share), "month", "pct"),
        inputs=[staging.table_path(sf_dir, name) for name in staging.INPUT_TABLES],
        refresh=refresh,
    )


def build_queries(refresh: bool = False) -> dict[str, Query]:
    """All queries by name; ``refresh`` makes each one rebuild the measure table."""
    rx, areas = staging.prescribing, staging.areas
    share = BRAND_SHARE
    kept = functools.partial(measure_table, refresh=refresh)
    found: dict[str, Query] = {}

    def query(name: str) -> Callable[[Query], Query]:
        return lambda fn: found.setdefault(name, fn)

    # Sources and sinks

    @query("scan_prescribing")
    def scan_prescribing(spark, d):
        return rx(spark, d)

    @query("scan_areas")
    def scan_areas(spark, d):
        return areas(spark, d)

    @query("cached_measure")
    def cached_measure(spark, d):
        return kept(spark, d)

    @query("cached_measure_csv")
    def cached_measure_csv(spark, d):
        return kept(spark, d, format="csv")

    # Projections and scalar functions

    @query("project_alias")
    def project_alias(spark, d):
        return rx(spark, d).select(
            F.col("month").alias("shipped"),
            F.col("pct").alias("area"),
            F.col("bnf_code").alias("code"),
            F.col("items").alias("n_items"),
        )

    @query("period_date")
    def period_date(spark, d):
        return rx(spark, d).select(
            "pct", F.to_date("month").alias("day"), share.period_expr().alias("period")
        )

    @query("code_prefix")
    def code_prefix_rows(spark, d):
        return rx(spark, d).select("bnf_code", code_prefix(F.col("bnf_code"), 7).alias("prefix"))

    @query("code_set_flag")
    def code_set_flag(spark, d):
        flag = share.numerator.matches(F.col("bnf_code"))
        return rx(spark, d).select("bnf_code", "items", flag.cast("int").alias("in_numerator"))

    @query("code_prefix_set")
    def code_prefix_set(spark, d):
        return rx(spark, d).where(MIXED.matches(F.col("bnf_code")))

    @query("share_measure_prefixes")
    def share_measure_prefixes(spark, d):
        # A numerator of longer and shorter codes in a denominator of shorter ones.
        wider = ShareMeasure(numerator=MIXED, denominator=MIXED | PrefixSet.of("Brand#1", "Brand#5"))
        return wider.build(rx(spark, d), areas(spark, d))

    @query("case_items")
    def case_items_rows(spark, d):
        counted = case_items(share.numerator.matches(F.col("bnf_code")), F.col("items"))
        return rx(spark, d).select("pct", "bnf_code", counted.alias("doacs"))

    @query("ieee_divide")
    def ieee_divide_rows(spark, d):
        returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
        filled = F.when(
            (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), F.col("l_quantity")
        ).otherwise(0.0)
        sums = (
            staging.table(spark, d, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.sum(returned).alias("x"), F.sum(filled).alias("y"))
        )
        ratio = F.col("ratio")
        kind = (
            F.when(ratio.isNull(), "null")
            .when(F.isnan(ratio), "nan")
            .when(F.abs(ratio) == float("inf"), "inf")
            .otherwise("finite")
        )
        return (
            sums.select("l_orderkey", ieee_divide(F.col("x"), F.col("y")).alias("ratio"))
            .withColumn("class", kind)
            .select(
                "l_orderkey",
                "class",
                F.when(F.col("class") == "finite", F.round(ratio, 6)).alias("ratio"),
            )
        )

    @query("percent_scale")
    def percent_scale(spark, d):
        sums = share.sums(rx(spark, d), areas(spark, d))
        ratio = ieee_divide(F.col("doacs"), F.col("items"))
        return sums.select(
            "month", "pct", ratio.alias("ratio"), as_percent(ratio).alias("perc_doacs")
        )

    @query("parse_period")
    def parse_period_rows(spark, d):
        text = rx(spark, d).select("pct", F.date_format("month", "yyyy-MM-dd").alias("text"))
        return text.select("pct", parse_period(F.col("text")).alias("month"))

    @query("drop_column")
    def drop_column(spark, d):
        return kept(spark, d).drop("perc_doacs")

    @query("period_label")
    def period_label_rows(spark, d):
        return kept(spark, d).select("month", "pct", period_label(F.col("month")).alias("label"))

    @query("scale_clamp")
    def scale_clamp_rows(spark, d):
        shade = scale_clamp(F.col("perc_doacs"), *SCALE)
        return kept(spark, d).select("month", "pct", F.round(shade, 9).alias("shade"))

    # Filters

    @query("filter_code_set")
    def filter_code_set(spark, d):
        return rx(spark, d).where(share.in_denominator())

    @query("filter_area_type")
    def filter_area_type(spark, d):
        return share.members(areas(spark, d))

    @query("filter_period_from")
    def filter_period_from(spark, d):
        return rx(spark, d).where(share.from_period())

    @query("filter_conjunction")
    def filter_conjunction(spark, d):
        fact, dim = rx(spark, d), areas(spark, d)
        return (
            fact.join(dim, fact.pct == dim.code)
            .where(
                share.in_denominator() & (F.col("org_type") == share.area_type) & share.from_period()
            )
            .select("month", "pct", "bnf_code", "items", "org_type")
        )

    @query("latest_period_rows")
    def latest_period_rows(spark, d):
        return views.latest_period_rows(kept(spark, d))

    @query("latest_rows_footers")
    def latest_rows_footers(spark, d):
        # The last period comes from the footers, and only its row groups are read.
        path = f"{shared_folder(spark)}/areashare/measure-{uuid.uuid4().hex}"
        kept(spark, d).write.parquet(path)
        return latest_rows_in(spark, path)

    # Joins

    @query("join_fact_area")
    def join_fact_area(spark, d):
        fact, dim = rx(spark, d), areas(spark, d)
        return fact.join(dim, fact.pct == dim.code).select(
            "month", "pct", "bnf_code", "items", "name", "org_type"
        )

    @query("area_layer")
    def area_layer(spark, d):
        layer = views.area_layer(share.members(areas(spark, d)), kept(spark, d), *SCALE)
        return layer.withColumn("shade", F.round("shade", 9))

    # Aggregations

    @query("group_sum")
    def group_sum(spark, d):
        return (
            rx(spark, d)
            .groupBy(share.period_expr().alias("month"), "pct")
            .agg(F.sum("items").alias("items"))
        )

    @query("conditional_sum")
    def conditional_sum(spark, d):
        return (
            rx(spark, d)
            .groupBy(share.period_expr().alias("month"), "pct")
            .agg(F.sum(share.numerator_items()).alias("doacs"))
        )

    @query("share_measure")
    def share_measure(spark, d):
        return measure_from_tables(spark, d)

    @query("share_measure_sql")
    def share_measure_sql(spark, d):
        register_sql_functions(spark)
        return spark.sql(MEASURE_SQL, rx=rx(spark, d), areas=areas(spark, d))

    @query("national_rollup")
    def national_rollup(spark, d):
        return views.national_rollup(kept(spark, d))

    @query("latest_period")
    def latest_period(spark, d):
        return views.latest_label(kept(spark, d))

    def rounded_bands(spark, d, points):
        found_bands = bands.percentile_bands(kept(spark, d), points=points)
        return found_bands.withColumn("perc_doacs", F.round("perc_doacs", 6))

    @query("period_deciles")
    def period_deciles(spark, d):
        return rounded_bands(spark, d, bands.DECILES)

    @query("period_outer_percentiles")
    def period_outer_percentiles(spark, d):
        return rounded_bands(spark, d, bands.OUTER)

    @query("percentile_bands")
    def percentile_bands(spark, d):
        return rounded_bands(spark, d, bands.ALL_BANDS)

    def within_bound(values, tables, period):
        """Whether percentiles from sketches have the ranks they should, by the values themselves."""
        errors = sketches.rank_errors(values, sketches.sketch_bands(tables), period)
        within = F.col("error") <= sketches.rank_bound()
        return errors.select(period, "percentile", "n", within.alias("within"))

    @query("percentile_sketches")
    def percentile_sketches(spark, d):
        measure = kept(spark, d)
        tables = scratch_table(sketches.percentile_sketches(measure), "sketches")
        return within_bound(measure, tables, "month")

    @query("merged_sketches")
    def merged_sketches(spark, d):
        # Months and both panels of areas on their own, merged to years afterwards.
        measure = kept(spark, d).withColumn("half", F.col("pct") % 2)
        tables = scratch_table(sketches.percentile_sketches(measure, by=["half"]), "sketches")
        years = sketches.merged_sketches(tables, F.trunc("month", "year").alias("year"))
        return within_bound(measure.withColumn("year", F.trunc("month", "year")), years, "year")

    @query("incremental_measure")
    def incremental_measure(spark, d):
        # Facts come in two deliveries; the second refresh reads the second one only.
        facts = rx(spark, d)
        path = f"{shared_folder(spark)}/areashare/deliveries/{uuid.uuid4().hex}"
        store = PartialSums(
            share, f"{path}/sums", lambda spark, files: spark.read.schema(facts.schema).parquet(*files)
        )
        late = F.col("month") >= F.lit(datetime.datetime(1999, 1, 1))
        for name, delivery in (("first", facts.where(~late)), ("second", facts.where(late))):
            delivery.write.parquet(f"{path}/facts/{name}")
            store.refresh(spark, f"{path}/facts")
        return store.build(spark, f"{path}/facts", areas(spark, d))

    @query("clustered_measure")
    def clustered_measure(spark, d):
        path = f"{shared_folder(spark)}/areashare/clustered-{uuid.uuid4().hex}"
        write_clustered(rx(spark, d), path)
        return share.build(spark.read.parquet(path), areas(spark, d))

    @query("bucketed_measure")
    def bucketed_measure(spark, d):
        # Sums of the facts and the areas in buckets of the area: neither sums nor join shuffle.
        names, buckets = {}, 8
        for table, key, within in (
            (cell_sums(rx(spark, d)), "pct", ("month", "bnf_code")),
            (areas(spark, d), "code", ()),
        ):
            names[key] = f"areashare_{key}_{uuid.uuid4().hex}"
            path = f"{shared_folder(spark)}/areashare/buckets/{names[key]}"
            write_bucketed(table, names[key], path, key, buckets, within)
        return share.build(spark.table(names["pct"]), spark.table(names["code"]))

    # Sorts

    @query("ordered_measure")
    def ordered_measure(spark, d):
        return views.ordered(measure_from_tables(spark, d), "month", "pct")

    @query("ordered_rollup")
    def ordered_rollup(spark, d):
        return views.ordered(views.national_rollup(kept(spark, d)), "month")

    # Splits

    @query("area_panel")
    def area_panel(spark, d):
        flag = views.panel(F.col("is_london"))
        return areas(spark, d).select("code", "name", flag.alias("panel"))

    @query("panel_files")
    def panel_files(spark, d):
        # Both panels are written, then one is rewritten for other scales and read with the other.
        layer = views.area_layer(share.members(areas(spark, d)), kept(spark, d), *SCALE)
        path = f"{shared_folder(spark)}/areashare/panels-{uuid.uuid4().hex}"
        views.write_panels(layer, path)
        wider = views.area_layer(share.members(areas(spark, d)), kept(spark, d), 0, 100)
        views.replace_panels(wider.where("panel = 'london'"), path)
        found = views.read_panels(spark, path, "london", "rest")
        return found.select("code", "panel", "perc_doacs", F.round("shade", 9).alias("shade"))

    # Regression checks

    @query("sanitise_text")
    def sanitise_text(spark, d):
        event, kind = F.md5(F.col("event_id").cast("string")), F.md5("event_type")
        parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        uuid = F.concat_ws("-", *[kind.substr(start, n) for start, n in parts])
        text = F.concat(
            F.lit("obj at 0x"), event.substr(1, 12), F.lit(" run "), uuid, F.lit(" "), "event_type"
        )
        events = staging.table(spark, d, "events").select("event_id", text.alias("text"))
        return snapshot.sanitise_text(events, "text")

    def two_snapshots(spark, d):
        return kept(spark, d, REVISED_SHARE), kept(spark, d)

    @query("snapshot_diff")
    def snapshot_diff(spark, d):
        return snapshot.snapshot_diff(*two_snapshots(spark, d), keys=["month", "pct"])

    @query("snapshot_digest_diff")
    def snapshot_digest_diff(spark, d):
        return digests.digest_diff(*two_snapshots(spark, d), keys=["month", "pct"])

    @query("snapshot_digest_same")
    def snapshot_digest_same(spark, d):
        # The measure as kept against one built anew, but for one area: only its buckets are compared.
        built = measure_from_tables(spark, d)
        changed = F.when(F.col("pct") == 7, F.col("doacs") + 1).otherwise(F.col("doacs"))
        return digests.digest_diff(
            built.withColumn("doacs", changed), kept(spark, d), keys=["pct"], ignore_columns=["perc_doacs"]
        )

    @query("snapshot_diff_hot_key")
    def snapshot_diff_hot_key(spark, d):
        # Lines under three flags: every key is hot, and is numbered slice by slice.
        lines = staging.table(spark, d, "lineitem")
        rows = lines.select(F.col("l_returnflag").alias("k"), F.col("l_orderkey").alias("v"), "l_linestatus")
        saved = rows.where("l_linestatus = 'F'").select("k", "v")
        current = rows.select("k", (F.col("v") * 2).alias("v"))
        return snapshot.snapshot_diff(current, saved, keys=["k"], slice_rows=1000)

    @query("snapshot_diff_ignore")
    def snapshot_diff_ignore(spark, d):
        return snapshot.snapshot_diff(
            *two_snapshots(spark, d),
            keys=["month", "pct"],
            ignore_columns=["perc_doacs"],
            ignore_where=F.col("month") < F.lit(datetime.date(1998, 1, 1)),
        )

    @query("snapshot_diff_tolerance")
    def snapshot_diff_tolerance(spark, d):
        # Shares that differ by rounding, and in some areas by more.
        share = F.col("perc_doacs") + F.when(F.col("pct") % 10 == 3, 1e-3).otherwise(1e-10)
        current = kept(spark, d).withColumn("perc_doacs", share)
        return snapshot.snapshot_diff(
            current, kept(spark, d), keys=["month", "pct"], tolerance={"perc_doacs": 1e-9}
        )

    @query("snapshot_except_all")
    def snapshot_except_all(spark, d):
        return snapshot.snapshot_except_all(*two_snapshots(spark, d))

    @query("snapshot_diff_repeated")
    def snapshot_diff_repeated(spark, d):
        # Lines of an order under the order's key; returns are the change.
        lines = staging.table(spark, d, "lineitem")
        rows = lines.select(
            F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("int").alias("v"), "l_returnflag"
        )
        saved = rows.where(F.col("l_returnflag") != "R").select("k", "v")
        changed = F.when(F.col("l_returnflag") == "A", F.col("v") + 100).otherwise(F.col("v"))
        current = rows.where(F.col("l_returnflag") != "N").select("k", changed.alias("v"))
        return snapshot.snapshot_diff(current, saved, keys=["k"])

    @query("regression_check")
    def regression_check(spark, d):
        events = staging.table(spark, d, "events")
        kind = F.when(F.col("event_type") == F.lit("click"), "stderr").otherwise("stdout")
        sides = []
        for run in ("1", "2"):
            digest = F.md5(F.concat(F.lit(run), F.col("event_id").cast("string")))
            # What really changes from run to run is the last digit of some ids.
            told = F.when(
                F.col("event_id").cast("string").endswith("7"), F.concat(F.lit("run "), F.lit(run))
            ).otherwise(F.lit("same"))
            text = F.concat(
                F.lit("obj at 0x"), digest.substr(1, 12), F.lit(" near miss 0x"), F.lit("12ab "), told
            )
            sides.append(events.select("event_id", kind.alias("kind"), text.alias("text")))
        return snapshot.compare_texts(sides[1], sides[0], keys=["event_id", "kind"])

    @query("text_round_trip")
    def text_round_trip(spark, d):
        # Values that text is bad at: NULL, line breaks, backslashes, sub-second times.
        lines = staging.table(spark, d, "lineitem")
        odd = F.when(F.col("l_returnflag") == "N", F.lit(None)).when(
            F.col("l_returnflag") == "R", F.concat(F.lit("one\ntwo\\n"), F.col("l_linestatus"))
        ).otherwise(F.lit("\\N"))
        micros = F.make_dt_interval(secs=F.lit(0.123456).cast("decimal(18,6)"))
        table = lines.select(
            "l_orderkey", "l_partkey", odd.alias("odd"), (F.col("l_shipdate") + micros).alias("moment")
        )
        path = f"{shared_folder(spark)}/areashare/round-trip-{uuid.uuid4().hex}"
        write_text_table(table, path)
        return read_own_text(spark, path, table.schema)

    def text_parts(spark, d):
        # Order lines as text of others: some quantities are no numbers, some lines lack a field.
        lines = staging.table(spark, d, "lineitem")
        quantity = F.when(F.col("l_orderkey") % 7 == 0, "n/a").otherwise(
            F.col("l_quantity").cast("bigint").cast("string")
        )
        fields = F.concat_ws(",", "l_orderkey", "l_partkey", quantity)
        short = F.concat_ws(",", "l_orderkey", "l_partkey")
        text = F.when(F.col("l_orderkey") % 11 == 0, short).otherwise(fields)
        path = f"{shared_folder(spark)}/areashare/delivered-{uuid.uuid4().hex}"
        lines.select(text.alias("line")).write.text(path)
        types = ("order", T.LongType()), ("part", T.LongType()), ("quantity", T.LongType())
        return read_text_parts(spark, path, T.StructType([T.StructField(*f) for f in types]), header=False)

    @query("text_accepted")
    def text_accepted(spark, d):
        return text_parts(spark, d)[0]

    @query("text_rejected")
    def text_rejected(spark, d):
        return text_parts(spark, d)[1].drop("file")

    @query("report_trend")
    def report_trend(spark, d):
        # The whole report: its trend beside the middle of its bands.
        report = share_report(
            spark,
            share,
            rx(spark, d),
            areas(spark, d),
            f"{shared_folder(spark)}/areashare/report-{spark.sparkContext.applicationId}",
            inputs=[staging.table_path(d, name) for name in staging.INPUT_TABLES],
            vmin=SCALE[0],
            vmax=SCALE[1],
        )
        middle = report.bands.where("percentile = 50").select("month", F.round("perc_doacs", 6).alias("median"))
        return report.trend.join(middle, "month", "left")

    return found
