"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlake.llm import cutoffs, grouping, mixing, packing, quantiles, residue, survivors, tokens
from viewlake.operators.skew import BROADCAST_ROWS
from viewlake.operators.spatial import valid_position
from viewlake.session import Scratch, table

PERMILLE = [50, 250, 500, 750, 950]
KEEP_PERMILLE = 500
HASH_BITS = 6


def usable_score(score: Column) -> Column:
    """The score if it is neither null, NaN nor infinite and at least 0, else null."""
    return F.when(~F.isnan(score) & (score >= 0) & (score < F.lit(float("inf"))), score)


# -- 1: percentiles


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "image_records")
    blur = usable_score(F.col("quality_metrics.blur_score"))
    both = F.array(F.struct(F.lit("blur_score").alias("metric"), blur.alias("value")), F.struct(F.lit("exposure_mean").alias("metric"), F.col("quality_metrics.exposure_mean").alias("value")))
    day = F.to_date("scanned_at")
    return records.select("parent_relative", day.alias("day"), F.explode(both).alias("m")).select("parent_relative", "day", "m.metric", "m.value")


#: Bound asked of the rank error, and the values of a group up to which it holds.
RANK_ERROR, MOST_VALUES = 0.01, 1e9
#: Buffers of the rank check, small enough that most folders are collapsed.
CHECK_BUFFER = 64


def day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sketch per folder, day and metric, to be kept and merged later."""
    keys, k = ["parent_relative", "day", "metric"], quantiles.buffer_size(RANK_ERROR, MOST_VALUES)
    return quantiles.merge(quantiles.sketch(_measures(spark, sf_dir), keys, "value", k), keys, k)


def p1_folder_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of blur_score (usable scores) and exposure_mean (finite values) per folder over all days, put together from the daily sketches."""
    keys = ["parent_relative", "metric"]
    return quantiles.percentiles(quantiles.merge(day_sketches(spark, sf_dir), keys, quantiles.buffer_size(RANK_ERROR, MOST_VALUES)), keys, PERMILLE)


def p1_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per folder and day (written as text)."""
    return quantiles.percentiles(day_sketches(spark, sf_dir), ["parent_relative", "day", "metric"], PERMILLE).withColumn("day", F.col("day").cast("string"))


def p1_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each folder from buffers of 64 values, and whether the exact ranks of all are within the stated bound."""
    keys = ["parent_relative", "metric"]
    values = _measures(spark, sf_dir).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))).select(*keys, "value")
    sketches = quantiles.merge(quantiles.sketch(values, keys, "value", CHECK_BUFFER), keys, CHECK_BUFFER)
    found = Scratch(spark).write(quantiles.percentiles(sketches, keys, PERMILLE), "percentiles")
    names = [f"p{q:03d}" for q in PERMILLE]
    renamed = found.select(*(F.col(c).alias(f"_{c}") for c in keys), "n", "rank_error", *names)
    same = F.col("parent_relative").eqNullSafe(F.col("_parent_relative")) & (F.col("metric") == F.col("_metric"))
    few = found.count() <= BROADCAST_ROWS
    ranks = values.join(F.broadcast(renamed) if few else renamed, same).groupBy(*keys, "n", "rank_error").agg(
        *(F.count(F.when(F.col("value") < F.col(p), 1)).alias(f"below_{p}") for p in names), *(F.count(F.when(F.col("value") <= F.col(p), 1)).alias(f"upto_{p}") for p in names)
    )
    slack, within = F.round(F.col("rank_error") * F.col("n")), F.lit(True)
    for q, p in zip(PERMILLE, names):
        rank = F.ceil(F.col("n") * q / 1000)
        within = within & (F.col(f"below_{p}") + 1 - slack <= rank) & (rank <= F.col(f"upto_{p}") + slack)
    return ranks.select(*keys, "n", (F.col("rank_error") > 0).alias("collapsed"), within.alias("within"))


# -- 3: survivors


def _has_text(c: Column) -> Column:
    return ~survivors.blank(c)


def _survivors(spark: SparkSession, sf_dir: str, timestamp: str, records: DataFrame) -> DataFrame:
    clusters = table(spark, sf_dir, "duplicate_clusters")
    named = F.concat(F.array("representative"), F.coalesce("members", F.array().cast("array<string>")))
    groups = clusters.where(F.col("cluster_id").isNotNull()).select(F.col("cluster_id").alias("grp"), F.explode(named).alias("path"))
    focal = F.col("exif.focal_length_mm")
    fields = {
        "position": valid_position(F.col("exif.gps_latitude"), F.col("exif.gps_longitude")),
        "focal": F.coalesce(focal.isNotNull() & ~F.isnan(focal) & (focal > 0), F.lit(False)),
        "camera": F.coalesce(_has_text(F.col("exif.make")) & _has_text(F.col("exif.model")), F.lit(False)),
    }
    records = records.withColumn("camera_text", F.concat_ws("/", F.lower(F.btrim("exif.make")), F.lower(F.btrim("exif.model")))).withColumn("focal_text", focal)
    out = survivors.survivors(groups, records, best=usable_score(F.col("quality_metrics.blur_score")), fields=fields, attributes=["camera_text", "focal_text"], timestamp=timestamp)
    return out.select(F.col("grp").alias("cluster_id"), "field_name", "record_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving record of each cluster and the record each exif value is taken from."""
    return _survivors(spark, sf_dir, "scanned_at", table(spark, sf_dir, "image_records"))


def p3_without_late_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same when the scan time of records delivered more than a day late isn't believed: their recency is reasoned from values."""
    records = table(spark, sf_dir, "image_records")
    prompt = F.col("delivered_at") <= F.col("scanned_at") + F.expr("INTERVAL 1 DAY")
    return _survivors(spark, sf_dir, "believed_at", records.withColumn("believed_at", F.when(prompt, F.col("scanned_at"))))


# -- 4: groups


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked path with the smallest path of its group."""
    records, pairs, clusters = (table(spark, sf_dir, t) for t in ("image_records", "match_pairs", "duplicate_clusters"))
    return grouping.link_paths(records, pairs, clusters, HASH_BITS)


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by their number of paths."""
    sizes = p4_found(spark, sf_dir).groupBy("group_path").agg(F.count(F.lit(1)).alias("paths"))
    return sizes.groupBy("paths").agg(F.count(F.lit(1)).alias("n_groups"))


# -- 5: cutoffs


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "image_records")
    rows = records.select("parent_relative", "record_id", usable_score(F.col("quality_metrics.blur_score")).alias("score"))
    return rows.where(F.col("parent_relative").isNotNull() & F.col("score").isNotNull()).distinct()


def _cutoffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark)
    scores = scratch.write(_scores(spark, sf_dir), "scores")
    targets = table(spark, sf_dir, "keep_targets")
    return scores, cutoffs.exact_cutoffs(scores, targets, "parent_relative", "score", default_permille=KEEP_PERMILLE, scratch=scratch)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a usable score at or above the cutoff of their folder."""
    scores, cut = _cutoffs(spark, sf_dir)
    return cutoffs.keep_above(scores, cut, "parent_relative", "score").select("parent_relative", "record_id")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff and kept size per folder."""
    return _cutoffs(spark, sf_dir)[1]


# -- 7: containers


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = Scratch(spark).write(tokens.with_token_counts(documents, "text"), "tokens")
    return packing.pack(counted, table(spark, sf_dir, "pack_targets"), "doc_id", "n_tokens")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of each container: the texts, and pieces of texts above the capacity, with their tokens."""
    return _packed(spark, sf_dir).withColumnsRenamed({"item": "doc_id", "size": "n_tokens"})


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: how many were filled, tokens in them, unused space and its share."""
    b = packing.bins(_packed(spark, sf_dir))
    return b.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("unused").alias("unused"), (F.sum("unused") / F.sum("capacity")).alias("unused_share"),
    )


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: documents packed, and how many containers are overfull, texts split without need, texts with tokens lost or added."""
    packed = Scratch(spark).write(_packed(spark, sf_dir), "packed")
    overfull = packing.bins(packed).groupBy("container", "capacity").agg(F.count(F.when(F.col("unused") < 0, 1)).alias("overfull"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.with_token_counts(documents, "text").where("n_tokens > 0").withColumnRenamed("doc_id", "item")
    whole = packed.groupBy("container", "capacity", "item").agg(F.sum("size").alias("placed"), F.count(F.lit(1)).alias("pieces")).join(counted, "item", "full")
    texts = whole.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("pieces") > F.ceil(F.col("n_tokens") / F.col("capacity")), 1)).alias("split_without_need"),
        F.count(F.when(~F.col("placed").eqNullSafe(F.col("n_tokens")), 1)).alias("changed"),
    )
    return texts.join(overfull, ["container", "capacity"], "left").select("container", "capacity", "documents", "overfull", "split_without_need", "changed")


# -- 8: mixtures


def language_code(lang: Column) -> Column:
    """Two-letter language of a code in any letter case, with a region or of three letters; '' where it is unknown."""
    code = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]+)", 1))
    # fixed values: other codes of the languages at hand
    other = F.create_map(*(F.lit(x) for pair in (("eng", "en"), ("deu", "de"), ("ger", "de"), ("fra", "fr"), ("fre", "fr"), ("spa", "es"), ("jpn", "ja"), ("jp", "ja"), ("und", "")) for x in pair))
    return F.coalesce(other[code], code, F.lit(""))


def _mixed(spark: SparkSession, sf_dir: str, total: str) -> tuple[DataFrame, DataFrame]:
    domain = F.substring_index("source", "-", 1).alias("domain")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source", domain, language_code(F.col("lang")).alias("language"))
    targets = table(spark, sf_dir, "mix_targets").select("mix", "source", "weight", "max_repeats", domain)
    counted = tokens.with_token_counts(rows, "text")
    return mixing.mix_sources(counted, targets, ident="doc_id", source="source", size="n_tokens", domain="domain", language="language", total=total)


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn documents of each mix with their repeats, at the largest total at which all sources that are there keep their shares."""
    return _mixed(spark, sf_dir, "feasible")[0].withColumnRenamed("size", "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in each mix, and the cause where they differ."""
    return _mixed(spark, sf_dir, "feasible")[1]


def p8_full_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at one time the size of all records of a mix's sources: small sources exhaust their repeats and others take over."""
    return _mixed(spark, sf_dir, "all")[0].withColumnRenamed("size", "n_tokens")


def p8_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares at that size."""
    return _mixed(spark, sf_dir, "all")[1]


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix, at the feasible total: targets, sources drawn that are none, documents drawn too often or twice, sources off their budget by more than single records."""
    drawn, shares = _mixed(spark, sf_dir, "feasible")
    targets = table(spark, sf_dir, "mix_targets").groupBy("mix", "source").agg(F.max("max_repeats").alias("most"))
    rows = drawn.groupBy("mix", "source", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("repeats").alias("repeats")).join(targets, ["mix", "source"], "left")
    wrong = rows.groupBy("mix").agg(
        F.count(F.when(F.col("most").isNull(), 1)).alias("strangers"), F.count(F.when((F.col("repeats") > F.col("most")) | (F.col("rows") > 1), 1)).alias("too_often"),
    )
    largest = drawn.groupBy("mix").agg(F.max("size").alias("largest"))
    # a source has at most one leaf per language and unknown ones
    off = shares.join(largest, "mix", "left").groupBy("mix").agg(
        F.count(F.lit(1)).alias("targets"), F.count(F.when((F.col("available") > 0) & (F.abs(F.col("drawn_size") - F.col("budget")) > 6 * F.col("largest")), 1)).alias("off_budget"),
    )
    return off.join(wrong, "mix", "left").select("mix", "targets", "off_budget", "strangers", "too_often")


# -- 9: residue


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull())
    return residue.find_residue(documents, "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template fields, filler, or nothing but error messages and script notices."""
    return _residue(spark, sf_dir).where("residue").select("doc_id")


def p9_residue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the kinds of residue in them."""
    notice = (F.col("notice_share") >= residue.COVERAGE).alias("notice")
    return _residue(spark, sf_dir).groupBy("template", "filler", notice).agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict:
    found = (
        p1_folder_percentiles, p1_daily_percentiles, p1_rank_check, p3_found, p3_without_late_times, p4_found, p4_group_sizes, p5_found, p5_cutoffs,
        p7_packed, p7_unused, p7_checks, p8_full_drawn, p8_full_shares, p8_drawn, p8_shares, p8_checks, p9_found, p9_residue_kinds,
    )
    return {f.__name__: f for f in found}


_USABLE = "quality_metrics.blur_score IS NOT NULL AND NOT isnan(quality_metrics.blur_score) AND NOT isinf(quality_metrics.blur_score) AND quality_metrics.blur_score >= 0"

_CUT = f"""WITH s AS (SELECT DISTINCT parent_relative, record_id, quality_metrics.blur_score AS score FROM image_records
  WHERE {_USABLE} AND parent_relative IS NOT NULL),
r AS (SELECT s.*, count(*) OVER (PARTITION BY parent_relative) AS n,
    count(*) OVER (PARTITION BY parent_relative ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS at_least FROM s),
t AS (SELECT r.*, coalesce(k.keep_permille, 500) AS permille FROM r LEFT JOIN keep_targets k USING (parent_relative)),
c AS (SELECT parent_relative, max(n) AS n, max(permille) AS keep_permille,
    max(score) FILTER (WHERE 1000 * at_least >= permille * n) AS cutoff FROM t GROUP BY parent_relative)"""

_CANDIDATES = f"""WITH RECURSIVE i AS (SELECT record_id, path, {{ts}} AS ts, trust_rank, CASE WHEN {_USABLE} THEN quality_metrics.blur_score END AS score,
    coalesce(trim(exif.make, E' \\t') <> '' AND trim(exif.model, E' \\t') <> '', false) AS has_camera,
    coalesce(exif.focal_length_mm > 0 AND NOT isnan(exif.focal_length_mm), false) AS has_focal,
    coalesce(exif.gps_latitude BETWEEN -90 AND 90 AND exif.gps_longitude BETWEEN -180 AND 180 AND NOT isnan(exif.gps_latitude) AND NOT isnan(exif.gps_longitude)
      AND NOT (exif.gps_latitude = 0 AND exif.gps_longitude = 0), false) AS has_position,
    concat_ws('/', lower(trim(exif.make)), lower(trim(exif.model))) AS camera_text, exif.focal_length_mm::VARCHAR AS focal_text FROM image_records),
named AS (SELECT DISTINCT cluster_id, p AS path FROM (SELECT cluster_id, list_append(members, representative) AS ps FROM duplicate_clusters) x, unnest(x.ps) AS u(p)),
c AS (SELECT n.cluster_id, i.* FROM named n JOIN i ON i.path = n.path)"""

_REASONED = """,
told AS (SELECT * FROM (SELECT path, record_id, ts, 'camera_text' AS attribute, camera_text AS value FROM i UNION ALL SELECT path, record_id, ts, 'focal_text', focal_text FROM i) WHERE trim(value, E' \\t') <> ''),
spans AS (SELECT path, attribute, value, min(ts) AS f, max(ts) AS l FROM told WHERE ts IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
steps AS (SELECT attribute, lag(value) OVER w AS earlier, lag(l) OVER w AS prev, value AS later, f FROM spans WINDOW w AS (PARTITION BY path, attribute ORDER BY f, l, value)),
seen AS (SELECT attribute, earlier, later, count(*) AS n FROM steps WHERE prev < f GROUP BY ALL),
prec AS (SELECT s.attribute, s.earlier, s.later FROM seen s LEFT JOIN seen b ON b.attribute = s.attribute AND b.earlier = s.later AND b.later = s.earlier WHERE s.n > coalesce(b.n, 0)),
up AS (SELECT attribute, earlier AS value, later AS other FROM prec UNION SELECT r.attribute, r.value, p.later FROM up r JOIN prec p ON p.attribute = r.attribute AND p.earlier = r.other),
sides AS (SELECT attribute, value, other, bool_or(x) AS is_later, bool_or(NOT x) AS is_before FROM
    (SELECT attribute, value, other, true AS x FROM up UNION ALL SELECT attribute, other, value, false FROM up) WHERE value <> other GROUP BY ALL),
u AS (SELECT DISTINCT c.cluster_id, c.record_id, t.attribute, t.value FROM c JOIN told t ON t.record_id = c.record_id WHERE c.ts IS NULL),
d AS (SELECT DISTINCT c.cluster_id, c.ts, t.attribute, t.value FROM c JOIN told t ON t.record_id = c.record_id WHERE c.ts IS NOT NULL),
near AS (SELECT cluster_id, record_id, attribute, value AS other, false AS later_than FROM u
  UNION ALL SELECT u.cluster_id, u.record_id, u.attribute, s.other, NOT s.is_later FROM u JOIN sides s ON s.attribute = u.attribute AND s.value = u.value WHERE s.is_before),
met AS (SELECT n.cluster_id, n.record_id, d.ts, n.later_than FROM near n JOIN d ON d.cluster_id = n.cluster_id AND d.attribute = n.attribute AND d.value = n.other),
times AS (SELECT cluster_id, record_id, max(ts) AS cur FROM met GROUP BY ALL),
placed AS (SELECT t.cluster_id, t.record_id, t.cur,
    EXISTS (SELECT 1 FROM met m WHERE m.cluster_id = t.cluster_id AND m.record_id = t.record_id AND m.ts = t.cur AND m.later_than)
    AND NOT EXISTS (SELECT 1 FROM u JOIN sides s ON s.attribute = u.attribute AND s.value = u.value AND s.is_later AND NOT s.is_before
      JOIN d ON d.cluster_id = u.cluster_id AND d.attribute = u.attribute AND d.value = s.other
      WHERE u.cluster_id = t.cluster_id AND u.record_id = t.record_id AND d.ts = t.cur) AS after FROM times t),
levels AS (SELECT u.cluster_id, u.record_id, count(*) AS level FROM u JOIN sides s ON s.attribute = u.attribute AND s.value = u.value AND s.is_before AND NOT s.is_later GROUP BY ALL),
reasoned AS (SELECT c.*, coalesce(c.ts, p.cur) AS cur, CASE WHEN c.ts IS NOT NULL THEN 1 WHEN p.after THEN 2 ELSE 0 END AS place, CASE WHEN c.ts IS NOT NULL THEN 0 ELSE coalesce(l.level, 0) END AS level
  FROM c LEFT JOIN placed p USING (cluster_id, record_id) LEFT JOIN levels l USING (cluster_id, record_id))"""

_CHOSEN = """,
fields AS (SELECT *, 'keep' AS field_name FROM {source} UNION ALL SELECT *, 'position' FROM {source} WHERE has_position UNION ALL SELECT *, 'focal' FROM {source} WHERE has_focal UNION ALL SELECT *, 'camera' FROM {source} WHERE has_camera),
best AS (SELECT cluster_id, field_name, record_id, row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY CASE WHEN field_name = 'keep' THEN score END DESC NULLS LAST,
    CASE WHEN field_name = 'keep' THEN has_camera::INT + has_focal::INT + has_position::INT END DESC NULLS LAST, CASE WHEN field_name <> 'keep' THEN trust_rank END NULLS LAST,
    cur DESC NULLS LAST, place DESC, level DESC, record_id) AS k FROM fields)
SELECT cluster_id, field_name, record_id FROM best WHERE k = 1"""

_LINKS = """WITH RECURSIVE h AS (SELECT path, max(CASE WHEN regexp_matches(x, '^[0-9a-f]{1,16}$') THEN ('0x' || x)::UBIGINT END) AS h FROM (
    SELECT path, regexp_replace(regexp_replace(lower(replace(replace(perceptual_hash, ' ', ''), chr(9), '')), '^0x', ''), '^0+(.)', '\\1') AS x FROM image_records)
  GROUP BY path),
named AS (SELECT DISTINCT c.r AS r, p AS path FROM (SELECT row_number() OVER () AS r, list_distinct(list_append(members, representative)) AS ps FROM duplicate_clusters) c, unnest(c.ps) AS u(p)
  WHERE p IN (SELECT path FROM h)),
e AS (
  SELECT a.path AS x, b.path AS y FROM match_pairs m JOIN h a ON a.path = m.left_path JOIN h b ON b.path = m.right_path
  WHERE a.path <> b.path AND bit_count(xor(a.h, b.h)) <= 6
  UNION SELECT a.path, b.path FROM named a JOIN (SELECT r, min(path) AS path FROM named GROUP BY r) b USING (r) WHERE a.path <> b.path),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x AS path, x AS other FROM both_ways UNION SELECT r.path, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
g AS (SELECT path, min(other) AS group_path FROM reach GROUP BY path)"""


_MEASURES = f"""WITH v AS (SELECT parent_relative, strftime(scanned_at, '%Y-%m-%d') AS day, 'blur_score' AS metric, quality_metrics.blur_score AS value FROM image_records WHERE {_USABLE}
  UNION ALL SELECT parent_relative, strftime(scanned_at, '%Y-%m-%d'), 'exposure_mean', quality_metrics.exposure_mean FROM image_records WHERE isfinite(quality_metrics.exposure_mean))"""


def _ranked(keys: str) -> str:
    """Exact percentiles: what the sketches give where no group has two buffers of values, as at the scale of the comparison."""
    cols = ", ".join(f"max(value) FILTER (WHERE k = greatest(1, ceil({q} * n / 1000.0)::BIGINT)) AS p{q:03d}" for q in PERMILLE)
    return _MEASURES + f""", r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM v)
SELECT {keys}, max(n) AS n, 0.0::DOUBLE AS rank_error, {cols} FROM r GROUP BY {keys}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_folder_percentiles": _ranked("parent_relative, metric"),
        "p1_daily_percentiles": _ranked("parent_relative, day, metric"),
        "p1_rank_check": _MEASURES + f" SELECT parent_relative, metric, count(*) AS n, count(*) >= {2 * CHECK_BUFFER} AS collapsed, true AS within FROM v GROUP BY parent_relative, metric",
        "p3_found": _CANDIDATES.format(ts="scanned_at") + _CHOSEN.format(source="(SELECT *, ts AS cur, 1 AS place, 0 AS level FROM c)"),
        "p3_without_late_times": _CANDIDATES.format(ts="CASE WHEN delivered_at <= scanned_at + INTERVAL 1 DAY THEN scanned_at END") + _REASONED + _CHOSEN.format(source="reasoned"),
        "p7_checks": "SELECT container, capacity_tokens::BIGINT AS capacity, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS split_without_need, 0 AS changed FROM pack_targets",
        "p8_checks": "SELECT mix, count(DISTINCT source) AS targets, 0 AS off_budget, 0 AS strangers, 0 AS too_often FROM mix_targets GROUP BY mix",
        "p4_found": _LINKS + " SELECT path, group_path FROM g",
        "p4_group_sizes": _LINKS + " SELECT paths, count(*) AS n_groups FROM (SELECT group_path, count(*) AS paths FROM g GROUP BY group_path) GROUP BY paths",
        "p5_found": _CUT + " SELECT t.parent_relative, t.record_id FROM t JOIN c USING (parent_relative) WHERE t.score >= c.cutoff",
        "p5_cutoffs": _CUT + " SELECT c.parent_relative, c.n, c.keep_permille, c.cutoff, count(t.record_id) AS kept FROM c LEFT JOIN t ON t.parent_relative = c.parent_relative AND t.score >= c.cutoff GROUP BY ALL",
    }
