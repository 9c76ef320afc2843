"""Registered queries over the asset inventory, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetflow.functions import paths, resolution
from assetflow.functions.fingerprint import content_sha256
from assetflow.operators import roots as attest_paths
from assetflow.operators import companions, incremental, journal, models, ordering, reconcile, scans, workload
from assetflow.plans.views import duckdb_ctes, spark_view, table
from assetflow.policy import PlanPolicy

POLICY = PlanPolicy()
IMAGE = "regexp_matches(rel, '[.](png|jpg|jpeg|webp|tif|tiff|bmp)$')"
JXL = "lower(rel) LIKE '%.jxl'"
TARGET = "regexp_replace(lower(rel), '[.][^./]*$', '.jxl')"


def sql(views: list[str], body: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([*duckdb_ctes(*views), *(extra or [])]) + "\n" + body


def assets(spark: SparkSession, d: str) -> DataFrame:
    """The assets view with its key; the paths are ASCII by construction (codes, digits, suffixes)."""
    return spark_view(spark, d, "assets").withColumn("key", paths.ascii_key(F.col("rel")))


def planned(spark, d, scales=(4,)):
    return workload.planned_images(assets(spark, d), scales)


# the planned-images relation in SQL; {scale} is the native-scale expression over short edge s
PLANNED = """planned AS (
SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN s >= 1600 THEN 'transcode_target_met' WHEN l > 3200 THEN 'transcode_long_edge_safety'
    WHEN greatest(ow, oh) > 6400 OR ow * oh > 24000000 THEN 'transcode_output_safety' ELSE 'hat_x' || CAST(sc AS VARCHAR) END AS category
FROM (SELECT *, CASE WHEN s * sc < 1600 THEN dw * sc WHEN dw <= dh THEN 1600 ELSE greatest(1, CAST(round_even(dw * 1600 / dh, 0) AS BIGINT)) END AS ow,
    CASE WHEN s * sc < 1600 THEN dh * sc WHEN dw <= dh THEN greatest(1, CAST(round_even(dh * 1600 / dw, 0) AS BIGINT)) ELSE 1600 END AS oh
  FROM (SELECT *, least(dw, dh) AS s, greatest(dw, dh) AS l, {scale} AS sc
    FROM (SELECT *, CASE WHEN orientation BETWEEN 5 AND 8 THEN height ELSE width END AS dw, CASE WHEN orientation BETWEEN 5 AND 8 THEN width ELSE height END AS dh,
        CASE WHEN n_frames <> 1 THEN 'animated or multi-page image' END AS error
      FROM assets WHERE {image}) a) b) c)"""
PLANNED_X4 = PLANNED.replace("{scale}", "4").replace("{image}", IMAGE)
PLANNED_X24 = PLANNED.replace("{scale}", "CASE WHEN least(dw, dh) * 2 >= 1600 THEN 2 ELSE 4 END").replace("{image}", IMAGE)
ROUTED = "routed AS (SELECT *, CASE WHEN category LIKE 'hat_x%' THEN CASE WHEN s < 1000 THEN 'normal' ELSE 'sharper' END END AS variant FROM planned)"
SWITCHES = """(SELECT coalesce(sum(CASE WHEN variant <> prev THEN 1 ELSE 0 END), 0) FROM
  (SELECT variant, lag(variant) OVER (ORDER BY lower(rel), rel) AS prev FROM routed WHERE variant IS NOT NULL) v)"""


def q_workload_report(spark, d):
    return workload.workload_report(assets(spark, d), (4,))


O_WORKLOAD = sql(
    ["assets"],
    f"""SELECT src.source_images, j.existing_jxl_files, j.existing_jxl_files - c.n AS jxl_only_skipped, c.n AS same_stem_jxl_replace_targets,
  src.sr_total, src.hat_x2, src.hat_x4, src.real_hat_normal, src.real_hat_sharper, src.real_hat_threshold_exact,
  CAST({SWITCHES} AS BIGINT) AS real_hat_model_switches, src.target_unmet, src.transcode_total, src.transcode_target_met,
  src.transcode_long_edge_safety, src.transcode_output_safety, src.transcode_other, src.errors
FROM (SELECT count(*) AS source_images, count(*) FILTER (category LIKE 'hat_x%') AS sr_total,
    count(*) FILTER (category = 'hat_x2') AS hat_x2, count(*) FILTER (category = 'hat_x4') AS hat_x4,
    count(*) FILTER (variant = 'normal') AS real_hat_normal, count(*) FILTER (variant = 'sharper') AS real_hat_sharper,
    count(*) FILTER (variant IS NOT NULL AND s = 1000) AS real_hat_threshold_exact,
    count(*) FILTER (category LIKE 'hat_x%' AND s * sc < 1600) AS target_unmet,
    count(*) FILTER (category LIKE 'transcode_%') AS transcode_total,
    count(*) FILTER (category = 'transcode_target_met') AS transcode_target_met,
    count(*) FILTER (category = 'transcode_long_edge_safety') AS transcode_long_edge_safety,
    count(*) FILTER (category = 'transcode_output_safety') AS transcode_output_safety,
    count(*) FILTER (category = 'transcode_other') AS transcode_other, count(*) FILTER (error IS NOT NULL) AS errors FROM routed) src,
  (SELECT count(DISTINCT lower(rel)) AS existing_jxl_files FROM assets WHERE {JXL}) j,
  (SELECT count(DISTINCT lower(rel)) AS n FROM assets WHERE {JXL} AND lower(rel) IN (SELECT {TARGET} FROM assets WHERE {IMAGE})) c""",
    [PLANNED_X4, ROUTED],
)


def q_resolution_plan(spark, d):
    df = planned(spark, d, (2, 4))
    return df.select(
        "rel",
        "display_width",
        "display_height",
        F.col("plan.upscale").alias("upscale"),
        F.col("plan.native_scale").cast("long").alias("native_scale"),
        F.col("plan.output_width").alias("output_width"),
        F.col("plan.output_height").alias("output_height"),
        F.col("plan.reason").alias("reason"),
        F.col("plan_error").alias("error"),
        "category",
        resolution.planned_action(F.col("plan")).alias("action"),
    )


O_RESOLUTION = sql(
    ["assets"],
    """SELECT rel, dw AS display_width, dh AS display_height,
  CASE WHEN error IS NULL THEN category LIKE 'hat_x%' END AS upscale,
  CAST(CASE WHEN error IS NOT NULL THEN NULL WHEN category LIKE 'hat_x%' THEN sc ELSE 1 END AS BIGINT) AS native_scale,
  CAST(CASE WHEN error IS NOT NULL THEN NULL WHEN category LIKE 'hat_x%' THEN ow ELSE dw END AS BIGINT) AS output_width,
  CAST(CASE WHEN error IS NOT NULL THEN NULL WHEN category LIKE 'hat_x%' THEN oh ELSE dh END AS BIGINT) AS output_height,
  CASE WHEN error IS NOT NULL THEN NULL WHEN category = 'transcode_target_met' THEN 'short edge already meets target'
    WHEN category = 'transcode_long_edge_safety' THEN 'long edge exceeds SR safety limit'
    WHEN category = 'transcode_output_safety' THEN 'planned output exceeds safety limit'
    WHEN s * sc < 1600 THEN 'maximum ' || CAST(sc AS VARCHAR) || 'x remains below target'
    ELSE CAST(sc AS VARCHAR) || 'x then resize to target short edge' END AS reason,
  error, category, CASE WHEN category LIKE 'hat_x%' THEN category ELSE 'transcode_only' END AS action
FROM planned""",
    [PLANNED_X24],
)


def q_workload_errors(spark, d):
    return workload.workload_errors(assets(spark, d), (4,))


O_WORKLOAD_ERRORS = sql(
    ["assets"],
    "SELECT lower(rel) AS key, rel AS source, error FROM planned WHERE error IS NOT NULL ORDER BY lower(rel) LIMIT 100",
    [PLANNED_X4],
)


def q_route_variant(spark, d):
    df = planned(spark, d).filter("plan_error IS NULL")
    return df.select(
        "rel",
        "short_edge",
        resolution.route_variant(F.col("short_edge"), POLICY.sharper_min_short_edge).alias("variant"),
        (F.col("short_edge") == POLICY.sharper_min_short_edge).alias("exact_threshold"),
    )


O_ROUTE = sql(
    ["assets"],
    "SELECT rel, s AS short_edge, CASE WHEN s < 1000 THEN 'normal' ELSE 'sharper' END AS variant, s = 1000 AS exact_threshold FROM planned WHERE error IS NULL",
    [PLANNED_X4],
)


def q_model_lookup(spark, d):
    """SR pages with the checkpoint they need; the model table is a handful of fixed rows."""
    pages = planned(spark, d).filter("upscale").select("rel", "variant", F.col("plan.native_scale").alias("native_scale"))
    found = models.model_lookup(pages, models.model_table(spark, "real-hat-auto"), require=True)
    return found.select("rel", "variant", "model_file", "model_label", "model_missing")


O_MODEL = sql(
    ["assets"],
    """SELECT rel, variant, CASE variant WHEN 'normal' THEN 'Real_HAT_GAN_SRx4.pth' ELSE 'Real_HAT_GAN_SRx4_sharper.pth' END AS model_file,
  'Real-HAT-GAN-x4-' || variant AS model_label, false AS model_missing FROM routed WHERE variant IS NOT NULL""",
    [PLANNED_X4, ROUTED],
)


def q_current_models(spark, d):
    """Plan, route and checkpoint of every image, composed to the model hash that recovery compares with."""
    table = models.model_table(spark, "real-hat-auto")
    hashes = table.select("model_file", F.sha2("model_file", 256).alias("sha256"))
    return models.current_models(planned(spark, d), table, hashes, "rel")


O_CURRENT_MODELS = sql(
    ["assets"],
    """SELECT rel, CASE WHEN error IS NOT NULL THEN NULL WHEN variant IS NULL THEN 'no-model:transcode-only:v1'
  ELSE sha256(CASE variant WHEN 'normal' THEN 'Real_HAT_GAN_SRx4.pth' ELSE 'Real_HAT_GAN_SRx4_sharper.pth' END) END AS current_model_sha256
FROM routed""",
    [PLANNED_X4, ROUTED],
)


def q_tile_choice(spark, d):
    df = planned(spark, d).filter("upscale")
    best = resolution.choose_tile(F.col("display_width"), F.col("display_height"), POLICY.tile_candidates, POLICY.tile_overlap)
    return df.withColumn("best", best).select("rel", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("tile", "tiles_x", "tiles_y", "tile_count", "expanded_edge", "work")])


O_TILE_CHOICE = sql(
    ["assets"],
    """SELECT rel, t AS tile, tx AS tiles_x, ty AS tiles_y, tx * ty AS tile_count, t + 32 AS expanded_edge, tx * ty * (t + 32) * (t + 32) AS work
FROM (SELECT rel, t, CAST(ceil(dw / t) AS BIGINT) AS tx, CAST(ceil(dh / t) AS BIGINT) AS ty,
    row_number() OVER (PARTITION BY rel ORDER BY ceil(dw / t) * ceil(dh / t) * (t + 32) * (t + 32), t) AS rn
  FROM routed, (VALUES (CAST(256 AS BIGINT)), (CAST(320 AS BIGINT))) c(t) WHERE variant IS NOT NULL) x WHERE rn = 1""",
    [PLANNED_X4, ROUTED],
)


def q_tile_grid(spark, d):
    from assetflow.operators.tiles import tile_grid

    df = planned(spark, d).filter("upscale")
    best = resolution.choose_tile(F.col("display_width"), F.col("display_height"), POLICY.tile_candidates, POLICY.tile_overlap)
    df = df.select("rel", "display_width", "display_height", best["tile"].cast("long").alias("tile"))
    return tile_grid(df, "display_width", "display_height", F.col("tile")).select(
        "rel", "tile", F.col("tile_y").alias("y"), F.col("tile_x").alias("x"), "core_height", "core_width"
    )


O_TILE_GRID = sql(
    ["assets"],
    """SELECT rel, t AS tile, y, x, least(t, dh - y) AS core_height, least(t, dw - x) AS core_width
FROM (SELECT *, unnest(range(0, dw, t)) AS x FROM (SELECT *, unnest(range(0, dh, t)) AS y FROM best) a) b""",
    [
        PLANNED_X4,
        ROUTED,
        """best AS (SELECT rel, dw, dh, t FROM (SELECT rel, dw, dh, t, row_number() OVER (PARTITION BY rel ORDER BY ceil(dw / t) * ceil(dh / t) * (t + 32) * (t + 32), t) AS rn
  FROM routed, (VALUES (CAST(256 AS BIGINT)), (CAST(320 AS BIGINT))) c(t) WHERE variant IS NOT NULL) x WHERE rn = 1)""",
    ],
)


def q_model_switches(spark, d):
    return ordering.model_switches(planned(spark, d).filter("upscale"))


O_SWITCHES = sql(["assets"], f"SELECT CAST({SWITCHES} AS BIGINT) AS switches", [PLANNED_X4, ROUTED])


def q_page_numbering(spark, d):
    return ordering.page_numbering(companions.images(assets(spark, d)).select("key", "rel")).select("rel", "page_index", "total")


O_NUMBERING = sql(
    ["assets"],
    f"SELECT rel, row_number() OVER (ORDER BY lower(rel), rel) AS page_index, count(*) OVER () AS total FROM assets WHERE {IMAGE}",
)


def q_destination_collision(spark, d):
    return companions.destination_collision(assets(spark, d))


O_COLLISION = sql(
    ["assets"],
    """SELECT key, source, first_source, sources FROM (
  SELECT key, rel AS source, min(rel) OVER (PARTITION BY key) AS first_source, count(*) OVER (PARTITION BY key) AS sources FROM m) c WHERE sources > 1""",
    [f"m AS (SELECT rel, CASE WHEN {IMAGE} THEN {TARGET} ELSE lower(rel) END AS key FROM assets WHERE {IMAGE} OR lower(rel) LIKE '%.json')"],
)


UNICODE = ("Straße", "STRASSE", "strasse", "café", "cafe\u0301", "CAFÉ")


def q_collision_unicode(spark, d):
    """Destination collisions of names that differ by case, full case folding or composition only."""
    names = F.element_at(F.array(*[F.lit(n) for n in UNICODE]), (F.col("asset_id") % len(UNICODE) + 1).cast("int"))
    named = assets(spark, d).select(F.concat(F.substring_index("rel", "/", 1), F.lit("/"), names, F.floor(F.col("asset_id") / 12).cast("string"), F.lit(".png")).alias("rel"))
    return companions.destination_collision(named)


O_COLLISION_UNICODE = sql(
    ["assets"],
    """SELECT key, source, first_source, sources FROM (
  SELECT key, rel AS source, min(rel) OVER (PARTITION BY key) AS first_source, count(*) OVER (PARTITION BY key) AS sources FROM m) c WHERE sources > 1""",
    [
        "named AS (SELECT split_part(rel, '/', 1) || '/' || (['" + "', '".join(UNICODE) + "'])[asset_id % 6 + 1] || CAST(asset_id // 12 AS VARCHAR) AS stem FROM assets)",
        "m AS (SELECT stem || '.png' AS rel, replace(lower(nfc_normalize(stem)), 'ß', 'ss') || '.jxl' AS key FROM named)",
    ],
)


def q_companion_key_collision(spark, d):
    """Collisions of all asset stems: the companion rule applied to every file's companion key."""
    stems = assets(spark, d).select(F.col("rel").alias("source"), paths.companion_key(F.col("key")).alias("key"))
    return companions.collisions(stems)


O_KEY_COLLISION = sql(
    ["assets"],
    f"""SELECT key, source, first_source, sources FROM (SELECT {TARGET} AS key, rel AS source, min(rel) OVER (PARTITION BY {TARGET}) AS first_source,
  count(*) OVER (PARTITION BY {TARGET}) AS sources FROM assets) c WHERE sources > 1""",
)


def q_companion_case_collision(spark, d):
    """Companion files whose names differ by case only."""
    return companions.companion_key_collision(assets(spark, d))


O_CASE_COLLISION = sql(
    ["assets"],
    f"""SELECT key, source, first_source, sources FROM (SELECT lower(rel) AS key, rel AS source, min(rel) OVER (PARTITION BY lower(rel)) AS first_source,
  count(*) OVER (PARTITION BY lower(rel)) AS sources FROM assets WHERE {JXL}) c WHERE sources > 1""",
)


def q_companion_join(spark, d):
    return companions.companion_join(assets(spark, d))


O_COMPANION = sql(
    ["assets"],
    f"""SELECT i.rel, i.companion_key, c.rel AS companion_rel, c.size AS companion_size
FROM (SELECT rel, {TARGET} AS companion_key FROM assets WHERE {IMAGE}) i LEFT JOIN
  (SELECT key, min(rel) AS rel, arg_min(size, rel) AS size FROM (SELECT lower(rel) AS key, rel, size FROM assets WHERE {JXL}) j GROUP BY key) c ON i.companion_key = c.key""",
)


def q_orphans(spark, d):
    return companions.orphan_companions(assets(spark, d))


O_ORPHANS = sql(
    ["assets"],
    f"SELECT rel, lower(rel) AS key FROM assets WHERE {JXL} AND lower(rel) NOT IN (SELECT {TARGET} FROM assets WHERE {IMAGE})",
)


def q_conflict_keys(spark, d):
    return companions.conflict_keys(assets(spark, d))


O_CONFLICT_KEYS = sql(
    ["assets"],
    f"SELECT DISTINCT lower(rel) AS key FROM assets WHERE {JXL} AND lower(rel) IN (SELECT {TARGET} FROM assets WHERE {IMAGE})",
)


def q_conflict_report(spark, d):
    return companions.conflict_report(assets(spark, d))


O_CONFLICT = sql(
    ["assets"],
    f"""SELECT 'replace_existing_jxl_after_source_processing' AS action, count(*) AS conflicts, count(DISTINCT i.k) AS targets, CAST(sum(c.size) AS BIGINT) AS jxl_bytes
FROM (SELECT rel, {TARGET} AS k FROM assets WHERE {IMAGE}) i JOIN
  (SELECT key, arg_min(size, rel) AS size FROM (SELECT lower(rel) AS key, rel, size FROM assets WHERE {JXL}) j GROUP BY key) c ON i.k = c.key HAVING count(*) > 0""",
)


def q_path_overlap(spark, d):
    """Page paths and site folders that contain one another."""
    clean = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = table(spark, d, "pages").select(paths.comparison_path(clean).alias("path"))
    folders = pages.select(F.explode(F.array("path", paths.dir_name(F.col("path")))).alias("path")).distinct()
    return attest_paths.contained_paths(folders)


O_OVERLAP = """WITH u AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '(.)/+$', '\\1') AS path FROM pages),
p AS (SELECT path FROM u UNION SELECT regexp_replace(path, '/?[^/]*$', '') FROM u)
SELECT c.path, a.path AS ancestor FROM p c JOIN p a ON starts_with(c.path, a.path || '/')"""


def q_root_isolation(spark, d):
    """Site folders as named roots: those that are equal or lie in one another, each pair once."""
    clean = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    folder = paths.dir_name(paths.comparison_path(clean))
    roots = table(spark, d, "pages").select(folder.alias("path")).distinct().select(F.concat(F.lit("site:"), "path").alias("name"), "path")
    return attest_paths.root_overlaps(roots.unionByName(roots.select(F.concat(F.lit("copy:"), "path").alias("name"), "path")))


O_ROOTS = """WITH u AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '(.)/+$', '\\1') AS path FROM pages),
f AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS path FROM u),
r AS (SELECT 'site:' || path AS name, path FROM f UNION ALL SELECT 'copy:' || path, path FROM f)
SELECT a.name AS left, b.name AS right FROM r a JOIN r b ON a.name < b.name AND (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/'))"""


def q_initial_actions(spark, d):
    """What a replacing and a mirroring run do first with every image."""
    images = companions.companion_join(assets(spark, d)).select("rel", F.col("companion_rel").isNotNull().alias("there"))
    return images.select("rel", resolution.initial_action(True, F.col("there")).alias("replacing"), resolution.initial_action(False, F.col("there")).alias("mirroring"))


O_INITIAL = sql(
    ["assets"],
    f"""SELECT rel, CASE WHEN {TARGET} IN (SELECT lower(rel) FROM assets WHERE {JXL}) THEN 'replace_existing_jxl' ELSE 'encode_new' END AS replacing, 'encode_mirror' AS mirroring
FROM assets WHERE {IMAGE}""",
)


def q_path_rules(spark, d):
    """Journal path rules on every recorded destination and temporary."""
    t = spark_view(spark, d, "transactions")
    c = F.col
    return t.select(
        "key",
        paths.unsafe_relative(c("source_path")).alias("unsafe_source"),
        F.coalesce(paths.destination_is_sibling(c("destination"), c("source_path"), F.lower), F.lit(False)).alias("sibling"),
        F.coalesce(paths.temporary_is_valid(c("temporary"), c("source_path"), c("destination"), F.lower), F.lit(False)).alias("temporary_ok"),
        paths.destination_path(c("key"), "JXL").alias("planned_destination"),
        paths.lower_suffix(c("key")).alias("suffix"),
        paths.windows_to_mount(F.concat(F.lit("Z:\\lib/"), F.translate(c("key"), "/", "\\"))).alias("mounted"),
        paths.path_overlap(F.concat(F.lit("/mnt/z/Lib/"), c("key")), F.concat(F.lit("/mnt/Z/lib/"), paths.dir_name(c("key")))).alias("inside_folder"),
    )


O_PATH_RULES = sql(
    ["transactions"],
    """SELECT key, source_path LIKE '/%' OR list_contains(string_split(source_path, '/'), '..') AS unsafe_source,
  coalesce(lower(destination) = regexp_replace(lower(source_path), '[.][^./]*$', '.jxl') AND NOT list_contains(string_split(destination, '/'), '..'), false) AS sibling,
  coalesce(regexp_replace(temporary, '[^/]*$', '') = regexp_replace(destination, '[^/]*$', '')
    AND starts_with(regexp_replace(temporary, '^.*/', ''), '.' || regexp_replace(destination, '^.*/', '') || '.')
    AND temporary LIKE '%.part' AND length(regexp_replace(temporary, '^.*/', '')) > length(regexp_replace(destination, '^.*/', '')) + 7, false) AS temporary_ok,
  regexp_replace(key, '[.][^./]*$', '.jxl') AS planned_destination, lower(regexp_extract(key, '[.][^./]*$')) AS suffix,
  '/mnt/z/lib/' || key AS mounted, true AS inside_folder
FROM transactions""",
)


def q_normalized_key(spark, d):
    """Keys of whole texts: composition and case folding far beyond ASCII."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(paths.normalized_key(F.col("text")), 256).alias("key_sha256"))


O_NORMALIZED = "SELECT doc_id, sha256(replace(lower(nfc_normalize(text)), 'ß', 'ss')) AS key_sha256 FROM documents"


# --- incremental -----------------------------------------------------------------------------


def manifest(spark, d):
    m = spark_view(spark, d, "manifest")
    return m.withColumn("output_sha256", F.sha2(F.concat("rel", F.lit(".out")), 256))


def q_incremental(spark, d):
    current = assets(spark, d).withColumnsRenamed({"sha256": "source_sha256"}).withColumn("pipeline_signature", F.lit("sig"))
    return incremental.incremental_status(
        current, manifest(spark, d), spark_view(spark, d, "outputs"), ("size", "mtime_ns", "source_sha256", "pipeline_signature")
    )


O_INCREMENTAL = sql(
    ["assets", "manifest", "outputs"],
    """SELECT a.rel, CASE WHEN m.rel IS NULL THEN 'new'
  WHEN NOT (a.size IS NOT DISTINCT FROM m.size AND a.mtime_ns IS NOT DISTINCT FROM m.mtime_ns AND a.sha256 IS NOT DISTINCT FROM m.source_sha256 AND m.pipeline_signature = 'sig') THEN 'changed'
  WHEN NOT coalesce(m.output_size = o.output_size AND o.output_sha256 = sha256(concat(a.rel, '.out')), false) THEN 'output_damaged'
  ELSE 'skip' END AS status
FROM assets a LEFT JOIN manifest m ON a.rel = m.rel LEFT JOIN outputs o ON a.rel = o.rel""",
)


def q_upsert(spark, d):
    old = spark_view(spark, d, "manifest").select("rel", "size", "source_sha256", "pipeline_signature")
    new = assets(spark, d).filter("n_frames = 1 AND bit_depth = 8").select("rel", "size", F.col("sha256").alias("source_sha256"), F.lit("sig").alias("pipeline_signature"))
    return incremental.manifest_upsert(old, new)


O_UPSERT = sql(
    ["assets", "manifest"],
    """SELECT rel, size, sha256 AS source_sha256, 'sig' AS pipeline_signature FROM assets WHERE n_frames = 1 AND bit_depth = 8
UNION ALL SELECT rel, size, source_sha256, pipeline_signature FROM manifest WHERE rel NOT IN (SELECT rel FROM assets WHERE n_frames = 1 AND bit_depth = 8)""",
)


def q_snapshot(spark, d):
    """All five fields of a planned snapshot against a listing in which each of them has changed for some files."""
    k = F.col("asset_id")
    planned_rows = assets(spark, d).select("rel", "size", "mtime_ns", (F.col("mtime_ns") + 5).alias("ctime_ns"), (k % 3).alias("device"), k.alias("inode"), k)
    changed = {"size": 17, "mtime_ns": 19, "ctime_ns": 23, "device": 29, "inode": 31}
    listing = planned_rows.filter(k % 10 != 3).select("rel", *[F.when(k % of == 0, F.col(c) + 1).otherwise(F.col(c)).alias(c) for c, of in changed.items()])
    return incremental.snapshot_recheck(planned_rows.drop("asset_id"), listing)


O_SNAPSHOT = sql(
    ["assets"],
    """SELECT rel, CASE WHEN asset_id % 10 = 3 THEN 'deferred_missing' WHEN asset_id % 17 = 0 OR asset_id % 19 = 0 OR asset_id % 23 = 0 OR asset_id % 29 = 0 OR asset_id % 31 = 0 THEN 'deferred_changed' ELSE 'ok' END AS verdict
FROM assets""",
)


def q_metadata(spark, d):
    files = companions.classify(assets(spark, d), include_metadata=True).filter("class = 'metadata'").select("rel", "size", "sha256")
    there = spark_view(spark, d, "manifest").select("rel", "size", F.col("source_sha256").alias("sha256"))
    return incremental.metadata_copy_plan(files, there)


O_METADATA = sql(
    ["assets", "manifest"],
    """SELECT rel, size, sha256 FROM assets a WHERE rel LIKE '%.json'
  AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.rel = a.rel AND m.size = a.size AND m.source_sha256 = a.sha256)""",
)


def q_checksum(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id"), content_sha256(F.col("text")).alias("sha256"))
    listed = manifest_entries(spark, d)
    return scans.checksum_verify(listed, files, "doc_id")


def manifest_entries(spark, d):
    """Expected hashes for every document, some of them wrong, absent or listed twice."""
    docs = table(spark, d, "documents").select("doc_id", "source", content_sha256(F.col("text")).alias("sha256"))
    wrong = F.when(F.col("source") == "src1", F.lit("")).when(F.col("source") == "src2", F.sha2("source", 256)).otherwise(F.upper("sha256"))
    listed = docs.select((F.col("doc_id") + F.when(F.col("source") == "src3", F.lit(1_000_000_000)).otherwise(F.lit(0))).alias("doc_id"), wrong.alias("expected_sha256"))
    return listed.unionByName(listed.filter("doc_id % 7 = 0"))  # entries that occur twice




O_CHECKSUM = """WITH f AS (SELECT doc_id, source, sha256(text) AS sha256 FROM documents),
e AS (SELECT doc_id + CASE WHEN source = 'src3' THEN 1000000000 ELSE 0 END AS doc_id, CASE source WHEN 'src1' THEN '' WHEN 'src2' THEN sha256(source) ELSE sha256 END AS expected FROM f)
SELECT e.doc_id, CAST(CASE WHEN e.doc_id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS entries, CASE WHEN e.doc_id % 7 = 0 THEN 'ambiguous' WHEN f.sha256 IS NULL THEN 'missing' WHEN e.expected <> '' AND e.expected <> f.sha256 THEN 'mismatch' ELSE 'present' END AS status
FROM e LEFT JOIN f ON e.doc_id = f.doc_id"""


def q_policy_gate(spark, d):
    df = planned(spark, d, (2, 4)).filter("plan_error IS NULL")
    up, rel = F.col("upscale"), F.col("rel")
    refusals = resolution.replace_refusals(
        upscale=up, path=rel, has_metadata=F.col("has_metadata"), has_alpha=F.col("has_alpha"), bit_depth=F.col("bit_depth")
    )
    return df.select(
        "rel",
        F.coalesce(resolution.first_code(refusals), F.lit("allowed")).alias("verdict"),
        F.size(refusals).cast("long").alias("refusals"),
        resolution.encode_mode(up, rel).alias("encode_mode"),
        resolution.encode_distance(up).alias("distance"),
    )


O_POLICY = sql(
    ["assets"],
    """SELECT rel, CASE WHEN jr THEN 'allowed' WHEN has_metadata THEN 'metadata_loss' WHEN has_alpha THEN 'alpha_flatten' WHEN bit_depth > 8 THEN 'bit_depth_loss' ELSE 'allowed' END AS verdict,
  CASE WHEN jr THEN CAST(0 AS BIGINT) ELSE CAST(has_metadata AS BIGINT) + CAST(has_alpha AS BIGINT) + CAST(bit_depth > 8 AS BIGINT) END AS refusals,
  CASE WHEN jr THEN 'jpeg_reconstruction' ELSE 'pixels' END AS encode_mode, CASE WHEN category LIKE 'hat_x%' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS distance
FROM (SELECT *, category NOT LIKE 'hat_x%' AND regexp_matches(rel, '[.]jpe?g$') AS jr FROM planned WHERE error IS NULL) p""",
    [PLANNED_X24],
)


def q_output_admissible(spark, d):
    """Ownership and admissibility of every recorded destination, both output modes."""
    t = spark_view(spark, d, "transactions")
    c = F.col
    owned = incremental.owned_output(c("output_size"), c("output_sha256"), c("destination_size"), c("destination_sha256"))
    target = F.concat(F.regexp_replace("key", "[.][^./]*$", ""), F.lit(".jxl"))
    managed = incremental.managed_output(c("destination"), target, owned)
    exists = c("destination_sha256").isNotNull()
    common = dict(exists=exists, owned=owned, managed=managed, phase=c("phase"), recorded_destination=c("destination"), path=target)
    return t.select(
        "key",
        owned.alias("owned"),
        managed.alias("managed"),
        incremental.output_admissible(replace=True, **common).alias("replace_ok"),
        incremental.output_admissible(replace=False, **common).alias("mirror_ok"),
    )


O_ADMISSIBLE = sql(
    ["transactions"],
    """SELECT key, owned, managed, destination_sha256 IS NULL OR owned OR (phase IN ('prepared', 'encoded', 'output_ready') AND managed) AS replace_ok,
  destination_sha256 IS NULL OR managed AS mirror_ok
FROM (SELECT *, coalesce(output_size = destination_size AND output_sha256 = destination_sha256, false) AS owned,
  destination = regexp_replace(key, '[.][^./]*$', '') || '.jxl' AS managed FROM transactions) t""",
)


def q_triage(spark, d):
    return journal.triage(spark_view(spark, d, "transactions"), key=paths.ascii_key)


TRIAGE_FACTS = """facts AS (SELECT *,
  phase = 'prepared' AS prepared, phase = 'encoded' AS encoded, phase = 'output_ready' AS ready, action = 'adopt_existing_jxl' AS adopt,
  coalesce(source_exists AND actual_source_size = source_size AND actual_source_sha256 = source_sha256, false) AS matches,
  destination_sha256 IS NOT NULL AS there,
  coalesce(destination_sha256 = candidate_sha256, false) AS is_candidate, coalesce(destination_sha256 = previous_output_sha256, false) AS is_previous,
  coalesce(output_size = destination_size AND output_sha256 = destination_sha256, false) AS owned,
  coalesce(destination_width = output_width AND destination_height = output_height, false) AS dims,
  coalesce(regexp_replace(temporary, '[^/]*$', '') = regexp_replace(destination, '[^/]*$', '')
    AND starts_with(regexp_replace(temporary, '^.*/', ''), '.' || regexp_replace(destination, '^.*/', '') || '.')
    AND temporary LIKE '%.part' AND length(regexp_replace(temporary, '^.*/', '')) > length(regexp_replace(destination, '^.*/', '')) + 7, false) AS temporary_ok,
  regexp_matches(candidate_sha256, '^[0-9a-f]{64}$') AS candidate_ok
FROM transactions WHERE phase IN ('prepared', 'encoded', 'output_ready')),
judged AS (SELECT *, CASE WHEN action NOT IN ('legacy_replace', 'sr', 'transcode_only', 'adopt_existing_jxl') THEN 'unknown_action' WHEN adopt AND NOT ready THEN 'adopt_phase'
  WHEN source_path LIKE '../%' THEN 'unsafe_path' WHEN lower(destination) <> regexp_replace(lower(source_path), '[.][^./]*$', '.jxl') THEN 'destination'
  WHEN (adopt AND temporary IS NOT NULL) OR (NOT adopt AND NOT temporary_ok) THEN 'temporary'
  WHEN encode_mode NOT IN ('pixels', 'jpeg_reconstruction') THEN 'encode_mode' WHEN output_width < 1 OR output_height < 1 THEN 'dimensions'
  WHEN encoded AND NOT verified THEN 'unverified_candidate' WHEN encoded AND NOT candidate_ok THEN 'candidate_hash' WHEN encoded AND candidate_size < 1 THEN 'candidate_size' END AS invalid,
  CASE WHEN NOT root_matches THEN 'root_changed' WHEN NOT signature_matches THEN 'signature_changed' WHEN NOT adopt AND matches AND model_sha256 <> current_model_sha256 THEN 'model_changed' END AS stale,
  CASE WHEN previous_output_sha256 IS NULL THEN NOT there ELSE is_previous END AS untouched, encode_mode <> 'jpeg_reconstruction' AND NOT dims AS wrong FROM facts),
decided AS (SELECT *, CASE WHEN invalid IS NOT NULL THEN 'error:' || invalid
  WHEN prepared AND NOT source_exists AND root_matches THEN CASE WHEN NOT there THEN 'error:lost_source' WHEN is_previous THEN 'error:no_new_output' WHEN NOT dims THEN 'error:wrong_dimensions' ELSE 'external_completion' END
  WHEN stale IS NOT NULL THEN CASE WHEN NOT source_exists THEN 'error:stale_without_source' WHEN ready AND NOT adopt AND owned THEN 'redo_managed_output'
    WHEN encoded AND temporary_sha256 IS NULL AND is_candidate THEN 'redo_managed_output' ELSE 'replan_stale' END
  WHEN prepared THEN CASE WHEN there AND NOT is_previous THEN 'error:unrecorded_destination' WHEN NOT matches THEN 'discard_replan' ELSE 'retry' END
  WHEN encoded AND temporary_sha256 IS NOT NULL THEN CASE WHEN NOT source_exists THEN 'error:lost_source' WHEN NOT matches THEN 'discard_defer'
    WHEN temporary_size <> candidate_size OR temporary_sha256 <> candidate_sha256 THEN 'error:candidate_changed' WHEN NOT untouched THEN 'error:destination_changed' ELSE 'commit' END
  WHEN encoded THEN CASE WHEN is_candidate AND wrong THEN 'error:wrong_dimensions' WHEN is_candidate THEN 'commit' WHEN source_exists AND NOT matches AND untouched THEN 'discard_replan'
    WHEN source_exists AND NOT matches THEN 'error:destination_changed' ELSE 'error:candidate_missing' END
  WHEN NOT owned THEN 'error:damaged_output' WHEN source_exists AND NOT matches THEN CASE WHEN adopt THEN 'discard_defer' ELSE 'retain_source' END
  WHEN NOT verified THEN 'error:unverified' WHEN wrong THEN 'error:wrong_dimensions' WHEN NOT source_exists THEN 'finalize' ELSE 'remove_source' END AS decision FROM judged)"""
O_TRIAGE = sql(
    ["transactions"],
    """SELECT key, phase, action, decision, CASE WHEN decision = 'commit' THEN CASE WHEN source_exists AND NOT matches THEN 'retain_source' WHEN NOT source_exists THEN 'finalize' ELSE 'remove_source' END END AS "then",
  CASE WHEN decision IN ('replan_stale', 'redo_managed_output', 'error:stale_without_source') THEN stale END AS context_issue,
  decision IN ('external_completion', 'discard_defer') AS blocked, decision = 'external_completion' AS external FROM decided""",
    [TRIAGE_FACTS],
)


def q_journal_violations(spark, d):
    t = spark_view(spark, d, "transactions").filter(F.col("phase") != "committed")
    return t.select("key", F.explode(journal.record_violations()).alias("violation"))


O_JOURNAL_VIOLATIONS = sql(
    ["transactions"],
    """SELECT key, unnest(list_filter([CASE WHEN encode_mode NOT IN ('pixels', 'jpeg_reconstruction') THEN 'encode_mode' END,
  CASE WHEN output_width < 1 OR output_height < 1 THEN 'dimensions' END, CASE WHEN phase = 'encoded' AND NOT verified THEN 'unverified_candidate' END,
  CASE WHEN phase = 'encoded' AND NOT regexp_matches(candidate_sha256, '^[0-9a-f]{64}$') THEN 'candidate_hash' END], lambda v: v IS NOT NULL)) AS violation
FROM transactions WHERE phase <> 'committed'""",
)


def q_reappeared(spark, d):
    blocked = journal.blocked_keys(journal.triage(spark_view(spark, d, "transactions"), key=paths.ascii_key))
    return incremental.reappeared_sources(assets(spark, d).select(F.col("rel").alias("key")), blocked)


O_REAPPEARED = sql(
    ["transactions", "assets"],
    """SELECT a.rel AS key, CASE WHEN decision = 'external_completion' THEN 'deferred' ELSE 'skipped' END AS decision
FROM assets a JOIN decided d ON a.rel = d.key WHERE decision IN ('external_completion', 'discard_defer')""",
    [TRIAGE_FACTS],
)


# --- reconcile -------------------------------------------------------------------------------


def q_set_reconcile(spark, d):
    return reconcile.set_reconcile(spark_view(spark, d, "manifest"), spark_view(spark, d, "outputs"), "rel")


O_SET = sql(
    ["manifest", "outputs"],
    """SELECT coalesce(m.rel, o.rel) AS rel, CASE WHEN o.rel IS NULL THEN 'missing' ELSE 'extra' END AS verdict
FROM manifest m FULL OUTER JOIN outputs o ON m.rel = o.rel WHERE m.rel IS NULL OR o.rel IS NULL""",
)


def q_fact_drift(spark, d):
    expected = assets(spark, d).select("rel", "size", "mtime_ns", F.col("sha256").alias("source_sha256"), (F.col("size") * 2).alias("output_size"))
    return reconcile.fact_drift(expected, spark_view(spark, d, "manifest"), "rel", ("size", "mtime_ns", "source_sha256", "output_size"))


O_DRIFT = sql(
    ["assets", "manifest"],
    """SELECT rel, field, expected, actual FROM (
  SELECT a.rel, 'size' AS field, CAST(a.size AS VARCHAR) AS expected, CAST(m.size AS VARCHAR) AS actual FROM assets a JOIN manifest m ON a.rel = m.rel
  UNION ALL SELECT a.rel, 'mtime_ns', CAST(a.mtime_ns AS VARCHAR), CAST(m.mtime_ns AS VARCHAR) FROM assets a JOIN manifest m ON a.rel = m.rel
  UNION ALL SELECT a.rel, 'source_sha256', a.sha256, m.source_sha256 FROM assets a JOIN manifest m ON a.rel = m.rel
  UNION ALL SELECT a.rel, 'output_size', CAST(a.size * 2 AS VARCHAR), CAST(m.output_size AS VARCHAR) FROM assets a JOIN manifest m ON a.rel = m.rel) f
WHERE expected IS DISTINCT FROM actual""",
)


def q_baseline(spark, d):
    before = spark_view(spark, d, "manifest").select("rel", "size", F.col("source_sha256").alias("sha256"))
    after = assets(spark, d).select("rel", "size", "sha256")
    return reconcile.baseline_compare(before, after)


O_BASELINE = sql(
    ["assets", "manifest"],
    """SELECT *, 'removed' AS change, CAST(1 AS BIGINT) AS copies FROM (SELECT rel, size, source_sha256 AS sha256 FROM manifest EXCEPT ALL SELECT rel, size, sha256 FROM assets) r
UNION ALL SELECT *, 'added', CAST(1 AS BIGINT) FROM (SELECT rel, size, sha256 FROM assets EXCEPT ALL SELECT rel, size, source_sha256 FROM manifest) a""",
)


def q_uniqueness(spark, d):
    a = assets(spark, d)
    return reconcile.duplicates(a.select("sha256"), ["sha256"])


O_UNIQUE = sql(["assets"], "SELECT sha256, count(*) AS copies FROM assets GROUP BY sha256 HAVING count(*) > 1")


def q_fingerprint(spark, d):
    """Fingerprint row of every image; transcode-only pages carry the marker instead of a model hash."""
    from assetflow.functions.fingerprint import config_signature, model_or_transcode

    df = planned(spark, d, (2, 4)).filter("plan_error IS NULL")
    model = F.sha2(F.col("variant"), 256)
    return df.select(
        "rel",
        "size",
        "mtime_ns",
        F.col("sha256").alias("source_sha256"),
        F.lit("/data/library").alias("source_root"),
        model_or_transcode(F.col("upscale"), model).alias("model_sha256"),
        config_signature({"target_short_edge": POLICY.target_short_edge, "scales": [2, 4]}).alias("pipeline_signature"),
    )


O_FINGERPRINT = sql(
    ["assets"],
    """SELECT rel, size, mtime_ns, sha256 AS source_sha256, '/data/library' AS source_root,
  CASE WHEN category LIKE 'hat_x%' THEN sha256(CASE WHEN s < 1000 THEN 'normal' ELSE 'sharper' END) ELSE 'no-model:transcode-only:v1' END AS model_sha256,
  sha256('{"scales":[2,4],"target_short_edge":1600}') AS pipeline_signature FROM planned WHERE error IS NULL""",
    [PLANNED_X24],
)

SENSITIVE = (
    ("e-mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}", "@"),
    ("ip address", r"\d{1,3}(\.\d{1,3}){3}", "."),
    ("credential", r"(?i)(password|secret|token|api[_-]?key)\s*[=:]", "=", ":"),
    ("license line", r"(?i)licen[sc]e"),
    *scans.PATTERNS,
)


def q_sensitive(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, d, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return scans.pattern_findings(docs.unionByName(turns), "text", SENSITIVE)


def _sensitive_sql() -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(text, '{regex}') THEN '{label}' END" for label, regex, *_ in SENSITIVE)
    return f"""SELECT origin, id, finding FROM (SELECT origin, id, unnest([{tests}]) AS finding FROM (
  SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations) t) f WHERE finding IS NOT NULL"""


def q_worklist_plan(spark, d):
    """Items with the last of several appended plans: one plan per scale policy and page."""
    items = assets(spark, d).filter(paths.is_image(F.col("rel"))).select(F.col("rel").alias("source"), F.lit("encode_mirror").alias("action"))
    plans = planned(spark, d, (2, 4)).unionByName(planned(spark, d, (4,)).filter("size % 2 = 0")).filter("plan_error IS NULL")
    rows = plans.select(
        F.col("rel").alias("source"),
        (F.col("plan.native_scale") * 1000 + F.col("plan.output_width") % 1000).cast("long").alias("line_no"),
        resolution.planned_action(F.col("plan")).alias("action"),
        F.col("plan.output_width").alias("planned_width"),
        F.col("plan.output_height").alias("planned_height"),
        F.col("plan.native_scale").cast("long").alias("native_scale"),
        F.col("plan.reason").alias("reason"),
    )
    return reconcile.worklist_with_plan(items, rows).select("source", "action", "planned_action", "planned_width", "planned_height", "native_scale")


O_WORKLIST = sql(
    ["assets"],
    f"""SELECT i.rel AS source, 'encode_mirror' AS action, p.action AS planned_action, p.ow AS planned_width, p.oh AS planned_height, p.sc AS native_scale
FROM (SELECT rel FROM assets WHERE {IMAGE}) i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY line_no DESC) AS rn FROM plans) p ON i.rel = p.rel AND p.rn = 1""",
    [
        PLANNED_X24,
        PLANNED_X4.replace("planned AS", "planned4 AS", 1),
        """plans AS (SELECT rel, CASE WHEN up THEN category ELSE 'transcode_only' END AS action, CAST(CASE WHEN up THEN ow ELSE dw END AS BIGINT) AS ow, CAST(CASE WHEN up THEN oh ELSE dh END AS BIGINT) AS oh,
  CAST(CASE WHEN up THEN sc ELSE 1 END AS BIGINT) AS sc, CASE WHEN up THEN sc ELSE 1 END * 1000 + CASE WHEN up THEN ow ELSE dw END % 1000 AS line_no
FROM (SELECT *, category LIKE 'hat_x%' AS up FROM (SELECT * FROM planned UNION ALL SELECT * FROM planned4 WHERE size % 2 = 0) u WHERE error IS NULL) x)""",
    ],
)


REGISTRY = {
    "workload_report": (q_workload_report, O_WORKLOAD),
    "workload_errors": (q_workload_errors, O_WORKLOAD_ERRORS),
    "resolution_plan": (q_resolution_plan, O_RESOLUTION),
    "route_variant": (q_route_variant, O_ROUTE),
    "model_lookup": (q_model_lookup, O_MODEL),
    "current_models": (q_current_models, O_CURRENT_MODELS),
    "tile_choice": (q_tile_choice, O_TILE_CHOICE),
    "tile_grid": (q_tile_grid, O_TILE_GRID),
    "model_switches": (q_model_switches, O_SWITCHES),
    "page_numbering": (q_page_numbering, O_NUMBERING),
    "destination_collision": (q_destination_collision, O_COLLISION),
    "collision_unicode": (q_collision_unicode, O_COLLISION_UNICODE),
    "companion_key_collision": (q_companion_key_collision, O_KEY_COLLISION),
    "companion_case_collision": (q_companion_case_collision, O_CASE_COLLISION),
    "companion_join": (q_companion_join, O_COMPANION),
    "orphan_companions": (q_orphans, O_ORPHANS),
    "conflict_keys": (q_conflict_keys, O_CONFLICT_KEYS),
    "conflict_report": (q_conflict_report, O_CONFLICT),
    "path_overlap": (q_path_overlap, O_OVERLAP),
    "root_isolation": (q_root_isolation, O_ROOTS),
    "initial_actions": (q_initial_actions, O_INITIAL),
    "path_rules": (q_path_rules, O_PATH_RULES),
    "normalized_key": (q_normalized_key, O_NORMALIZED),
    "incremental_status": (q_incremental, O_INCREMENTAL),
    "manifest_upsert": (q_upsert, O_UPSERT),
    "snapshot_recheck": (q_snapshot, O_SNAPSHOT),
    "metadata_copy_plan": (q_metadata, O_METADATA),
    "checksum_verify": (q_checksum, O_CHECKSUM),
    "policy_gate": (q_policy_gate, O_POLICY),
    "output_admissible": (q_output_admissible, O_ADMISSIBLE),
    "recovery_triage": (q_triage, O_TRIAGE),
    "journal_violations": (q_journal_violations, O_JOURNAL_VIOLATIONS),
    "reappeared_sources": (q_reappeared, O_REAPPEARED),
    "set_reconcile": (q_set_reconcile, O_SET),
    "fact_drift": (q_fact_drift, O_DRIFT),
    "baseline_compare": (q_baseline, O_BASELINE),
    "uniqueness": (q_uniqueness, O_UNIQUE),
    "fingerprint": (q_fingerprint, O_FINGERPRINT),
    "sensitive_scan": (q_sensitive, _sensitive_sql()),
    "worklist_plan": (q_worklist_plan, O_WORKLIST),
}
