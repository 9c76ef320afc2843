"""Views over the driver tables, in SQL that Spark and DuckDB both read.

The tables hold no images, so these are deterministic stand-ins: every view reads whole
tables and grows with them.  ``spark_view`` gives a DataFrame, ``duckdb_ctes`` the same text as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (views or tables it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "assets": (
        ("documents",),
        """
SELECT doc_id AS asset_id,
  concat(lang, '/', CAST(CAST(floor(doc_id/2) AS BIGINT) AS VARCHAR(20)), CASE doc_id % 9 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jxl' WHEN 3 THEN '.JXL' WHEN 4 THEN '.webp' WHEN 5 THEN '.tif' WHEN 6 THEN '.json' WHEN 7 THEN '.bmp' ELSE '.gif' END) AS rel,
  n_chars AS size, doc_id * 1000003 AS mtime_ns,
  300 + (doc_id * 37) % 1500 AS width, 300 + (doc_id * 91) % 3400 AS height,
  1 + doc_id % 8 AS orientation, CASE WHEN doc_id % 50 = 49 THEN 2 ELSE 1 END AS n_frames,
  CASE WHEN doc_id % 6 = 0 THEN 16 ELSE 8 END AS bit_depth, doc_id % 13 = 0 AS has_alpha, doc_id % 4 = 1 AS has_metadata,
  {sha}(text{enc}) AS sha256
FROM documents""",
    ),
    "manifest": (
        ("assets",),
        """
SELECT rel, CASE WHEN asset_id % 17 = 0 THEN size + 1 ELSE size END AS size, mtime_ns,
  CASE WHEN asset_id % 7 = 0 THEN repeat('0',64) ELSE sha256 END AS source_sha256,
  CASE WHEN asset_id % 11 = 0 THEN 'sig-old' ELSE 'sig' END AS pipeline_signature,
  CASE WHEN asset_id % 19 = 0 THEN NULL ELSE size * 2 END AS output_size
FROM assets WHERE asset_id % 10 <> 3""",
    ),
    "spans": (
        ("events",),
        """
SELECT concat('r', CAST(user_id % 3 AS VARCHAR(4))) AS run_id, user_id AS page,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'engine_path' WHEN 'purchase' THEN 'jxl_service' WHEN 'signup' THEN 'gpu_inference' ELSE 'commit' END AS name,
  {us} * 1000 AS start_ns, {us} * 1000 + CAST(floor(value * 60) AS BIGINT) * 1000000000 AS end_ns
FROM events""",
    ),
    "pixels": (
        ("embeddings",),
        """
SELECT image_id, y, x,
  CASE WHEN k = 1 AND y BETWEEN 10 AND 12 AND x BETWEEN 10 AND 12 THEN 100 WHEN k = 2 AND y BETWEEN 10 AND 11 AND x BETWEEN 10 AND 11 THEN 220 WHEN k = 3 AND y % 16 = 0 AND x % 16 = 0 THEN 112 WHEN k = 5 AND y % 8 = 0 AND x % 8 = 0 THEN 90 ELSE r0 END AS r,
  CASE WHEN k = 1 AND y BETWEEN 10 AND 12 AND x BETWEEN 10 AND 12 THEN 140 WHEN k = 2 AND y BETWEEN 10 AND 11 AND x BETWEEN 10 AND 11 THEN 20 WHEN k = 3 AND y % 16 = 0 AND x % 16 = 0 THEN 145 WHEN k = 5 AND y % 8 = 0 AND x % 8 = 0 THEN 150 WHEN k = 4 THEN CAST(floor(v * 1700) AS BIGINT) % 256 ELSE r0 END AS g,
  CASE WHEN k = 1 AND y BETWEEN 10 AND 12 AND x BETWEEN 10 AND 12 THEN 105 WHEN k = 2 AND y BETWEEN 10 AND 11 AND x BETWEEN 10 AND 11 THEN 20 WHEN k = 3 AND y % 16 = 0 AND x % 16 = 0 THEN 124 WHEN k = 5 AND y % 8 = 0 AND x % 8 = 0 THEN 120 WHEN k = 4 THEN CAST(floor(v * 2900) AS BIGINT) % 256 ELSE greatest(0, r0 - x % 3) END AS b
FROM (SELECT CAST(floor(vec_id / 16) AS BIGINT) AS image_id, CAST(floor(vec_id / 16) AS BIGINT) % 6 AS k, abs(v) AS v, CAST(floor(abs(v) * 1000) AS BIGINT) % 256 AS r0,
    CAST(floor((vec_id % 16) / 4) * 8 + floor(pos / 8) AS BIGINT) AS y, CAST((vec_id % 4) * 8 + pos % 8 AS BIGINT) AS x
  FROM ({emb}) e) p""",
    ),
    "journal": (
        ("assets",),
        """
SELECT rel AS key, CASE asset_id % 4 WHEN 0 THEN 'prepared' WHEN 1 THEN 'encoded' WHEN 2 THEN 'output_ready' ELSE 'committed' END AS phase,
  CASE WHEN asset_id % 23 = 0 THEN 'bogus' WHEN asset_id % 5 = 0 THEN 'transcode_only' ELSE 'sr' END AS action,
  sha256 AS source_sha256, size, CASE WHEN asset_id % 9 = 0 THEN upper(sha256) ELSE sha256 END AS candidate_sha256,
  CASE WHEN asset_id % 21 = 0 THEN 0 ELSE width END AS output_width, height AS output_height, asset_id % 3 <> 0 AS verified, asset_id % 8 <> 0 AS source_present
FROM assets WHERE lower(rel) NOT LIKE '%.jxl' AND lower(rel) NOT LIKE '%.json' AND lower(rel) NOT LIKE '%.gif'""",
    ),
    "outcomes": (
        ("lineitem",),
        """
SELECT l_orderkey % 40 AS run,
  CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'N' THEN 'skipped' ELSE 'deferred' END AS status,
  CASE WHEN l_quantity < 25 THEN 'normal' ELSE 'sharper' END AS route, CASE WHEN l_linenumber % 2 = 0 THEN 256 ELSE 320 END AS tile,
  CAST(floor(l_extendedprice) AS BIGINT) AS output_bytes, l_tax AS seconds
FROM lineitem""",
    ),
    "job_outcomes": (
        ("lineitem",),
        """
SELECT concat('r', CAST(l_orderkey % 40 AS VARCHAR(10))) AS run_id,
  CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN 'error' WHEN l_returnflag = 'A' THEN 'complete' WHEN l_returnflag = 'N' THEN 'skipped' ELSE 'deferred' END AS status,
  CASE l_suppkey % 10 WHEN 0 THEN 'metadata' WHEN 1 THEN 'ignored' WHEN 2 THEN 'jxl' ELSE 'image' END AS kind,
  l_quantity < 25 AS upscale,
  CASE WHEN l_partkey % 5 = 0 THEN 'maximum 4x remains below target' ELSE '4x then resize to target short edge' END AS reason,
  CASE l_partkey % 4 WHEN 0 THEN 'adopted' WHEN 1 THEN 'replaced' WHEN 2 THEN 'new' END AS replacement,
  l_suppkey % 7 = 0 AS external, l_linenumber = 6 AS write_error, CAST(floor(l_extendedprice) AS BIGINT) AS output_bytes,
  l_tax AS inference_seconds, l_discount AS postprocess_seconds, l_tax + l_discount AS encoding_seconds,
  1700000000000000000 + l_orderkey * 1000000000 AS start_ns, 1700000000000000000 + (l_orderkey + l_linenumber) * 1000000000 + 250000 AS end_ns
FROM lineitem""",
    ),
    "services": (
        ("events",),
        """
SELECT event_id AS page, user_id % 3 AS run,
  CASE event_type WHEN 'view' THEN 'h2d' WHEN 'click' THEN 'forward' WHEN 'purchase' THEN 'gpu_postprocess' WHEN 'signup' THEN 'd2h' ELSE 'gpu_total' END AS service,
  value AS seconds
FROM events""",
    ),
    "rounds": (
        ("lineitem",),
        """
SELECT l_orderkey % 12 AS page, l_linenumber % 3 AS round, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS side,
  CASE WHEN l_partkey % 2 = 0 THEN 'normal' ELSE 'sharper' END AS route, CASE WHEN l_linenumber % 2 = 0 THEN 256 ELSE 320 END AS tile,
  CAST(floor(l_extendedprice) AS BIGINT) AS wall_ms
FROM lineitem""",
    ),
    # in-flight transactions with what is on disk for each: drifted sources and candidates,
    # missing and foreign destinations, changed roots, signatures and models
    "transactions": (
        ("journal",),
        """
SELECT key, phase, CASE WHEN size % 31 = 0 THEN 'adopt_existing_jxl' ELSE action END AS action,
  CASE WHEN size % 37 = 0 THEN concat('../', key) ELSE key END AS source_path,
  CASE WHEN size % 41 = 0 THEN concat(key, '.out') ELSE concat(regexp_replace(key, '[.][^./]*$', ''), '.jxl') END AS destination,
  CASE WHEN size % 31 = 0 THEN NULL ELSE concat(regexp_replace(key, '[^/]*$', ''), '.', regexp_replace(regexp_replace(key, '^.*/', ''), '[.][^./]*$', ''), '.jxl.', CASE WHEN size % 43 = 0 THEN '' ELSE 'tok' END, '.part') END AS temporary,
  CASE WHEN size % 47 = 0 THEN 'raster' WHEN size % 10 = 0 THEN 'jpeg_reconstruction' ELSE 'pixels' END AS encode_mode,
  output_width, output_height,
  CASE WHEN size % 4 = 0 THEN NULL ELSE sha256_prev END AS previous_output_sha256,
  verified, candidate_sha256, size AS candidate_size,
  size % 53 <> 0 AS root_matches, size % 29 <> 0 AS signature_matches,
  CASE WHEN size % 59 = 0 THEN 'model-b' ELSE 'model-a' END AS model_sha256, 'model-a' AS current_model_sha256,
  source_present AS source_exists, size AS source_size, source_sha256,
  CASE WHEN source_present THEN CASE WHEN size % 19 = 0 THEN size + 1 ELSE size END END AS actual_source_size,
  CASE WHEN source_present THEN CASE WHEN size % 23 = 0 THEN sha256_other ELSE source_sha256 END END AS actual_source_sha256,
  CASE WHEN size % 6 = 0 THEN candidate_sha256 WHEN size % 4 = 0 THEN NULL WHEN size % 6 = 1 THEN sha256_other ELSE sha256_prev END AS destination_sha256,
  CASE WHEN size % 6 = 0 THEN size WHEN size % 4 = 0 THEN NULL ELSE size * 2 END AS destination_size,
  CASE WHEN size % 7 = 0 THEN output_width + 1 ELSE output_width END AS destination_width, output_height AS destination_height,
  CASE WHEN size % 3 = 0 THEN NULL WHEN size % 17 = 0 THEN sha256_other ELSE candidate_sha256 END AS temporary_sha256,
  CASE WHEN size % 3 = 0 THEN NULL ELSE size END AS temporary_size,
  CASE WHEN size % 6 = 5 THEN sha256_other WHEN size % 6 = 0 THEN candidate_sha256 ELSE sha256_prev END AS output_sha256,
  CASE WHEN size % 6 = 0 THEN size ELSE size * 2 END AS output_size
FROM (SELECT *, {sha}(concat(key, 'previous'){enc}) AS sha256_prev, {sha}(concat(key, 'other'){enc}) AS sha256_other FROM journal) j""",
    ),
    # companion outputs found on disk next to the library, some damaged and some foreign
    "outputs": (
        ("assets",),
        """
SELECT rel, CASE WHEN asset_id % 3 = 1 THEN size * 2 + 1 ELSE size * 2 END AS output_size,
  CASE WHEN asset_id % 8 = 5 THEN repeat('f', 64) ELSE {sha}(concat(rel, '.out'){enc}) END AS output_sha256
FROM assets WHERE asset_id % 5 <> 2""",
    ),
}

_SPARK = {
    "sha": "sha2",
    "enc": ", 256",
    "us": "unix_micros(cast(ts as timestamp))",
    "emb": "select vec_id, pos, cast(e as double) v from embeddings lateral view posexplode(embedding) as pos, e",
}
_DUCKDB = {
    "sha": "sha256",
    "enc": "",
    "us": "epoch_us(ts)",
    "emb": "select vec_id, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as v from embeddings",
}


def _render(name: str, dialect: dict[str, str]) -> str:
    text = VIEWS[name][1]
    for mark, value in dialect.items():
        text = text.replace("{" + mark + "}", value)
    return text.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needs, _ = VIEWS[name]
    text = _render(name, _SPARK)
    for need in needs:
        text = text.replace(f"FROM {need}", "FROM {" + need + "}").replace(f"from {need}", "from {" + need + "}")
    return spark.sql(text, **{n: spark_view(spark, sf_dir, n) for n in needs})


def duckdb_ctes(*names: str) -> list[str]:
    """``name AS (...)`` entries for the views and whatever they read, in order."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in seen:
            for need in VIEWS[name][0]:
                add(need)
            seen[name] = f"{name} AS ({_render(name, _DUCKDB)})"

    for name in names:
        add(name)
    return list(seen.values())
