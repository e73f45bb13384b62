"""The engine's input tables as deterministic views over the given parquet tables.

Each text runs in Spark and DuckDB alike (``pix`` has one text per engine).  Names in
braces are the tables or views it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heftmap.operators.staging import discard, fresh_path, keep, stage

TABLES = ("orders", "lineitem", "part", "events", "documents", "embeddings")

INV = """
WITH o AS (
  SELECT o_orderkey AS k, o_orderkey % 40 AS kind, CAST(floor(o_orderkey / 40) AS BIGINT) AS j,
         o_custkey % 5 AS root_id, CAST(floor(o_totalprice) AS BIGINT) AS b
  FROM {orders}
), base AS (
  SELECT root_id, k, kind, j,
    CASE kind
      WHEN 0  THEN concat('Game/Content/Paks/pakchunk', k % 11, '-Windows', k, '.pak')
      WHEN 1  THEN concat('Game/Saved/Patch/pakchunk', k % 11, '-Windows', k, '_P.pak')
      WHEN 2  THEN concat('Launcher/downloads/3.', j % 3, '.', j % 12, '/m', k, '.json')
      WHEN 3  THEN concat('Game/Saved/Video/Paks/', k, '_0/Video_', k, '_0.pak')
      WHEN 4  THEN concat('Game/Binaries/Win64/g', k, '.pdb')
      WHEN 5  THEN concat('Game/Intermediate/x', k, '.obj')
      WHEN 6  THEN concat('Launcher/app/', CASE j % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'pt-BR' WHEN 2 THEN 'ja' ELSE 'fr' END, '/A', k, '.resources.dll')
      WHEN 7  THEN concat('Game/Content/ShaderArchive-', CASE j % 3 WHEN 0 THEN 'PCD3D_SM5' WHEN 1 THEN 'PCD3D_SM6' ELSE 'VulkanSM5' END, '-', k, '.ushaderbytecode')
      WHEN 8  THEN concat('Engine/Extras/Redist/UE4PrereqSetup_', k, '.exe')
      WHEN 9  THEN concat('Engine/Binaries/', CASE j % 3 WHEN 0 THEN 'Win64' WHEN 1 THEN 'Linux' ELSE 'Mac' END, '/lib', k, '.so')
      WHEN 10 THEN concat('Game/Mods/m', k, '.pak.disabled')
      WHEN 11 THEN concat('Engine/Binaries/ThirdParty/CEF3/v', k, '/locales/', CASE j % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'ko' END, '.pak')
      WHEN 12 THEN concat('Game/Content/Art/t', k, '.PNG')
      WHEN 13 THEN concat('Game/Content/Sfx/s', k, '.wav')
      WHEN 14 THEN concat('Game/Content/Sfx/s', k, '.flac')
      ELSE CASE WHEN kind < 30
        THEN concat('Game/Content/L10N/', CASE j % 5 WHEN 0 THEN 'en-us' WHEN 1 THEN 'fr' WHEN 2 THEN 'zh-hans' WHEN 3 THEN 'Audio' ELSE 'de' END, '/v', k, '.ogg')
        ELSE concat('Game/Content/Data/d', k, '.bin') END
    END AS path,
    CASE WHEN kind = 0 THEN b * 32768 WHEN kind IN (1, 9) THEN b * 1024 WHEN kind = 3 THEN b * 256
         WHEN kind >= 30 THEN 4194304 + (j % 50) * 1048576 ELSE b * 16 END AS size_bytes,
    CASE WHEN kind IN (0, 1, 3) THEN CASE j % 5 WHEN 3 THEN 'pak is encrypted but no key was provided' WHEN 4 THEN 'unsupported pak version 99' END END AS probe_error
  FROM o
)
SELECT root_id, k, path, size_bytes, probe_error,
       CASE WHEN kind >= 30 THEN concat('c', j % 50, '-', k % 2) ELSE path END AS content_key
FROM base
UNION ALL SELECT root_id, k, concat(substring(path, 1, length(path) - 3), 'sig'), CAST(256 AS BIGINT), NULL, path FROM base WHERE kind = 0 AND j % 3 = 0
UNION ALL SELECT root_id, k, concat(substring(path, 1, length(path) - 3), 'utoc'), CAST(4096 AS BIGINT), NULL, path FROM base WHERE kind = 0 AND j % 3 = 1
UNION ALL SELECT root_id, k, concat(substring(path, 1, length(path) - 3), 'ucas'), size_bytes, NULL, path FROM base WHERE kind = 0 AND j % 3 = 1
"""

ENT = """
SELECT i.root_id, i.path AS container_path, i.probe_error,
 concat('Game/Content/', CASE l_partkey % 4 WHEN 0 THEN 'L10N/fr/' WHEN 1 THEN 'L10N/en-us/' WHEN 2 THEN 'Localization/Game/de/' ELSE 'Art/' END, 'e', l_partkey, '_', l_suppkey, '_', l_linenumber,
  CASE l_suppkey % 4 WHEN 0 THEN '.uasset' WHEN 1 THEN '.ubulk' WHEN 2 THEN '.wav' ELSE '.dat' END) AS path,
 CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, l_suppkey % 4 = 0 AS is_package, l_suppkey % 4 = 1 AS is_payload
 FROM {lineitem} JOIN {inv} i ON l_orderkey = i.k WHERE i.path LIKE '%.pak' AND i.path NOT LIKE '%/CEF3/%'
"""

TEX = """
SELECT p_partkey AS tex_id, concat('Game/Content/A', CAST(floor(p_partkey / 2) AS BIGINT)) AS asset_path,
 concat('T_', p_partkey, CASE p_partkey % 6 WHEN 0 THEN '_N' WHEN 1 THEN '_lut' ELSE '_d' END) AS export_name,
 CASE p_type WHEN 'ECONOMY' THEN 'PF_DXT1' WHEN 'STANDARD' THEN 'PF_DXT5' WHEN 'PROMO' THEN 'PF_BC5' WHEN 'LARGE' THEN 'PF_BC7' WHEN 'MEDIUM' THEN 'PF_ASTC_6x6' ELSE 'PF_B8G8R8A8' END AS pixel_format,
 CAST(power(2, 6 + p_size % 7) AS INT) AS size_x, CAST(power(2, 6 + p_partkey % 7) AS INT) AS size_y, CAST(7 + p_size % 6 AS INT) AS num_mips,
 CASE p_partkey % 5 WHEN 0 THEN 'TC_Default' WHEN 1 THEN 'TC_Normalmap' WHEN 2 THEN 'TC_Masks' WHEN 3 THEN NULL ELSE 'TC_LookupTable' END AS compression_settings FROM {part}
"""

MAN = """
SELECT event_id AS seq, concat('Game/f', user_id) AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'delete' ELSE 'replace' END AS op,
 CAST(floor(value * 100) AS BIGINT) AS original_size, CASE WHEN event_type = 'signup' THEN '' ELSE concat('h', event_id) END AS original_sha256,
 CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE concat('h', event_id) END AS payload_sha256 FROM {events}
"""

BEN = """
SELECT concat(CASE p_partkey % 4 WHEN 0 THEN 'Wood' WHEN 1 THEN 'Rust' WHEN 2 THEN 'Tile' ELSE 'Metal' END, p_partkey, '_', CASE p_size % 4 WHEN 0 THEN 'Color' WHEN 1 THEN 'NormalGL' WHEN 2 THEN 'Roughness' ELSE 'Metalness' END) AS label,
 s.predictor, CAST((p_partkey * s.mult) % 1200 AS DOUBLE) / 1000 AS ratio, CAST(p_size AS DOUBLE) AS hp_energy, CAST(1048576 AS BIGINT) AS baseline_bytes, p_partkey % 50 <> 0 AS lossless
 FROM {part} CROSS JOIN (SELECT 'bilinear' AS predictor, 7919 AS mult UNION ALL SELECT 'learned', 104729) s WHERE NOT (s.predictor = 'learned' AND p_partkey % 10 = 3)
"""

STRIPS = """
SELECT m.seq, m.path, m.original_size, t.asset_path, t.export_name, greatest(t.size_x, t.size_y) AS original_top_dim,
 least(greatest(t.size_x, t.size_y), 512) AS stripped_top_dim, CAST(t.tex_id % 3 AS INT) AS drop_mip_count, CAST(t.num_mips - t.tex_id % 3 AS INT) AS kept_mip_count,
 t.pixel_format, t.compression_settings, CAST(t.size_x AS BIGINT) * t.size_y AS saved_bytes
 FROM {man} m JOIN {tex} t ON m.seq = t.tex_id WHERE m.op = 'replace'
"""

PIX_SPARK = """
SELECT vec_id AS image_id, pos % 8 AS x, CAST(floor(pos / 8) AS INT) AS y, CAST(least(255, greatest(0, floor(128 + 256 * CAST(e AS DOUBLE)))) AS INT) AS v FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, e
"""

PIX_DUCK = """
SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INT) AS x, CAST(floor((i - 1) / 8) AS INT) AS y, CAST(least(255, greatest(0, floor(128 + 256 * CAST(embedding[i] AS DOUBLE)))) AS INT) AS v FROM {embeddings}, range(1, 65) r(i)
"""

NEAR = """
SELECT image_id, x, y, v FROM {pix} UNION ALL
SELECT image_id + 1000000, x, y, CASE WHEN y * 8 + x IN (image_id % 64, (image_id * 7 + 3) % 64) THEN 255 - v ELSE v END FROM {pix} WHERE image_id % 5 = 0
"""

# Engine-shaped views over the fixtures.
FILES = """
SELECT root_id, path, false AS is_dir, size_bytes, {sha}(content_key{sha_bits}) AS content_sha256, probe_error FROM {inv}
"""
# The inventory after language files of French and German are gone and sounds are re-encoded.
AFTER = """
SELECT root_id, path, is_dir,
  CASE WHEN path LIKE '%.wav' THEN CAST(floor(size_bytes / 4) AS BIGINT) WHEN path LIKE '%.flac' THEN size_bytes + 16 ELSE size_bytes END AS size_bytes,
  content_sha256, probe_error
FROM {files} WHERE NOT (path LIKE '%/L10N/fr/%' OR path LIKE '%/L10N/de/%')
UNION ALL SELECT root_id, concat(path, '.bak'), is_dir, size_bytes, content_sha256, probe_error FROM {files} WHERE path LIKE '%.PNG'
"""
# With folder rows, some of them empty, and files of unknown size.
TREE = """
SELECT root_id, path, is_dir, CASE WHEN path LIKE '%.obj' THEN NULL ELSE size_bytes END AS size_bytes, content_sha256, probe_error FROM {files}
UNION ALL SELECT root_id, concat('Launcher/downloads/9.', CAST(size_bytes % 3 AS INT), '.', CAST(size_bytes % 4 AS INT)), true, CAST(NULL AS BIGINT), NULL, NULL FROM {files} WHERE path LIKE '%.json'
  GROUP BY root_id, size_bytes % 3, size_bytes % 4
UNION ALL SELECT root_id, concat('Game/Saved/Empty/', regexp_replace(path, '^.*/', ''), '/logs'), true, CAST(NULL AS BIGINT), NULL, NULL FROM {files} WHERE path LIKE '%.exe'
UNION ALL SELECT root_id, 'readme.txt', false, CAST(12 AS BIGINT), NULL, NULL FROM {files} GROUP BY root_id
"""
# A later inventory in which every kind of group has lost, gained or resized members, a root is gone and another is new.
MOVED = """
SELECT root_id, path, is_dir, CASE WHEN path LIKE '%_P.pak' AND size_bytes % 3 = 0 THEN size_bytes * 4 WHEN path LIKE '%.pdb' AND size_bytes % 5 = 0 THEN NULL ELSE size_bytes END AS size_bytes,
  content_sha256, CASE WHEN path LIKE '%.pak' AND size_bytes % 7 = 0 THEN NULL ELSE probe_error END AS probe_error
FROM {files} WHERE NOT (path LIKE '%.sig' AND root_id = 1) AND NOT (path LIKE '%/Win64/%' AND size_bytes % 2 = 0) AND NOT path LIKE '%/downloads/3.2.%'
  AND NOT (path LIKE '%.bin' AND size_bytes % 11 = 0) AND root_id <> 4
UNION ALL SELECT root_id + 10, path, is_dir, size_bytes, content_sha256, probe_error FROM {files} WHERE root_id = 2
UNION ALL SELECT root_id, concat('Launcher/downloads/4.', CAST(size_bytes % 9 AS INT), '/', replace(path, '/', '_')), is_dir, size_bytes, content_sha256, NULL FROM {files} WHERE path LIKE '%.json'
UNION ALL SELECT root_id, path, is_dir, size_bytes, content_sha256, probe_error FROM {files} WHERE path LIKE '%.ushaderbytecode'
"""
PIXELS = "SELECT image_id, CAST(x AS INT) AS x, y, v AS r, v AS g, v AS b FROM {pix}"
NEAR_PIXELS = "SELECT image_id, CAST(x AS INT) AS x, y, v AS r, v AS g, v AS b FROM {near}"

# Images of many sizes, up to 83 x 79, with three different channels.
_LEVEL = "CAST(least(255, greatest(0, floor(128 + 256 * CAST({at} AS DOUBLE)))) AS INT) AS {c}"
_CHANNELS = {"r": "x + 3 * y", "g": "5 * x + y + 7", "b": "x * y + 2 * x"}
RAS_SPARK = f"""
SELECT vec_id AS image_id, x, y, {", ".join(_LEVEL.format(at=f"embedding[({i}) % 64]", c=c) for c, i in _CHANNELS.items())}
FROM {{embeddings}} LATERAL VIEW explode(sequence(0, CAST(vec_id % 83 AS INT))) a AS x LATERAL VIEW explode(sequence(0, CAST((vec_id * 7) % 79 AS INT))) b AS y
"""
RAS_DUCK = f"""
SELECT vec_id AS image_id, x, y, {", ".join(_LEVEL.format(at=f"embedding[CAST(({i}) % 64 AS INT) + 1]", c=c) for c, i in _CHANNELS.items())}
FROM (SELECT vec_id, embedding, x, CAST(unnest(range(0, 1 + (vec_id * 7) % 79)) AS INT) AS y
  FROM (SELECT vec_id, embedding, CAST(unnest(range(0, 1 + vec_id % 83)) AS INT) AS x FROM {{embeddings}}))
"""

# View -> (text for Spark, text for DuckDB), in dependency order.
_VIEWS = {
    "inv": (INV, INV), "ent": (ENT, ENT), "tex": (TEX, TEX), "man": (MAN, MAN), "ben": (BEN, BEN),
    "strips": (STRIPS, STRIPS), "pix": (PIX_SPARK, PIX_DUCK), "near": (NEAR, NEAR),
    "files": (FILES, FILES), "after_files": (AFTER, AFTER), "moved_files": (MOVED, MOVED), "tree": (TREE, TREE), "pixels": (PIXELS, PIXELS),
    "near_pixels": (NEAR_PIXELS, NEAR_PIXELS), "ras": (RAS_SPARK, RAS_DUCK),
}
_SHA_SPARK = {"sha": "sha2", "sha_bits": ", 256"}
_SHA_DUCK = {"sha": "sha256", "sha_bits": ""}


def _needs(text: str) -> list[str]:
    return [n for n in (*TABLES, *_VIEWS) if "{" + n + "}" in text]


# Views that stand for stored tables of an installation; derived once per session and kept
# as Parquet in the shared folder, so queries scan columns instead of re-deriving them.
_STORED = ("files", "tree", "ent")
# Pixels are derived where they are read: written, they would be ten times the table they come from.
_DEALT = (*_STORED, "ras")
_stored: dict[tuple[str, str, str], DataFrame] = {}


def _in_parallel(df: DataFrame) -> DataFrame:
    """Tables of fewer files than cores are dealt out before anything is derived from them, or one task would do that and all later scans."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of the derived views, as a DataFrame."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _stored:
        return _stored[key]
    text = _VIEWS[name][0]
    deal = _in_parallel if name in _DEALT else (lambda df: df)
    frames = {n: deal(view(spark, sf_dir, n)) for n in _needs(text)}
    for token, value in _SHA_SPARK.items():
        text = text.replace("{" + token + "}", value)
    derived = spark.sql(text, **frames)
    if name in _STORED:
        derived = _stored[key] = keep(stage(derived, name))
    return derived


def folder_tree(textures: DataFrame) -> str:
    """A folder in the shared place with three trees of sparse files, one per texture, made inside tasks; returns its path."""
    base = fresh_path(textures.sparkSession, "trees").removeprefix("file://")

    def make(parts):
        import os

        for part in parts:
            for tex_id, asset_path, export_name, size in part.itertuples(index=False):
                folder = f"{base}/{tex_id % 3}/{asset_path}" + ("/.cache" if tex_id % 7 == 0 else "")
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{'_' if tex_id % 5 == 0 else ''}{export_name}.bin", "wb") as file:
                    file.truncate(size)
                os.makedirs(f"{base}/{tex_id % 3}/Saved/empty{tex_id % 4}", exist_ok=True)
            yield part[["tex_id"]]

    textures.selectExpr("tex_id", "asset_path", "export_name", "size_x * num_mips AS size").repartition(4).mapInPandas(make, "tex_id long").count()
    return base


def one_text_file(lines: DataFrame, order: str) -> str:
    """A folder in the shared place with one file of the column ``line`` in the given order; returns its path.

    Many tasks sort and write a range each; one task then appends these, so none sorts or holds the whole.
    """
    spark = lines.sparkSession
    parts, folder = fresh_path(spark, "text-parts"), fresh_path(spark, "one-text")
    lines.orderBy(order).select("line").write.text(parts)
    source, target = parts.removeprefix("file://"), folder.removeprefix("file://")

    def append(batches):
        import os
        import shutil

        for batch in batches:
            if len(batch):
                os.makedirs(target, exist_ok=True)
                with open(f"{target}/whole.txt", "wb") as out:
                    for name in sorted(n for n in os.listdir(source) if n.startswith("part-")):
                        with open(f"{source}/{name}", "rb") as part:
                            shutil.copyfileobj(part, out, 1 << 20)
            yield batch

    spark.range(1).coalesce(1).mapInPandas(append, "id long").count()
    discard(spark, parts)
    return folder


def duck_views(*names: str) -> str:
    """``WITH`` list that defines the named views and all they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in _VIEWS and name not in order:
            for inner in _needs(_VIEWS[name][1]):
                visit(inner)
            order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        text = _VIEWS[name][1]
        for token, value in _SHA_DUCK.items():
            text = text.replace("{" + token + "}", value)
        for n in _needs(text):
            text = text.replace("{" + n + "}", n)
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH " + ",\n".join(parts)
