"""Every query of the engine by name, with the SQL that gives the same rows.

The canonical raster of the tests is `px`: one row of 64 samples in 0..255 for
each row of the embeddings table.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tags, text
from .operators import components, index, raster

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The raster in SQL; every oracle over pixels begins with it.
PX = "WITH px AS (SELECT CAST(vec_id AS BIGINT) AS y, r.x AS x, CAST(floor(abs(CAST(embedding[r.x + 1] AS DOUBLE)) * 255) AS BIGINT) % 256 AS u FROM embeddings, range(64) r(x))"
WIDTH = 64


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.from_vectors(table(spark, sf_dir, "embeddings"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster with gaps: y, x, u from order lines; of samples set twice the largest counts."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4096).alias("y"), F.col("l_linenumber").cast("bigint").alias("x"), F.col("l_quantity").cast("bigint").alias("u"))
    return rows.groupBy("y", "x").agg(F.max("u").alias("u"))


@query(PX + " SELECT x % 4 AS c, CAST(sum(u) AS BIGINT) AS total, count(*) AS samples FROM px GROUP BY 1")
def channel_mean(spark, sf_dir):
    return raster.channel_totals(raster.with_channel(pixels(spark, sf_dir), 4))


@query(PX + " SELECT y - 10 AS y, x - 5 AS x, u FROM px WHERE y >= 10 AND y < 90 AND x >= 5 AND x < 45")
def region_read(spark, sf_dir):
    return raster.region(pixels(spark, sf_dir), 5, 10, 40, 80)


@query(PX + " SELECT g.y, g.x, coalesce(u, 7) AS u FROM (SELECT a.v AS y, b.v AS x FROM range(40) a(v), range(90) b(v)) g LEFT JOIN px ON px.y = g.y - 10 AND px.x = g.x - 15")
def region_read_outside_filled(spark, sf_dir):
    return raster.region_filled(pixels(spark, sf_dir), -15, -10, 90, 40, filler=7)


@query(PX + " SELECT (y // 16) * 4 + x // 16 AS linear, count(*) AS samples, CAST(sum(u) AS BIGINT) AS total, min(u) AS low, max(u) AS high FROM px GROUP BY 1")
def tile_index(spark, sf_dir):
    t = raster.tile_index(pixels(spark, sf_dir), 16, 16, 4)
    return t.groupBy("linear").agg(F.count("*").alias("samples"), F.sum("u").alias("total"), F.min("u").alias("low"), F.max("u").alias("high"))


GRIDS = "(SELECT p_partkey, 200 + p_partkey * 7 % 500 AS width, 100 + p_partkey * 13 % 400 AS height, (499 + p_partkey * 7 % 500) // 300 AS gw, (299 + p_partkey * 13 % 400) // 200 AS gh FROM part)"


def grids(spark, sf_dir) -> DataFrame:
    """Tiles of 300 x 200 of images of two planes whose sizes come from a table."""
    p = F.col("p_partkey")
    return raster.tile_grids(table(spark, sf_dir, "part").select("p_partkey", (200 + p * 7 % 500).alias("width"), (100 + p * 13 % 400).alias("height")), 300, 200, planes=2, crop=True)


@query("SELECT p_partkey, v AS linear, v // (gw * gh) AS plane, v % (gw * gh) // gw AS ty, v % gw AS tx, v % gw * 300 AS from_x, v % (gw * gh) // gw * 200 AS from_y, least(300, width - v % gw * 300) AS w, least(200, height - v % (gw * gh) // gw * 200) AS h FROM " + GRIDS + " g, range(18) r(v) WHERE v < 2 * gw * gh")
def tile_grid(spark, sf_dir):
    return grids(spark, sf_dir).select("p_partkey", "linear", "plane", "ty", "tx", "from_x", "from_y", "w", "h")


@query("SELECT p_partkey, v AS linear, v AS again FROM " + GRIDS + " g, range(18) r(v) WHERE v < 2 * gw * gh")
def tile_linear_roundtrip(spark, sf_dir):
    """Numbers of tiles from their coordinates, which came from the numbers."""
    g = grids(spark, sf_dir)
    again = raster.linear_number(F.col("plane"), F.col("ty"), F.col("tx"), F.ceil(F.col("width") / 300), F.ceil(F.col("height") / 200))
    return g.select("p_partkey", "linear", again.alias("again"))


SPARSE = "WITH s AS (SELECT l_orderkey % 4096 AS y, CAST(l_linenumber AS BIGINT) AS x, max(CAST(l_quantity AS BIGINT)) AS u FROM lineitem GROUP BY 1, 2)"


@query(SPARSE + ", t AS (SELECT (y // 4) * 4 + x // 2 AS linear, count(*) AS n FROM s GROUP BY 1) SELECT linear, n AS set_area FROM t WHERE n = 8")
def tile_completed(spark, sf_dir):
    return raster.tile_coverage(sparse(spark, sf_dir), 2, 4, 4).where("completed").select("linear", "set_area")


@query(SPARSE + " SELECT (y // 4) * 4 + x // 2 AS linear, count(*) AS set_area, 8 - count(*) AS unset_area FROM s GROUP BY 1 HAVING count(*) < 8")
def tile_unset_area(spark, sf_dir):
    return raster.tile_coverage(sparse(spark, sf_dir), 2, 4, 4).where("not completed").select("linear", "set_area", "unset_area")


@query(SPARSE + " SELECT g.linear, coalesce(t.total, 0) AS total, t.linear IS NULL AS missing FROM (SELECT v AS linear FROM range(4096) r(v)) g LEFT JOIN (SELECT (y // 4) * 4 + x // 2 AS linear, CAST(sum(u) AS BIGINT) AS total FROM s GROUP BY 1) t USING (linear)")
def missing_tile_fill(spark, sf_dir):
    stored = raster.tile_index(sparse(spark, sf_dir), 2, 4, 4).groupBy("linear").agg(F.sum("u").alias("total"))
    grid = raster.tile_grid(spark, 8, 4096, 2, 4).select("linear")
    return grid.join(stored.withColumn("_has", F.lit(True)), "linear", "left").select("linear", F.coalesce("total", F.lit(0)).alias("total"), F.col("_has").isNull().alias("missing"))


@query("SELECT CAST(max(l_linenumber) + 1 AS BIGINT) AS width, max(l_orderkey % 4096) + 1 AS height FROM lineitem")
def map_dimensions(spark, sf_dir):
    return sparse(spark, sf_dir).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


@query(PX + ", p AS (SELECT y, x, u, coalesce(lag(u, 3) OVER (PARTITION BY y ORDER BY x), 0) AS b FROM px) SELECT y, x, ((u - b) % 256 + 256) % 256 AS delta FROM p")
def predictor_encode(spark, sf_dir):
    return raster.predictor_encode(pixels(spark, sf_dir), stride=3).select("y", "x", "delta")


@query(PX + " SELECT y, x, u AS restored FROM px")
def predictor_roundtrip(spark, sf_dir):
    return raster.predictor_decode(raster.predictor_encode(pixels(spark, sf_dir), stride=3), stride=3).select("y", "x", "restored")


LINKS = "WITH t AS (SELECT l_partkey AS off, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS n, l_orderkey * 8 + l_linenumber AS k, CAST(l_quantity AS BIGINT) AS bytes FROM (SELECT DISTINCT ON (l_orderkey * 8 + l_linenumber) * FROM lineitem ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_quantity))"


def links_table(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.struct(F.col("l_partkey").alias("off"), F.col("l_quantity").alias("q")).alias("s"))
    return t.groupBy("k").agg(F.min("s").alias("s")).select("k", "s.off", F.col("s.q").cast("bigint").alias("bytes"))


@query(LINKS + " SELECT k, off, coalesce(lag(k) OVER w, -1) AS previous_same, coalesce(lead(k) OVER w, -1) AS next_same, lag(k) OVER w IS NOT NULL AS duplicate FROM t WINDOW w AS (PARTITION BY off ORDER BY k)")
def duplicate_links(spark, sf_dir):
    return index.duplicate_links(links_table(spark, sf_dir), [], "off", "k").select("k", "off", "previous_same", "next_same", "duplicate")


@query(LINKS + ", o AS (SELECT off, max(bytes) AS n FROM t GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS data_bytes, count(*) AS stored_tiles FROM o")
def dedup_data_size(spark, sf_dir):
    return index.data_size(links_table(spark, sf_dir), [], "off", "bytes")


@query("SELECT o_custkey AS path, o_orderkey AS off, coalesce(lead(o_orderkey) OVER w, 0) AS next_offset, lead(o_orderkey) OVER w IS NULL AS last_in_chain FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def next_ifd_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("off"))
    return index.chain(o, ["path"], "off", "off").select("path", "off", "next_offset", "last_in_chain")


SIZED = "(SELECT o_custkey AS path, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS byte_count FROM orders)"


def sized(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("k"), (F.floor("o_totalprice").cast("bigint") % 5000).alias("byte_count"))


@query("SELECT path, k, byte_count, CAST(8 + coalesce(sum(byte_count + byte_count % 2) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM " + SIZED)
def offset_allocation(spark, sf_dir):
    return index.allocate(sized(spark, sf_dir), ["path"], 8)


@query("SELECT path, k, coalesce(k * 10000 - lag(k * 10000 + byte_count) OVER (PARTITION BY path ORDER BY k), 0) AS gap FROM " + SIZED)
def alignment_gaps(spark, sf_dir):
    t = sized(spark, sf_dir).withColumn("value_offset", F.col("k") * 10000)
    return index.alignment_gaps(t, ["path"], "value_offset", "byte_count").select("path", "k", "gap")


@query("SELECT path, CAST(sum(byte_count) + 8 AS BIGINT) AS used, max(path * 1000) AS length, greatest(max(path * 1000) - CAST(sum(byte_count) + 8 AS BIGINT), 0) AS lost, greatest(CAST(sum(byte_count) + 8 AS BIGINT) - max(path * 1000), 0) AS extra FROM " + SIZED + " GROUP BY 1")
def file_accounting(spark, sf_dir):
    return index.accounting(sized(spark, sf_dir).withColumn("length", F.col("path") * 1000), ["path"], "length", "byte_count")


@query("SELECT p_brand, min(p_size) = max(p_size) AS equal, CASE WHEN min(p_size) = max(p_size) THEN min(p_size) ELSE -1 END AS common FROM part GROUP BY 1")
def equal_bit_depth(spark, sf_dir):
    return index.all_equal(table(spark, sf_dir, "part"), ["p_brand"], "p_size").withColumn("common", F.coalesce("common", F.lit(-1)))


@query(PX + " SELECT x % 4 AS c, max(u) AS high FROM px GROUP BY 1")
def max_sample(spark, sf_dir):
    return raster.channel_maxima(raster.with_channel(pixels(spark, sf_dir), 4))


@query(PX + ", m AS (SELECT (max(y) + 1) // 4 * 4 AS h FROM px) SELECT y // 4 AS y, x // 4 AS x, CAST(sum(u) AS BIGINT) AS total, count(*) AS samples FROM px, m WHERE y < h GROUP BY 1, 2")
def pyramid_downscale_avg(spark, sf_dir):
    px = pixels(spark, sf_dir)
    height = table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0] or 0
    return raster.downscale(px, WIDTH, height, 4)


DIMS = "(SELECT o_orderkey AS k, 1000 + o_custkey * 37 AS w, 700 + o_custkey * 53 AS h, (1000 + o_custkey * 37) // (2 + o_orderkey % 7) + o_orderkey % 3 AS nw, (700 + o_custkey * 53) // (2 + o_orderkey % 7) AS nh FROM orders)"


def dims(spark, sf_dir) -> DataFrame:
    """Sizes of layers and of the ones after them."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 37 + 1000).alias("w"), (F.col("o_custkey") * 53 + 700).alias("h"))
    return d.withColumns({"nw": F.expr("w div (2 + k % 7) + k % 3"), "nh": F.expr("h div (2 + k % 7)")})


@query("SELECT k, coalesce(min(r), -1) AS ratio FROM " + DIMS + " d LEFT JOIN (SELECT CAST(v AS INTEGER) AS r FROM range(2, 33) t(v)) q ON (nw = w // r OR nw = w // r + 1) AND (nh = h // r OR nh = h // r + 1) GROUP BY 1")
def find_ratio(spark, sf_dir):
    return dims(spark, sf_dir).select("k", index.find_ratio(F.col("w"), F.col("h"), F.col("nw"), F.col("nh")).alias("ratio"))


@query("WITH n AS (SELECT o_custkey AS slide, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS layer FROM orders), l AS (SELECT slide, layer, (4096 >> CAST(layer AS INTEGER)) + CASE WHEN o_orderkey % 11 = 10 THEN 5 ELSE 0 END AS w, (2048 >> CAST(layer AS INTEGER)) AS h FROM n WHERE layer < 8), o AS (SELECT *, lag(w) OVER q AS pw, lag(h) OVER q AS ph FROM l WINDOW q AS (PARTITION BY slide ORDER BY layer)) SELECT slide, layer, bool_and(coalesce((w = pw // 2 OR w = pw // 2 + 1) AND (h = ph // 2 OR h = ph // 2 + 1), true)) OVER (PARTITION BY slide ORDER BY layer) AS in_pyramid FROM o")
def layer_chain(spark, sf_dir):
    """A customer's orders as layers of a slide; in some the width is off."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slide"), "o_orderkey", n.cast("bigint").alias("layer")).where("layer < 8")
    sized = o.withColumns({"w": F.expr("shiftright(4096, cast(layer as int)) + if(o_orderkey % 11 = 10, 5, 0)"), "h": F.expr("shiftright(2048, cast(layer as int))")})
    return index.layer_chain(sized, ["slide"]).select("slide", "layer", "in_pyramid")


@query(PX + " SELECT y, x * 2 + s.v AS x, CASE WHEN s.v = 0 THEN u // 16 ELSE u % 16 END AS u FROM px, range(2) s(v)")
def bit_unpack_4(spark, sf_dir):
    return raster.unpack_bytes(pixels(spark, sf_dir), 4)


@query(PX + " SELECT y, x, (u // 16) * 17 AS u FROM px")
def rescale_depth(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", "x", raster.rescale(F.expr("u div 16"), 4, 8).alias("u"))


@query(PX + " SELECT y, x, 255 - u AS u FROM px")
def invert_brightness(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", "x", raster.invert(F.col("u"), 8).alias("u"))


@query(PX + " SELECT y, x, CASE WHEN u >= 128 THEN 255 ELSE 0 END AS u FROM px")
def bits_to_bytes(spark, sf_dir):
    bits = pixels(spark, sf_dir).select("y", "x", (F.col("u") >= 128).cast("bigint").alias("bit"))
    return bits.select("y", "x", raster.bit_to_byte(F.col("bit")).alias("u"))


@query(PX + " SELECT y, x, CAST(greatest(0, least(255, floor(u * 1.5 - 20 + 0.5))) AS BIGINT) AS u FROM px")
def contrast_linear(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", "x", raster.contrast(F.col("u"), 1.5, -20.0, 255).alias("u"))


TRIPLE = PX + ", t AS (SELECT y, x // 3 AS x, max(CASE WHEN x % 3 = 0 THEN u END) AS a, max(CASE WHEN x % 3 = 1 THEN u END) AS b, max(CASE WHEN x % 3 = 2 THEN u END) AS c FROM px WHERE x < 63 GROUP BY 1, 2)"


def triples(spark, sf_dir) -> DataFrame:
    px = pixels(spark, sf_dir).where("x < 63").groupBy("y", F.expr("x div 3").alias("x"))
    return px.agg(*[F.max(F.when(F.col("x") % 3 == i, F.col("u"))).alias(n) for i, n in enumerate("abc")])


CLAMP = "CAST(greatest(0, least(255, floor({} + 0.5))) AS BIGINT)"


@query(TRIPLE + " SELECT y, x, " + ", ".join(f"{CLAMP.format(e)} AS {n}" for n, e in (("r", "CAST(a AS DOUBLE) + CAST(1.402 AS DOUBLE) * (c - 128)"), ("g", "CAST(a AS DOUBLE) - CAST(0.34414 AS DOUBLE) * (b - 128) - CAST(0.71414 AS DOUBLE) * (c - 128)"), ("b", "CAST(a AS DOUBLE) + CAST(1.772 AS DOUBLE) * (b - 128)"))) + " FROM t")
def ycbcr_to_rgb(spark, sf_dir):
    t = triples(spark, sf_dir)
    r, g, b = raster.ycbcr_to_rgb(F.col("a"), F.col("b"), F.col("c"))
    return t.select("y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


@query(TRIPLE + " SELECT y, x, CAST(CASE WHEN a = b AND b = c THEN a ELSE floor(CAST(0.299 AS DOUBLE) * a + CAST(0.587 AS DOUBLE) * b + CAST(0.114 AS DOUBLE) * c + 0.5) END AS BIGINT) AS u FROM t")
def color_to_gray(spark, sf_dir):
    return triples(spark, sf_dir).select("y", "x", raster.grey(F.col("a"), F.col("b"), F.col("c")).alias("u"))


@query(PX + " SELECT y, (x % 4) * 16 + x // 4 AS x, u FROM px")
def separate(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", raster.interleave_position(F.col("x"), 4, 16).alias("x"), "u")


@query(PX + " SELECT y, (x % 16) * 4 + x // 16 AS x, u FROM px")
def interleave(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", raster.interleave_position(F.col("x"), 16, 4).alias("x"), "u")


@query(PX + " SELECT y, x // 6 AS x, x % 6 AS c, u FROM px WHERE x % 6 < 4")
def drop_extra_channels(spark, sf_dir):
    px = raster.with_channel(pixels(spark, sf_dir), 6)
    return px.where("c < 4").select("y", F.expr("x div 6").alias("x"), "c", "u")


@query(PX + " SELECT y, x // 4 AS x, string_agg(CAST(u AS VARCHAR), ',' ORDER BY x) AS channels FROM px GROUP BY 1, 2")
def channels_to_matrix(spark, sf_dir):
    px = raster.with_channel(pixels(spark, sf_dir), 4).withColumn("x", F.expr("x div 4"))
    merged = raster.merge_channels(px)
    return merged.select("y", "x", F.array_join(F.transform("channels", lambda u: u.cast("string")), ",").alias("channels"))


@query(PX + " SELECT y, x // 4 AS x, x % 4 AS c, u FROM px")
def matrix_to_channels(spark, sf_dir):
    """Channels taken apart again."""
    px = raster.with_channel(pixels(spark, sf_dir), 4).withColumn("x", F.expr("x div 4"))
    return raster.split_channels(raster.merge_channels(px)).select("y", "x", "c", "u")


@query(PX + ", m AS (SELECT *, CASE WHEN u // 64 = lag(u // 64) OVER w THEN 0 ELSE 1 END AS f FROM px WINDOW w AS (PARTITION BY y ORDER BY x)), g AS (SELECT *, sum(f) OVER (PARTITION BY y ORDER BY x) AS run FROM m) SELECT y, u // 64 AS u, min(x) AS start, count(*) AS length FROM g GROUP BY y, run, u // 64")
def packbits_runs(spark, sf_dir):
    return raster.runs(pixels(spark, sf_dir).withColumn("u", F.expr("u div 64")))


@query(PX + " SELECT y, x, CASE WHEN x % 16 < 2 OR x % 16 >= 14 OR y % 16 < 2 OR y % 16 >= 14 THEN 200 ELSE u END AS u FROM px")
def grid_overlay(spark, sf_dir):
    return raster.overlay_grid(pixels(spark, sf_dir), 16, 16, 2, 200)


@query(PX + " SELECT y, x, CASE WHEN y >= 20 AND y < 40 AND x >= 8 AND x < 72 THEN (y + x) % 256 ELSE u END AS u FROM px UNION ALL SELECT a.v, b.v, (a.v + b.v) % 256 FROM range(20, 40) a(v), range(64, 72) b(v)")
def region_update(spark, sf_dir):
    update = spark.range(20 * 64).select(F.expr("20 + id div 64").alias("y"), F.expr("8 + id % 64").alias("x"))
    return raster.patch(pixels(spark, sf_dir), update.withColumn("u", (F.col("y") + F.col("x")) % 256))


@query("""
    WITH RECURSIVE px AS (
        SELECT CAST(vec_id AS BIGINT) AS y, CAST(i - 1 AS BIGINT) AS x, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 255) AS BIGINT) % 256 AS u FROM embeddings, range(1, 65) t(i)
    ), cell AS (
        SELECT y, x FROM px WHERE u >= 32
    ), step AS (
        SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) a, range(3) b
    ), start AS (
        -- the smallest sample of an object has no neighbour before it
        SELECT c.y, c.x FROM cell c WHERE NOT EXISTS (FROM cell n WHERE n.y = c.y AND n.x = c.x - 1) AND NOT EXISTS (FROM cell n WHERE n.y = c.y - 1 AND n.x = c.x - 1)
            AND NOT EXISTS (FROM cell n WHERE n.y = c.y - 1 AND n.x = c.x) AND NOT EXISTS (FROM cell n WHERE n.y = c.y - 1 AND n.x = c.x + 1)
    ), reach(sy, sx, y, x) AS (
        SELECT y, x, y, x FROM start
        UNION
        SELECT r.sy, r.sx, c.y, c.x FROM reach r, step s, cell c WHERE c.y = r.y + s.dy AND c.x = r.x + s.dx
    ), rooted AS (
        SELECT y, x, min(sy * 64 + sx) AS root FROM reach GROUP BY y, x
    ), sized AS (
        SELECT root, count(*) AS area, row_number() OVER (ORDER BY root) AS label FROM rooted GROUP BY root HAVING count(*) >= 2
    )
    SELECT y, x, root // 64 AS root_y, root % 64 AS root_x, area, label FROM rooted JOIN sized USING (root)
""")
def connected_components(spark, sf_dir):
    return components.connected_components(pixels(spark, sf_dir).where("u >= 32"), min_area=2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_in_chain(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def anti_out_of_bounds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("SELECT doc_id, len(p) AS pieces, p[1] AS first_piece FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:len(s) - 1] ELSE s END AS p FROM (SELECT doc_id, string_split(replace(text, '. ', chr(0)), chr(0)) AS s FROM documents))")
def ascii_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.ascii_pieces(F.replace(F.col("text"), F.lit(". "), F.lit("\0"))).alias("p"))
    return d.select("doc_id", F.size("p").cast("bigint").alias("pieces"), F.get("p", F.lit(0)).alias("first_piece"))


@query("SELECT doc_id, length(replace(replace(replace(text, '. ', chr(13) || chr(10)), ',', chr(13)), chr(13) || chr(10), chr(10))) AS n, md5(replace(replace(replace(replace(text, '. ', chr(13) || chr(10)), ',', chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def newline_normalise(spark, sf_dir):
    raw = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\r\n")), F.lit(","), F.lit("\r"))
    d = table(spark, sf_dir, "documents").select("doc_id", text.newlines(raw).alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


def slides(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.svs_text(F.col("p_name"), [("AppMag", F.col("p_size")), ("MPP", F.col("p_partkey") * 25), ("Brand", F.col("p_brand")), ("AppMag", F.col("p_size") + 1)]).alias("description"))


@query("SELECT p_partkey, 'Aperio Image' || chr(10) || p_name || '|AppMag = ' || p_size || '|MPP = ' || p_partkey * 25 || '|Brand = ' || p_brand || '|AppMag = ' || (p_size + 1) AS description FROM part")
def svs_build(spark, sf_dir):
    return slides(spark, sf_dir)


@query("SELECT p_partkey, trim(p_name) AS summary, 'MPP=' || p_partkey * 25 || ';Brand=' || p_brand || ';AppMag=' || (p_size + 1) AS attributes FROM part")
def svs_attributes(spark, sf_dir):
    s = slides(spark, sf_dir)
    pairs = F.transform(text.svs_attributes(F.col("description")), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return s.select("p_partkey", text.svs_summary(F.col("description")).alias("summary"), F.array_join(pairs, ";").alias("attributes"))


@query("SELECT p_partkey, CAST(p_partkey * 25 AS DOUBLE) AS mpp, CAST(p_size + 1 AS DOUBLE) AS magnification, CAST(NULL AS DOUBLE) AS left_mm FROM part")
def svs_pixel_size(spark, sf_dir):
    s, d = slides(spark, sf_dir), F.col("description")
    return s.select("p_partkey", text.svs_number(d, "MPP").alias("mpp"), text.svs_number(d, "AppMag").alias("magnification"), text.svs_number(d, "Left").alias("left_mm"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 12) || '...' ELSE p_name END AS shown FROM part")
def truncated_display(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.shorten(F.col("p_name"), 12).alias("shown"))


#: Codes drawn by a table's numbers, and their names as literals.
CODE_NAMES = [
    (254, "NewSubfileType"), (256, "ImageWidth"), (257, "ImageLength"), (258, "BitsPerSample"), (259, "Compression"), (262, "PhotometricInterpretation"), (266, "FillOrder"), (270, "ImageDescription"), (271, "Make"), (272, "Model"), (273, "StripOffsets"), (277, "SamplesPerPixel"), (278, "RowsPerStrip"),
    (279, "StripByteCounts"), (282, "XResolution"), (283, "YResolution"), (284, "PlanarConfiguration"), (296, "ResolutionUnit"), (305, "Software"), (306, "DateTime"), (317, "Predictor"), (322, "TileWidth"), (323, "TileLength"), (324, "TileOffsets"), (325, "TileByteCounts"), (338, "ExtraSamples"), (339, "SampleFormat"), (347, "JPEGTables"), (33432, "Copyright"), (65000, None),
]


def codes(spark, sf_dir, values: list[int]) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, values)), (F.col("l_partkey") % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), pick.alias("code"))


@query("SELECT l_orderkey * 8 + l_linenumber AS id, t.code, t.name FROM lineitem JOIN (VALUES " + ", ".join(f"({i}, {c}, {repr(n) if n else 'NULL'})" for i, (c, n) in enumerate(CODE_NAMES)) + f") t(i, code, name) ON t.i = l_partkey % {len(CODE_NAMES)}")
def tag_dim_lookup(spark, sf_dir):
    """Names of tag codes, null for one that has none."""
    return codes(spark, sf_dir, [c for c, _ in CODE_NAMES]).join(F.broadcast(tags.tag_table(spark)), "code", "left").select("id", "code", "name")


@query("WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS id, list_value(1, 2, 3, 4, 5, 6, 7, 8, 9, 32773, 32809, 32946, 34676, 34677, 34712, 34892, 34925, 34933, 50000, 50001)[l_partkey % 20 + 1] AS code FROM lineitem) SELECT id, code, code NOT IN (9, 34677, 34712, 50001) AS readable, code IN (1, 2, 3, 4, 5, 7, 8, 32773, 32946, 34925, 34933, 50000) AS writable FROM c")
def compression_support(spark, sf_dir):
    c = codes(spark, sf_dir, [1, 2, 3, 4, 5, 6, 7, 8, 9, 32773, 32809, 32946, 34676, 34677, 34712, 34892, 34925, 34933, 50000, 50001])
    return c.join(F.broadcast(tags.compression_table(spark)), "code").select("id", "code", "readable", "writable")


@query("WITH p AS (SELECT l_orderkey, l_linenumber AS tag, CASE l_linenumber WHEN 1 THEN 'One' WHEN 2 THEN 'a \\\"quoted\\\" name' ELSE 'tag' || l_linenumber END AS name, CAST(l_quantity AS BIGINT) AS v FROM lineitem), j AS (SELECT l_orderkey, tag, '\"' || name || '\":[' || v || ']' AS pair FROM p) SELECT l_orderkey, '{' || string_agg(pair, ',' ORDER BY tag, pair) || '}' AS json FROM j GROUP BY 1")
def ifd_json(spark, sf_dir):
    """An order's lines as the tags of a directory."""
    from .plans import report

    struct = "i array<bigint>, d array<double>, s array<string>, b binary, r array<struct<num:bigint,den:bigint>>"
    empty = F.from_json(F.lit("{}"), struct)
    value = F.struct(F.array(F.col("l_quantity").cast("bigint")).alias("i"), *(empty[n].alias(n) for n in "dsbr"))
    entries = table(spark, sf_dir, "lineitem").select(F.lit("orders").alias("path"), F.col("l_orderkey").alias("global_index"), F.col("l_linenumber").alias("tag"), value.alias("value"))
    names = spark.createDataFrame([(1, "One"), (2, 'a "quoted" name')], "code int, name string")
    return report.as_json(entries, names).select(F.col("global_index").alias("l_orderkey"), "json")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS DOUBLE) / (o_custkey % 5) END AS value, o_custkey % 5 = 0 AND floor(o_totalprice) > 0 AS infinite FROM orders")
def rational_value(spark, sf_dir):
    """Rationals as numbers; those over zero are infinite."""
    from .operators import tagged

    r = F.array(F.struct(F.floor("o_totalprice").alias("num"), (F.col("o_custkey") % 5).alias("den")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", tagged.ratio(F.struct(r.alias("r"))).alias("value"))
    infinite = F.col("value") == float("inf")
    return o.select("o_orderkey", F.when(~infinite, F.col("value")).alias("value"), infinite.alias("infinite"))


# Files: rasters written as TIFF and read again must be the rasters.


def _through_file(spark: SparkSession, sf_dir: str, label: str, **options) -> DataFrame:
    """The raster after a TIFF file: y, x, u."""
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    channels = options.pop("channels", 1)
    folder = tempfile.mkdtemp(prefix=f"{label}-", dir=shared_folder(spark))
    px = pixels(spark, sf_dir).select(F.lit(os.path.join(folder, "raster.tif")).alias("path"), F.lit(0).alias("image"), (F.col("x") % channels).cast("int").alias("c"), "y", F.expr(f"x div {channels}").alias("x"), F.col("u").alias("v"))
    tiff_sink.write(px, tiff_sink.Options(**options)).collect()
    back = tiff.pixels(tiff.scan(spark, folder, "tiles"))
    return back.select("y", (F.col("x") * channels + F.col("c")).alias("x"), F.col("v").cast("bigint").alias("u"))


ROUND_TRIPS = {
    "codec_none_roundtrip": dict(compression=1, tile_w=16),
    "codec_packbits_roundtrip": dict(compression=32773, tile_w=16),
    "codec_lzw_roundtrip": dict(compression=5, tile_w=16, predictor=2),
    "codec_deflate_roundtrip": dict(compression=8, tile_w=16, predictor=2),
    "codec_lzma_roundtrip": dict(compression=34925, tile_w=16),
    "codec_zstd_roundtrip": dict(compression=50000, tile_w=16),
    "codec_png_roundtrip": dict(compression=34933, tile_w=16, channels=4),
    "tiff_roundtrip_tiled": dict(tile_w=32, tile_h=32, dtype="u2", channels=4),
    "tiff_roundtrip_stripped": dict(tile_h=7, dtype="i4", compression=8, predictor=2),
    "tiff_roundtrip_planar": dict(tile_w=16, planar=True, channels=4, compression=5),
    "tiff_roundtrip_big_endian": dict(tile_w=16, little=False, dtype="u4", compression=8, predictor=2),
    "tiff_roundtrip_bigtiff": dict(tile_w=16, big=True, dtype="f4", compression=50000),
}


def _round_trip(name: str, options: dict) -> None:
    def run(spark, sf_dir):
        return _through_file(spark, sf_dir, name, **options)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = PX + " SELECT y, x, u FROM px"


for _name, _options in ROUND_TRIPS.items():
    _round_trip(_name, _options)


# Files that are edited: written with two images, changed, and read again.

#: Image 1 is image 0 upside down in value.
TWO = PX + ", two AS (SELECT 0 AS image, y, x, u FROM px UNION ALL SELECT 1, y, x, 255 - u FROM px)"


def _edited(spark: SparkSession, sf_dir: str, label: str, change=None, **options) -> DataFrame:
    """The images of a file after `change(path, folder)`, which returns the path to read: image, y, x, u."""
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    folder = tempfile.mkdtemp(prefix=f"{label}-", dir=shared_folder(spark))
    path = os.path.join(folder, "raster.tif")
    px = pixels(spark, sf_dir).select(F.lit(path).alias("path"), F.lit(0).alias("c"), "y", "x", F.explode(F.array(F.struct(F.lit(0).alias("image"), F.col("u").alias("v")), F.struct(F.lit(1).alias("image"), (255 - F.col("u")).alias("v")))).alias("i"))
    tiff_sink.write(px.select("path", "i.image", "c", "y", "x", "i.v"), tiff_sink.Options(**{"tile_w": 16, "compression": 8, **options})).collect()
    back = tiff.pixels(tiff.scan(spark, change(path, folder) if change else path, "tiles"))
    return back.select(F.col("global_index").alias("image"), "y", "x", F.col("v").cast("bigint").alias("u"))


@query(TWO + " SELECT image, y, x, u FROM two")
def tiff_two_images(spark, sf_dir):
    return _edited(spark, sf_dir, "two-images")


@query(TWO + " SELECT image, y, x, u FROM two")
def tiff_copy_range(spark, sf_dir):
    def change(path, folder):
        from .sources import tiff_sink

        tiff_sink.copy_images(path, f"{folder}/copy.tif", [1])
        tiff_sink.copy_images(path, f"{folder}/whole.tif", [0])
        tiff_sink.copy_images(f"{folder}/copy.tif", f"{folder}/whole.tif", append=True)
        return f"{folder}/whole.tif"

    return _edited(spark, sf_dir, "copy-range", change)


@query(TWO + " SELECT image, y - 5 AS y, x - 7 AS x, u FROM two WHERE y >= 5 AND y < 45 AND x >= 7 AND x < 57")
def tiff_crop(spark, sf_dir):
    def change(path, folder):
        from .sources import tiff_sink

        tiff_sink.copy_images(path, f"{folder}/crop.tif", crop=(7, 5, 50, 40))
        return f"{folder}/crop.tif"

    return _edited(spark, sf_dir, "crop", change)


@query(TWO + " SELECT image, y, x, u FROM two")
def tiff_repack(spark, sf_dir):
    def change(path, folder):
        from .sources import tiff_sink

        tiff_sink.copy_images(path, f"{folder}/lzw.tif", compression=5)
        return f"{folder}/lzw.tif"

    return _edited(spark, sf_dir, "repack", change, predictor=2, dtype="u2", little=False)


@query(TWO + " SELECT 0 AS image, y, x, u FROM two WHERE image = 1")
def tiff_delete_image(spark, sf_dir):
    def change(path, folder):
        from .sources import tiff_sink

        tiff_sink.delete_ifd(path, 0)
        tiff_sink.compact(path)
        return path

    return _edited(spark, sf_dir, "delete", change)


@query(PX + " SELECT i AS main_index, text AS description, (SELECT max(x) + 1 FROM px) AS width, (SELECT max(y) + 1 FROM px) AS height FROM (VALUES (0, 'first'), (1, 'a second description')) t(i, text)")
def tiff_update_description(spark, sf_dir):
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    folder = tempfile.mkdtemp(prefix="describe-", dir=shared_folder(spark))
    path = os.path.join(folder, "raster.tif")
    px = pixels(spark, sf_dir).select(F.lit(path).alias("path"), F.explode(F.array(F.lit(0), F.lit(1))).alias("image"), F.lit(0).alias("c"), "y", "x", F.col("u").alias("v"))
    tiff_sink.write(px, tiff_sink.Options(tile_h=32)).collect()
    for i, texts in enumerate((("a longer text at first", "first"), ("short", "a second description"))):
        for t in texts:
            tiff_sink.update_description(path, i, t)
    return tiff.scan(spark, path, "ifds").select("main_index", "description", "width", "height")


@query(TWO + " SELECT image, y, x, CASE WHEN u >= 128 THEN 1 ELSE 0 END AS u FROM two")
def tiff_one_bit(spark, sf_dir):
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    folder = tempfile.mkdtemp(prefix="one-bit-", dir=shared_folder(spark))
    path = os.path.join(folder, "raster.tif")
    values = F.array(F.struct(F.lit(0).alias("image"), (F.col("u") >= 128).cast("int").alias("v")), F.struct(F.lit(1).alias("image"), (255 - F.col("u") >= 128).cast("int").alias("v")))
    px = pixels(spark, sf_dir).select(F.lit(path).alias("path"), F.lit(0).alias("c"), "y", "x", F.explode(values).alias("i"))
    tiff_sink.write(px.select("path", "i.image", "c", "y", "x", "i.v"), tiff_sink.Options(one_bit=True, compression=32773)).collect()
    return tiff.pixels(tiff.scan(spark, path, "tiles")).select(F.col("global_index").alias("image"), "y", "x", F.col("v").cast("bigint").alias("u"))


@query(PX + " SELECT y, x, u FROM px WHERE y BETWEEN 16 AND 47 AND x BETWEEN 16 AND 31")
def tiff_region(spark, sf_dir):
    """Only tiles that meet the rectangle are read."""
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    folder = tempfile.mkdtemp(prefix="region-", dir=shared_folder(spark))
    path = os.path.join(folder, "raster.tif")
    px = pixels(spark, sf_dir).select(F.lit(path).alias("path"), F.lit(0).alias("image"), F.lit(0).alias("c"), "y", "x", F.col("u").alias("v"))
    tiff_sink.write(px, tiff_sink.Options(tile_w=16, tile_h=16, compression=34925)).collect()
    inside = tiff.region(spark, path, 16, 16, 16, 32)
    return inside.select((F.col("y") + 16).alias("y"), (F.col("x") + 16).alias("x"), F.col("v").cast("bigint").alias("u"))


@query(PX + ", two AS (SELECT 0 AS image, y, x, u FROM px UNION ALL SELECT 1, y, x, 255 - u FROM px), r AS (SELECT a.range AS y, b.range AS x FROM range(30) a, range(80) b) "
       "SELECT 1 AS image, r.y, r.x, coalesce(u, 7) AS u FROM r LEFT JOIN two ON two.image = 1 AND two.y = r.y + 37 AND two.x = r.x - 9")
def tiff_region_filled(spark, sf_dir):
    """A rectangle that crosses tiles and the edge of the second of two images; the other image's tiles are not listed."""
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    folder = tempfile.mkdtemp(prefix="region-", dir=shared_folder(spark))
    path = os.path.join(folder, "raster.tif")
    values = F.array(F.struct(F.lit(0).alias("image"), F.col("u").alias("v")), F.struct(F.lit(1).alias("image"), (255 - F.col("u")).alias("v")))
    px = pixels(spark, sf_dir).select(F.lit(path).alias("path"), F.lit(0).alias("c"), "y", "x", F.explode(values).alias("i"))
    tiff_sink.write(px.select("path", "i.image", "c", "y", "x", "i.v"), tiff_sink.Options(tile_w=16, tile_h=16, compression=5))
    inside = tiff.region(spark, path, -9, 37, 80, 30, filler=7).where("global_index = 1")
    return inside.select(F.col("global_index").alias("image"), "y", "x", F.col("v").cast("bigint").alias("u"))


@query(PX + " SELECT y, x, CASE WHEN y BETWEEN 5 AND 44 AND x BETWEEN 7 AND 40 THEN 255 - u ELSE u END AS u FROM px")
def tiff_region_update(spark, sf_dir):
    """A rectangle changed inside a file: tiles that it covers are replaced, those that it crosses painted over."""
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink, tiff_update

    folder = tempfile.mkdtemp(prefix="update-", dir=shared_folder(spark))
    path = os.path.join(folder, "raster.tif")
    px = pixels(spark, sf_dir)
    tiff_sink.write(px.select(F.lit(path).alias("path"), F.lit(0).alias("image"), F.lit(0).alias("c"), "y", "x", F.col("u").alias("v")), tiff_sink.Options(tile_w=16, compression=8, predictor=2))
    changed = px.where("y between 5 and 44 and x between 7 and 40")
    tiff_update.update(path, 0, changed.select(F.lit(0).alias("c"), "y", "x", (255 - F.col("u")).alias("v")))
    return tiff.pixels(tiff.scan(spark, path, "tiles")).select("y", "x", F.col("v").cast("bigint").alias("u"))


@query("""
    WITH r AS (SELECT o_orderkey, o_custkey % 300 - 20 AS x0, o_orderkey % 200 - 10 AS y0, o_custkey % 41 AS w, o_orderkey % 37 AS h FROM orders)
    SELECT o_orderkey, ty, tx, x0 <= tx * 16 AND x0 + w >= tx * 16 + 16 AND y0 <= ty * 8 AND y0 + h >= ty * 8 + 8 AS covered
    FROM r, range(18) a(tx), range(25) b(ty)
    WHERE w > 0 AND h > 0 AND x0 < tx * 16 + 16 AND x0 + w > tx * 16 AND y0 < ty * 8 + 8 AND y0 + h > ty * 8
""")
def rectangles_on_tiles(spark, sf_dir):
    """Tiles that rectangles meet, and those that they cover."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300 - 20).alias("x0"), (F.col("o_orderkey") % 200 - 10).alias("y0"), (F.col("o_custkey") % 41).alias("w"), (F.col("o_orderkey") % 37).alias("h"))
    return raster.rectangles_on_grid(r, 16, 8, 18, 25).select("o_orderkey", "ty", "tx", "covered")


def _one_bit(name: str, options: dict) -> None:
    def run(spark, sf_dir):
        import os

        from .plans.lineage import shared_folder
        from .sources import tiff, tiff_sink

        path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-", dir=shared_folder(spark)), "raster.tif")
        px = pixels(spark, sf_dir).select(F.lit(path).alias("path"), F.lit(0).alias("image"), F.lit(0).alias("c"), "y", "x", (F.col("u") >= 128).cast("int").alias("v"))
        tiff_sink.write(px, tiff_sink.Options(one_bit=True, **options))
        return tiff.pixels(tiff.scan(spark, path, "tiles")).select("y", "x", F.col("v").cast("bigint").alias("u"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = PX + " SELECT y, x, CASE WHEN u >= 128 THEN 1 ELSE 0 END AS u FROM px"


for _name, _options in {
    "codec_ccitt_rle_roundtrip": dict(compression=2, tile_h=9),
    "codec_ccitt_t4_roundtrip": dict(compression=3, fax=5, tile_w=32, tile_h=32),
    "codec_ccitt_t6_roundtrip": dict(compression=4, tile_h=64, fill_order=2),
}.items():
    _one_bit(_name, _options)


@query(PX + " SELECT y, count(*) AS samples, count(*) AS near FROM px GROUP BY y")
def codec_jpeg_bounded(spark, sf_dir):
    """JPEG tiles with all quantisers one: rounding of coefficients moves no sample by more than four."""
    import os

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    path = os.path.join(tempfile.mkdtemp(prefix="jpeg-", dir=shared_folder(spark)), "raster.tif")
    px = pixels(spark, sf_dir)
    tiff_sink.write(px.select(F.lit(path).alias("path"), F.lit(0).alias("image"), F.lit(0).alias("c"), "y", "x", F.col("u").alias("v")), tiff_sink.Options(tile_w=16, tile_h=16, compression=7, level=1.0))
    back = tiff.pixels(tiff.scan(spark, path, "tiles")).join(px, ["y", "x"])
    return back.groupBy("y").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.abs(F.col("v") - F.col("u")) <= 4).alias("near"))


SETTINGS = """
    WITH s AS (
        SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_suppkey % 5 + 1 AS INTEGER) AS channels,
            list_value(1, 4, 8, 12, 16, 24, 32, 64)[l_partkey % 8 + 1] AS depth,
            CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 < 4 THEN 1 ELSE l_orderkey % 7 - 2 END AS fmt,
            CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE list_value(1, 5, 6, 7, 8, 34712, 32809, 9)[l_suppkey % 8 + 1] END AS comp,
            CASE WHEN l_orderkey % 5 < 2 THEN NULL ELSE list_value(0, 1, 2, 3, 5, 6)[l_partkey % 6 + 1] END AS phot,
            l_linenumber % 2 = 0 AS map, l_linenumber % 3 = 0 AS planar, l_orderkey % 2 = 0 AS smart, l_partkey % 11 = 0 AND l_suppkey % 5 > 0 AS odd
        FROM (SELECT DISTINCT ON (l_orderkey * 8 + l_linenumber) * FROM lineitem ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey)
    )
"""


def settings_table(spark, sf_dir) -> DataFrame:
    """Settings of images, one a line of an order; in some the last channel is deeper."""
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")).alias("r")).select("id", "r.*")
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    order = F.col("l_orderkey") % 7
    channels = (F.col("l_suppkey") % 5 + 1).cast("int")
    depth = pick((1, 4, 8, 12, 16, 24, 32, 64), F.col("l_partkey") % 8)
    odd = (F.col("l_partkey") % 11 == 0) & (F.col("l_suppkey") % 5 > 0)
    bits = F.transform(F.sequence(F.lit(1), channels), lambda i: F.when(odd & (i == channels), depth + 3).otherwise(depth))
    return li.select(
        "id", channels.alias("channels"), bits.alias("bits"), F.when(order == 0, None).when(order < 4, 1).otherwise(order - 2).cast("int").alias("sample_format"),
        F.when(F.col("l_orderkey") % 6 == 0, None).otherwise(pick((1, 5, 6, 7, 8, 34712, 32809, 9), F.col("l_suppkey") % 8)).alias("compression"),
        F.when(F.col("l_orderkey") % 5 < 2, None).otherwise(pick((0, 1, 2, 3, 5, 6), F.col("l_partkey") % 6)).alias("photometric"),
        (F.col("l_linenumber") % 2 == 0).alias("color_map"), (F.col("l_linenumber") % 3 == 0).alias("planar"), (F.col("l_orderkey") % 2 == 0).alias("smart"),
    )


@query(SETTINGS + """
    , d AS (
        SELECT *, CASE WHEN channels = 1 AND depth = 1 THEN 1 ELSE (depth + 7) // 8 * 8 END AS norm, CASE WHEN odd THEN depth + 3 ELSE depth END AS last_depth, coalesce(fmt, 1) AS f,
            CASE WHEN smart AND coalesce(comp, 1) = 6 THEN 7 ELSE coalesce(comp, 1) END AS c
        FROM s
    ), t AS (
        SELECT *, CASE WHEN f = 3 THEN CASE WHEN odd THEN NULL WHEN depth IN (16, 24, 32) THEN 32 WHEN depth = 64 THEN 64 END WHEN f IN (1, 2, 4) THEN CASE WHEN norm IN (1, 8, 16) THEN norm WHEN norm IN (24, 32) THEN 32 END END AS whole,
            channels = 3 AND c <> 7 AND phot = 6 AND (c <= 10 OR c = 32809) AND c <> 6 AS diff
        FROM d
    ), p AS (
        SELECT *, CASE
            WHEN (depth + 7) // 8 <> (last_depth + 7) // 8 THEN 'depths differ'
            WHEN whole IS NULL THEN 'no such sample type'
            WHEN NOT smart AND odd THEN 'depths differ'
            WHEN NOT smart AND NOT (depth = 1 AND channels = 1 OR depth IN (8, 16, 32, 64)) THEN 'depth not written'
            WHEN NOT smart AND f = 3 AND depth NOT IN (32, 64) THEN 'float depth not written'
            WHEN c NOT IN (1, 5, 7, 8) THEN 'compression not written'
            WHEN c = 7 AND channels NOT IN (1, 3) THEN 'channels of JPEG'
            WHEN c = 7 AND (channels = 1 AND phot <> 1 OR channels = 3 AND phot NOT IN (2, 6)) THEN 'photometric of JPEG'
            WHEN c <> 7 AND channels = 1 AND phot = 3 AND NOT map THEN 'palette without map'
            WHEN c <> 7 AND channels = 1 AND phot NOT IN (0, 1, 3) THEN 'photometric of one channel'
            WHEN NOT smart AND diff THEN 'colour differences not encoded' END AS problem
        FROM t
    )
    SELECT id, problem,
        CASE WHEN problem IS NULL THEN CAST(CASE WHEN smart THEN whole ELSE depth END AS INTEGER) END AS new_depth,
        CASE WHEN problem IS NULL THEN CAST(CASE WHEN smart AND f = 4 THEN 1 ELSE f END AS INTEGER) END AS new_format,
        CASE WHEN problem IS NULL THEN CAST(c AS INTEGER) END AS new_compression,
        CASE WHEN problem IS NULL THEN CAST(CASE
            WHEN c = 7 AND phot IS NULL THEN CASE WHEN channels = 1 THEN 1 WHEN planar THEN 2 ELSE 6 END
            WHEN c = 7 THEN phot
            WHEN channels = 1 AND phot IS NULL THEN CASE WHEN map THEN 3 ELSE 1 END
            WHEN channels = 3 AND (phot IS NULL OR diff) THEN 2
            WHEN channels = 4 AND phot IS NULL THEN 2
            ELSE phot END AS INTEGER) END AS new_photometric
    FROM p
""")
def settings_corrected(spark, sf_dir):
    """Settings of images as a writer takes them, or why it does not; half of them in strict mode."""
    from .plans import correction

    out = correction.corrected(settings_table(spark, sf_dir), smart=F.col("smart"))
    return out.select("id", "problem", F.col("new_bits")[0].alias("new_depth"), "new_format", "new_compression", "new_photometric")


@query("""
    WITH t AS (
        SELECT l_suppkey AS image, (l_partkey * 8) + (l_suppkey % 2) * 9 AS off, l_orderkey * 8 + l_linenumber AS k, CAST(l_quantity AS BIGINT) AS n
        FROM (SELECT DISTINCT ON (l_orderkey * 8 + l_linenumber) * FROM lineitem ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey, l_quantity)
    ), f AS (
        SELECT *, max(off) OVER (PARTITION BY image) + 20 AS length FROM t
    ), o AS (
        SELECT image, off, arg_min(n, k) AS n, arg_max(n, k) AS last_n, count_if(off + n > length) AS outside, any_value(length) AS length FROM f GROUP BY image, off
    ), i AS (
        SELECT image, CAST(sum(n) AS BIGINT) AS total, min(off) AS first_off, arg_max(off + last_n, off) AS last_end, CAST(sum(outside) AS BIGINT) AS outside, any_value(length) AS length FROM o GROUP BY image
    ), a AS (
        SELECT *, last_end % 2 <> 0 AND last_end <> length AND last_end + 1 <> length AND length - last_end NOT IN (5, 9, -3) AS aligned FROM i
    )
    SELECT image, total + CASE WHEN first_off = 16 THEN 8 ELSE 0 END + CASE WHEN aligned THEN 1 ELSE 0 END AS data_bytes, aligned, outside FROM a
""")
def image_data_size(spark, sf_dir):
    """Bytes of image data with their alignment, in files whose last tiles stand near the end and some of whose places are taken."""
    li = table(spark, sf_dir, "lineitem")
    one = li.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("r")).select("k", "r.*")
    t = one.select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") * 8 + F.col("l_suppkey") % 2 * 9).alias("offset"), "k", F.col("l_quantity").cast("bigint").alias("byte_count"))
    t = t.join(t.groupBy("image").agg((F.max("offset") + 20).alias("length")), "image")
    taken = F.array(F.col("length") - 5, F.col("length") - 9, F.col("length") + 3)
    return index.image_data_size(t, ["image"], F.col("length"), taken=taken)


@query("""
    WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS id, list_value(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 32773, 32809, 32946, 33003, 33005, 34676, 34712, 34925, 50000, 50001)[l_partkey % 20 + 1] AS code,
        list_value(0, 1, 2, 3, 4, 5, 6, 8, 32803, 32844, 32845)[l_suppkey % 11 + 1] AS photometric FROM lineitem)
    SELECT id, code, photometric, code IN (2, 3, 4, 6, 32809) AS old_format, code = 7 AS standard_jpeg, code IN (6, 7) AS jpeg_or_old, code IN (33003, 33005, 34712) AS jpeg_2000, code IN (6, 7, 33003, 33005, 34712) AS jpeg_family,
        code = 6 AS embedded_metadata, code IN (1, 2, 3, 4, 5, 8, 32773, 32809, 32946, 34925, 50000) AS low_level, code <= 10 OR code IN (32773, 32809, 32946, 34925, 50000) AS standard_or_low_level,
        photometric IN (0, 5) AS inverted, photometric = 3 AS indexed, photometric NOT IN (3, 4) AS rescalable, photometric IN (0, 1, 2, 4, 6, 32844, 32845) AS renderable
    FROM c
""")
def format_predicates(spark, sf_dir):
    """Predicates of compressions and photometric interpretations over settings drawn from a table."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    li = table(spark, sf_dir, "lineitem")
    codes = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 32773, 32809, 32946, 33003, 33005, 34676, 34712, 34925, 50000, 50001)
    c = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), pick(codes, F.col("l_partkey") % 20).alias("code"), pick((0, 1, 2, 3, 4, 5, 6, 8, 32803, 32844, 32845), F.col("l_suppkey") % 11).alias("photometric"))
    return c.withColumns(tags.compression_predicates(F.col("code")) | tags.photometric_predicates(F.col("photometric")))


@query(PX + " SELECT r.y, c.x, u FROM range(100) r(y), range(150) c(x), px WHERE px.y = r.y % 16 AND px.x = c.x % 64")
def tiff_repeating_tile(spark, sf_dir):
    """An image of one stored tile, sixteen rows of the raster, under every cell of its grid."""
    import os

    import numpy as np

    from .plans.lineage import shared_folder
    from .sources import tiff, tiff_sink

    path = os.path.join(tempfile.mkdtemp(prefix="repeat-", dir=shared_folder(spark)), "raster.tif")
    tile = np.zeros((16, 64, 1))
    for r in pixels(spark, sf_dir).where("y < 16").collect():  # one tile
        tile[r.y, r.x, 0] = r.u
    tiff_sink.repeat_tile(spark, path, tile, 150, 100, tiff_sink.Options(compression=8))
    return tiff.pixels(tiff.scan(spark, path, "tiles")).select("y", "x", F.col("v").cast("bigint").alias("u"))


@query(PX + " SELECT y, x, CASE WHEN (y // 16 + x // 16) % 2 = 0 THEN u ELSE (3 * y + x) % 256 END AS u FROM px")
def tiff_supplied_tiles(spark, sf_dir):
    """A sparse file with every other tile; the rest comes from a function of the place."""
    import os

    from .plans.lineage import shared_folder
    from .sources import supplier, tiff, tiff_sink

    path = os.path.join(tempfile.mkdtemp(prefix="supply-", dir=shared_folder(spark)), "raster.tif")
    even = pixels(spark, sf_dir).where("(y div 16 + x div 16) % 2 = 0")
    tiff_sink.write(even.select(F.lit(path).alias("path"), F.lit(0).alias("image"), F.lit(0).alias("c"), "y", "x", F.col("u").alias("v")), tiff_sink.Options(tile_w=16, tile_h=16, sparse=True, compression=5))

    def slope(t):
        import numpy as np

        y, x = np.mgrid[t["ty"] * 16 : t["ty"] * 16 + 16, t["tx"] * 16 : t["tx"] * 16 + 16]
        return ((3 * y + x) % 256)[..., None]

    rows = supplier.supplied(tiff.scan(spark, path, "tiles", sparse="true"), slope)
    return rows.select("y", "x0", F.posexplode("samples").alias("i", "v")).select("y", (F.col("x0") + F.col("i")).alias("x"), F.col("v").cast("bigint").alias("u"))


def _slide(spark: SparkSession, sf_dir: str) -> str:
    """A slide of the raster: three layers, thumbnail, label and macro, all without loss; its path."""
    import os

    from .plans.lineage import shared_folder
    from .sources import slide, tiff_sink

    path = os.path.join(tempfile.mkdtemp(prefix="slide-", dir=shared_folder(spark)), "slide.tif")
    px = pixels(spark, sf_dir).select(F.lit(0).alias("c"), "y", "x", F.col("u").alias("v"))
    o = tiff_sink.Options(tile_w=16, tile_h=16, compression=8, predictor=2)
    about = slide.Slide(attributes={"AppMag": 20, "MPP": 0.5, "Date": "02/29/24", "Time": "13:05:09"})
    slide.build(px, path, o, layers=3, ratio=2, thumbnail=40, label=px.where("y < 20 and x < 30"), macro=px.where("y < 20"), small=tiff_sink.Options(compression=8), slide=about)
    return path


@query(PX + """
    , s AS (SELECT max(y) + 1 AS h, CAST(floor(64 * 40 / (max(y) + 1) + 0.5) AS BIGINT) AS tw FROM px),
    l1 AS (SELECT y // 2 AS y, x // 2 AS x, CAST(floor((2 * sum(u) + count(*)) / (2 * count(*))) AS BIGINT) AS u FROM px, s WHERE y < h // 2 * 2 GROUP BY 1, 2),
    l2 AS (SELECT y // 2 AS y, x // 2 AS x, CAST(floor((2 * sum(u) + count(*)) / (2 * count(*))) AS BIGINT) AS u FROM l1, s WHERE y < h // 2 // 2 * 2 GROUP BY 1, 2),
    th AS (
        SELECT b.range AS y, a.range AS x, CAST(floor((2 * sum(u * (least((px.x + 1) * tw, (a.range + 1) * 64) - greatest(px.x * tw, a.range * 64)) * (least((px.y + 1) * 40, (b.range + 1) * h) - greatest(px.y * 40, b.range * h))) + 64 * h) / (2 * 64 * h)) AS BIGINT) AS u
        FROM px, s, range(64) a, range(40) b
        WHERE a.range < tw AND least((px.x + 1) * tw, (a.range + 1) * 64) > greatest(px.x * tw, a.range * 64) AND least((px.y + 1) * 40, (b.range + 1) * h) > greatest(px.y * 40, b.range * h)
        GROUP BY 1, 2, h
    )
    SELECT 0 AS image, y, x, u FROM px UNION ALL SELECT 1, y, x, u FROM th UNION ALL SELECT 2, y, x, u FROM l1 UNION ALL SELECT 3, y, x, u FROM l2
    UNION ALL SELECT 4, y, x, u FROM px WHERE y < 20 AND x < 30 UNION ALL SELECT 5, y, x, u FROM px WHERE y < 20
""")
def slide_pyramid(spark, sf_dir):
    """Every image of a slide file, read back."""
    from .sources import tiff

    back = tiff.pixels(tiff.scan(spark, _slide(spark, sf_dir), "tiles"))
    return back.select(F.col("global_index").alias("image"), "y", "x", F.col("v").cast("bigint").alias("u"))


@query(PX + """
    , s AS (SELECT max(y) + 1 AS h, CAST(floor(64 * 40 / (max(y) + 1) + 0.5) AS BIGINT) AS tw FROM px), i(main_index, image_kind, layer, w, h2, said) AS (
        SELECT 0, 'BASE', 0, 64, h, '64x' || h || ' [0,0 64x' || h || '] (16x16)' FROM s UNION ALL
        SELECT 1, 'THUMBNAIL', -1, tw, 40, '64x' || h || ' -> ' || tw || 'x40' FROM s UNION ALL
        SELECT 2, 'LAYER', 1, 32, h // 2, '64x' || h || ' [0,0 64x' || h || '] (16x16) -> 32x' || h // 2 FROM s UNION ALL
        SELECT 3, 'LAYER', 2, 16, h // 4, '64x' || h || ' [0,0 64x' || h || '] (16x16) -> 16x' || h // 4 FROM s UNION ALL
        SELECT 4, 'LABEL', -1, 30, 20, 'label 30x20' UNION ALL SELECT 5, 'MACRO', -1, 64, 20, 'macro 64x20'
    )
    SELECT main_index, image_kind, CAST(layer AS BIGINT) AS layer, CAST(w AS BIGINT) AS width, CAST(h2 AS BIGINT) AS height, said AS summary, main_index < 2 AS dated, CAST(CASE layer WHEN -1 THEN NULL WHEN 0 THEN 0 ELSE layer + 1 END AS BIGINT) AS image_of_layer FROM i
""")
def slide_kinds(spark, sf_dir):
    """What the images of a slide file are, from its directories alone."""
    from .plans import pyramid
    from .sources import tiff

    kinds = pyramid.classify(tiff.scan(spark, _slide(spark, sf_dir), "ifds"))
    layer = pyramid.layer_of_image(F.col("main_index"), F.lit(1), F.lit(3)).cast("bigint")
    return kinds.select(
        "main_index", "image_kind", layer.alias("layer"), "width", "height", text.svs_summary(F.col("description")).alias("summary"),
        (text.svs_date_time(F.col("description")) == F.lit("2024-02-29 13:05:09").cast("timestamp")).eqNullSafe(True).alias("dated"),
        F.when(layer >= 0, pyramid.image_of_layer(layer, F.lit(1))).cast("bigint").alias("image_of_layer"),
    )


# Files whose bytes are put together here, not by the writer.


def _folder_of(made: DataFrame, label: str) -> str:
    """A folder with the files of rows (name, content)."""
    from .plans.lineage import shared_folder
    from .sources import tiff_layout

    folder = tempfile.mkdtemp(prefix=f"{label}-", dir=shared_folder(made.sparkSession))
    zero = F.lit(0).cast("bigint")
    tiff_layout.save(made.select(F.col("name").alias("path"), zero.alias("start"), zero.alias("at"), F.col("content").alias("data"), F.lit(False).alias("last")), folder)
    return folder


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small file for every part: path, content. Main directory, a sub-directory and an EXIF one; every second is BigTIFF, every third big-endian."""
    import pyarrow as pa

    from .shipping import ship
    from .sources import tiff_format as fmt

    ship(spark)

    def run(batches):
        for b in batches:
            out = []
            for key, size, name in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                order, big = "<>"[key % 3 == 0], key % 2 == 0
                data = bytearray(fmt.file_header(order, big, 16))
                data += bytes(16 - len(data)) if len(data) < 16 else b""
                shape = {256: (4, size), 257: (3, 7), 258: (3, 8), 259: (3, 1), 262: (3, 1), 277: (3, 1)}
                places = {k: 0 for k in (330, 34665)}
                main = {**shape, 270: (2, name), 330: (13, 0), 34665: (4, 0)}
                first = len(data) + len(fmt.pack_directory(order, big, len(data), main))
                places[330] = first + first % 2
                sub = fmt.pack_directory(order, big, places[330], {**shape, 256: (4, size * 2), 305: (2, "sub")})
                second = places[330] + len(sub)
                places[34665] = second + second % 2
                exif = fmt.pack_directory(order, big, places[34665], {33434: (5, (key, 1000)), 34855: (3, [key % 100, 5])})
                data += fmt.pack_directory(order, big, len(data), main | {330: (13, places[330]), 34665: (4, places[34665])})
                data += bytes(places[330] - len(data)) + sub
                data += bytes(places[34665] - len(data)) + exif
                out.append((f"part-{key}", bytes(data)))
            p, c = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(c, pa.binary())], ["path", "content"])

    # few bytes a part, much work: as many tasks as there are cores, however few splits the table has
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint"), "p_name").repartition(max(64, 4 * spark.sparkContext.defaultParallelism), "p_partkey")
    return parts.mapInArrow(run, "path string, content binary")


@query("""
    SELECT p_partkey, 0 AS global_index, 'main' AS kind, CAST(p_size AS BIGINT) AS width, p_name AS description, 9 AS entries FROM part
    UNION ALL SELECT p_partkey, 1, 'sub', CAST(p_size AS BIGINT) * 2, NULL, 7 FROM part
    UNION ALL SELECT p_partkey, 2, 'exif', NULL, NULL, 2 FROM part
""")
def tiff_linked_directories(spark, sf_dir):
    """Main, sub- and EXIF directories of files in both byte orders and offset sizes."""
    from .sources import tiff

    ifds = tiff.from_binary(_part_files(spark, sf_dir), "ifds", linked=("sub", "exif"))
    key = F.regexp_extract("path", "part-([0-9]+)", 1).cast("bigint")
    return ifds.select(key.alias("p_partkey"), "global_index", "kind", "width", "description", "entries")


@query("SELECT p_partkey, CAST(p_partkey AS DOUBLE) / 1000 AS exposure, p_partkey % 100 AS speed FROM part")
def tiff_exif_values(spark, sf_dir):
    """Typed values of an EXIF directory: a rational and the first of two numbers."""
    from .operators import tagged
    from .sources import tiff

    entries = tiff.from_binary(_part_files(spark, sf_dir), "entries", linked=("exif",)).where("global_index = 1")
    wide = tagged.columns(entries, exposure="ExposureTime", speed="ISOSpeedRatings")
    key = F.regexp_extract("path", "part-([0-9]+)", 1).cast("bigint")
    return wide.select(key.alias("p_partkey"), tagged.ratio(F.col("exposure")).alias("exposure"), tagged.number(F.col("speed")).alias("speed"))


@query("""
    SELECT p_partkey, p_partkey % 5 NOT IN (1, 2) AS is_tiff, p_partkey % 5 IN (0, 4) AS is_valid,
        CASE WHEN p_partkey % 5 IN (0, 4) THEN 1 END AS images, CASE WHEN p_partkey % 5 = 4 THEN 16 END AS loop_offset, p_partkey % 5 NOT IN (0, 4) AS failed FROM part
""")
def tiff_damaged_files(spark, sf_dir):
    """What a scan that tolerates damage says of whole files, text, stubs, chains that leave the file, and chains that return."""
    import pyarrow as pa

    from .sources import tiff
    from .sources import tiff_format as fmt

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, kind = bytearray(content), int(path.removeprefix("part-")) % 5
                h = fmt.header(data)
                if kind == 1:
                    data = bytearray(b"some text, " * 9)
                elif kind == 2:
                    data = data[:5]
                elif kind in (3, 4):
                    at = fmt.next_offset_at(data, h, h.first)
                    to = len(data) + 1000 if kind == 3 else h.first
                    data[at : at + (8 if h.big else 4)] = to.to_bytes(8 if h.big else 4, "little" if h.order == "<" else "big")
                out.append(bytes(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    damaged = _part_files(spark, sf_dir).mapInArrow(run, "path string, content binary")
    files = tiff.from_binary(damaged, "files", permissive=True)
    key = F.regexp_extract("path", "part-([0-9]+)", 1).cast("bigint")
    return files.select(key.alias("p_partkey"), "is_tiff", "is_valid", "images", F.col("loop_offset").cast("int").alias("loop_offset"), F.col("error").isNotNull().alias("failed"))


@query(PX + ", b AS (SELECT y, x, u, list_value(2, 4, 6, 7)[CAST(y // 100 % 4 + 1 AS INTEGER)] AS bits FROM px) SELECT y, x, u % CAST(pow(2, bits) AS BIGINT) AS u, u % CAST(pow(2, bits) AS BIGINT) * (255 // (CAST(pow(2, bits) AS BIGINT) - 1)) AS shown FROM b")
def tiff_odd_depths(spark, sf_dir):
    """Packed samples of 2, 4, 6 and 7 bits, a file a hundred rows, as they are and spread over a byte."""
    import numpy as np
    import pyarrow as pa

    from .shipping import ship
    from .sources import tiff
    from .sources import tiff_format as fmt

    ship(spark)

    def build(key, t):
        number = key[0].as_py()
        bits = (2, 4, 6, 7)[number % 4]
        y, x, u = (t.column(n).to_numpy() for n in ("y", "x", "u"))
        a = np.zeros((int(y.max()) - number * 100 + 1, 64), np.int64)
        a[y - number * 100, x] = u % (1 << bits)
        raw = np.packbits((a[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).reshape(len(a), -1).astype(np.uint8), axis=1).tobytes()
        order = "<>"[number % 2]
        at = 8 + len(raw) + len(raw) % 2
        tags_ = {256: (4, 64), 257: (4, len(a)), 258: (3, bits), 259: (3, 1), 262: (3, 1), 273: (4, 8), 277: (3, 1), 278: (4, len(a)), 279: (4, len(raw))}
        content = fmt.file_header(order, False, at) + raw.ljust(at - 8, b"\0") + fmt.pack_directory(order, False, at, tags_)
        return pa.table({"name": [f"{number}.tif"], "content": pa.array([content], pa.binary())})

    files = pixels(spark, sf_dir).withColumn("file", F.expr("y div 100")).groupBy("file").applyInArrow(build, "name string, content binary")
    tiles = tiff.scan(spark, _folder_of(files, "depths"), "tiles")
    number = F.regexp_extract("path", "([0-9]+)[.]tif$", 1).cast("bigint")
    plain, shown = (tiff.pixels(tiles, rescale=r).select((number * 100 + F.col("y")).alias("y"), "x", F.col("v").cast("bigint").alias(n)) for r, n in ((False, "u"), (True, "shown")))
    return plain.join(shown, ["y", "x"])


@query("""
    WITH r AS (SELECT o_orderkey * 7919 % 2003 - 2 AS x0, o_custkey * 104729 % 1503 - 2 AS y0, o_custkey % 7 AS w, o_orderkey % 5 AS h FROM orders),
    cell AS (SELECT DISTINCT x0 + a.range AS x, y0 + b.range AS y FROM r, range(7) a, range(5) b WHERE a.range < w AND b.range < h)
    SELECT y // 8 AS ty, x // 16 AS tx, 128 - count(*) AS unset_area FROM cell WHERE x >= 0 AND x < 2000 AND y >= 0 AND y < 1504 GROUP BY 1, 2 HAVING count(*) < 128
""")
def unset_rectangles(spark, sf_dir):
    """What small rectangles leave of the tiles that they meet; the areas of the rectangles that remain add up."""
    from .operators import coverage

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(spark, sf_dir, "orders").select((k * 7919 % 2003 - 2).alias("x0"), (c * 104729 % 1503 - 2).alias("y0"), (c % 7).alias("w"), (k % 5).alias("h"))
    return coverage.unset_rectangles(r, 16, 8, 125, 188).groupBy("ty", "tx").agg(F.sum(F.col("w") * F.col("h")).alias("unset_area"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN '{"exists":true,"main":' || CASE WHEN p_partkey % 4 = 1 THEN 'false' ELSE 'true' END || ',"application":"Aperio Image","summary":"' || trim(p_name) || '","attributes":{'
        || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE '"MPP":"' || p_partkey || '.25",' END || '"Brand":"' || p_brand || '"},"raw":["Aperio Image","' || p_name || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE '|MPP = ' || p_partkey || '.25' END || '|Brand = ' || p_brand || '"]'
        || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE ',"pixelSize":' || p_partkey || '.25' END || '}' END AS json
    FROM part
""")
def svs_json(spark, sf_dir):
    """Descriptions as JSON; a quarter have no pixel size, a quarter are other texts."""
    kind = F.col("p_partkey") % 4
    size = F.when(kind == 1, "").otherwise(F.concat(F.lit("|MPP = "), F.col("p_partkey").cast("string"), F.lit(".25")))
    said = F.concat(F.when(kind > 0, "Aperio Image\n").otherwise("Another image\n"), F.col("p_name"), size, F.lit("|Brand = "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.svs_json(said).alias("json"))
