"""Queries over the reference's operators on the driver's tables, with the SQL that must give the same rows.

``part`` stands in for the master sheet (brand: code, size: size, name: colour),
``lineitem`` for blocks and rectangles, ``events`` for frame outcomes, ``documents``
for recognised text, ``supplier`` for cameras.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import imaging, master, match, outcome

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space of the text functions, for the SQL side.
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
TRIM = f"'^{WS}|{WS}$'"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


def query(name: str, sql: str | None = None):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, {TRIM}, '', 'g')"


def form_sql(c: str) -> str:
    return f"regexp_replace(lower({trim_sql(c)}), '{WS}', '', 'g')"


def sheet(read) -> DataFrame:
    return read("part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("model"), F.col("p_size").cast("string").alias("size"), F.col("p_name").alias("color"))


CELLS = """cells AS (SELECT 'model' AS kind, p_brand AS cell, p_partkey AS pos FROM part
  UNION ALL SELECT 'size', p_size::VARCHAR, p_partkey FROM part UNION ALL SELECT 'color', p_name, p_partkey FROM part)"""
ENTRIES = f"""{CELLS}, entries AS (SELECT kind, {form_sql('cell')} AS value, min(pos) AS first_pos FROM cells
  WHERE cell IS NOT NULL AND {trim_sql('cell')} <> '' GROUP BY ALL)"""


@query("master_dictionary", f"WITH {ENTRIES} SELECT * FROM entries")
def _(read):
    return master.dictionary(sheet(read))


@query("master_validity", f"""WITH {ENTRIES}, n AS (SELECT count(*) FILTER (kind = 'model') AS models, count(*) FILTER (kind = 'size') AS sizes,
  count(*) FILTER (kind = 'color') AS colors FROM entries) SELECT *, sizes > 0 OR colors > 0 AS valid FROM n""")
def _(read):
    return master.validity(master.dictionary(sheet(read)))


@query("master_listing", f"WITH {ENTRIES} SELECT kind, string_agg(value, ', ' ORDER BY first_pos, value) AS listing FROM entries GROUP BY kind")
def _(read):
    return master.listing(master.dictionary(sheet(read)))


@query("skip_header", "SELECT p_partkey AS pos, p_brand AS model, p_size::VARCHAR AS size, p_name AS color FROM part WHERE p_partkey > (SELECT min(p_partkey) FROM part)")
def _(read):
    return master.skip_header(sheet(read))


@query("camera_labels", "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS camera_index, (row_number() OVER (ORDER BY s_suppkey) - 1) || '. ' || s_name AS label FROM supplier")
def _(read):
    return master.camera_labels(read("supplier"), "s_suppkey", "s_name")


@query("text_trim", f"SELECT doc_id, {trim_sql('text')} AS trimmed, text IS NULL OR {trim_sql('text')} = '' AS blank FROM documents")
def _(read):
    return read("documents").select("doc_id", T.utrim(F.col("text")).alias("trimmed"), T.is_blank(F.col("text")).alias("blank"))


@query("text_squash", f"SELECT doc_id, {form_sql('text')} AS squashed FROM documents")
def _(read):
    return read("documents").select("doc_id", T.dictionary_form(F.col("text")).alias("squashed"))


@query("token_list", f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  kept AS (SELECT doc_id, pos, {trim_sql('line')} AS token FROM lines WHERE {trim_sql('line')} <> '')
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS token_pos, token FROM kept""")
def _(read):
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return match.token_rows(lines, "doc_id", "pos", "line")


def lines_with_parts(read) -> DataFrame:
    part = read("part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"), "p_name")
    return read("lineitem").select(*KEY).join(part, F.col("l_partkey") == F.col("p_partkey"))


def match_sql(tokens: str, source: str, where: str = "") -> str:
    """Positional match in SQL of ``tokens`` (a list expression over ``source``)."""
    return f"""WITH {ENTRIES}, t AS (SELECT {KEYS}, {tokens} AS tokens FROM {source}),
  p AS (SELECT *, len(tokens) >= 3 AS enough, {trim_sql('tokens[1]')} AS a, {trim_sql('tokens[2]')} AS b,
    CASE WHEN len(tokens) = 3 THEN {trim_sql('tokens[3]')} ELSE array_to_string(list_transform(tokens[3:], lambda x: {trim_sql('x')}), '') END AS c FROM t),
  m AS (SELECT {KEYS},
    CASE WHEN enough AND lower(a) IN (SELECT value FROM entries WHERE kind = 'model') THEN a ELSE '' END AS ma_ao,
    CASE WHEN enough AND lower(b) IN (SELECT value FROM entries WHERE kind = 'size') THEN b ELSE '' END AS size,
    CASE WHEN enough AND lower(c) IN (SELECT value FROM entries WHERE kind = 'color') THEN c ELSE '' END AS color FROM p)
  SELECT * FROM m{where}"""


LINES = "lineitem JOIN part ON l_partkey = p_partkey"
SPLIT = "[p_brand, p_size::VARCHAR] || string_split(p_name, ' ')"


def matched(read, tokens: Column) -> DataFrame:
    readings = lines_with_parts(read).select(*KEY, tokens.alias("tokens"))
    return match.match(readings, master.dictionary(sheet(read))).select(*KEY, "ma_ao", "size", "color")


def split_name() -> Column:
    return F.concat(F.array("p_brand", "p_size"), F.split("p_name", " "))


@query("match_three", match_sql("[p_brand, p_size::VARCHAR, p_name]", LINES))
def _(read):
    return matched(read, F.array("p_brand", "p_size", "p_name"))


@query("match_many", match_sql(SPLIT, LINES))
def _(read):
    return matched(read, split_name())


@query("match_short", match_sql("[p_brand, p_size::VARCHAR]", LINES))
def _(read):
    return matched(read, F.array("p_brand", "p_size"))


@query("match_accept", match_sql(SPLIT, LINES, " WHERE ma_ao <> '' AND size <> '' AND color <> ''"))
def _(read):
    return match.accepted(matched(read, split_name()))


CROSS = f"""(SELECT l.*, a.p_brand, b.p_size, c.p_name FROM lineitem l JOIN part a ON l_partkey = a.p_partkey
  JOIN part b ON b.p_partkey = (l_partkey + l_suppkey) % (SELECT count(*) FROM part) + (SELECT min(p_partkey) FROM part)
  JOIN part c ON c.p_partkey = (l_partkey + l_orderkey) % (SELECT count(*) FROM part) + (SELECT min(p_partkey) FROM part))"""


@query("match_cross_row", match_sql(SPLIT, CROSS))
def _(read):
    part = read("part")
    range_of = part.agg(F.count("*").alias("n"), F.min("p_partkey").alias("lo"))  # one row
    lines = read("lineitem").select(*KEY).join(F.broadcast(range_of), F.lit(True))
    lines = lines.withColumns({"k2": (F.col("l_partkey") + F.col("l_suppkey")) % F.col("n") + F.col("lo"), "k3": (F.col("l_partkey") + F.col("l_orderkey")) % F.col("n") + F.col("lo")})
    lines = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    lines = lines.join(part.select(F.col("p_partkey").alias("k2"), F.col("p_size").cast("string").alias("p_size")), "k2")
    lines = lines.join(part.select(F.col("p_partkey").alias("k3"), "p_name"), "k3")
    readings = lines.select(*KEY, split_name().alias("tokens"))
    return match.match(readings, master.dictionary(sheet(read))).select(*KEY, "ma_ao", "size", "color")


LOWEST = "SELECT o_orderkey, coalesce(min(l_discount), 999.0) AS min_score FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


@query("min_score", LOWEST)
def _(read):
    blocks = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    return match.min_score_rows(read("orders"), blocks, "o_orderkey", "l_discount")


@query("accuracy_text", f"SELECT o_orderkey, 'Accuracy: ' || printf('%.2f', min_score * 100) || '%' AS accuracy FROM ({LOWEST})")
def _(read):
    blocks = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    lowest = match.min_score_rows(read("orders"), blocks, "o_orderkey", "l_discount")
    return lowest.select("o_orderkey", T.accuracy_text(F.col("min_score")).alias("accuracy"))


@query("result_text", f"""SELECT {KEYS}, 'QR: "' || l_orderkey || '"' || chr(13) || chr(10) || 'Mã áo: "' || p_brand || '"' || chr(13) || chr(10)
  || 'Size áo: "' || p_size || '"' || chr(13) || chr(10) || 'Màu áo: "' || p_name || '"' AS result FROM {LINES}""")
def _(read):
    return lines_with_parts(read).select(*KEY, T.result_text(F.col("l_orderkey").cast("string"), F.col("p_brand"), F.col("p_size"), F.col("p_name")).alias("result"))


@query("debug_text", f"""SELECT l_orderkey, string_agg({trim_sql('p_name')} || ' | Score: ' || printf('%.2f', l_discount * 100) || '%' || chr(13) || chr(10), ''
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS debug FROM {LINES} GROUP BY l_orderkey""")
def _(read):
    part = read("part").select("p_partkey", "p_name")
    rows = read("lineitem").select(*KEY, "l_discount").join(part, F.col("l_partkey") == F.col("p_partkey"))
    block = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("score"), F.col("p_name").alias("text"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(block)).alias("blocks")).select("l_orderkey", T.debug_text(F.col("blocks")).alias("debug"))


#: Preview sizes, frames and guide boxes made from the keys.
FRAMES = f"""(SELECT {KEYS}, (320 + l_partkey % 1600)::INT AS img_w, (240 + l_suppkey * 7 % 900)::INT AS img_h, 596 AS box_w, 312 AS box_h,
  (l_orderkey % 640 - 20)::INT AS gx, (l_partkey % 340 - 10)::INT AS gy, (l_orderkey % 313)::INT AS gw, (l_suppkey % 211)::INT AS gh FROM lineitem)"""


def frames(read) -> DataFrame:
    k = {c: F.col(c) for c in KEY}
    return read("lineitem").select(
        *KEY, (320 + k["l_partkey"] % 1600).cast("int").alias("img_w"), (240 + k["l_suppkey"] * 7 % 900).cast("int").alias("img_h"), F.lit(596).alias("box_w"), F.lit(312).alias("box_h"),
        (k["l_orderkey"] % 640 - 20).cast("int").alias("gx"), (k["l_partkey"] % 340 - 10).cast("int").alias("gy"), (k["l_orderkey"] % 313).cast("int").alias("gw"), (k["l_suppkey"] % 211).cast("int").alias("gh"),
    )


@query("default_guide_box", f"SELECT {KEYS}, img_w // 4 AS x, img_h // 4 AS y, img_w // 2 AS w, img_h // 2 AS h FROM {FRAMES}")
def _(read):
    return frames(read).select(*KEY, G.default_guide_box(F.col("img_w"), F.col("img_h")).alias("r")).select(*KEY, "r.*")


ROI = f"""WITH f AS (SELECT *, img_w::FLOAT AS iw, img_h::FLOAT AS ih, box_w::FLOAT AS bw, box_h::FLOAT AS bh FROM {FRAMES}),
  s AS (SELECT *, least((bw / iw)::FLOAT, (bh / ih)::FLOAT) AS scale FROM f),
  o AS (SELECT *, ((bw - (iw * scale)::FLOAT)::FLOAT / 2::FLOAT)::FLOAT AS offset_x, ((bh - (ih * scale)::FLOAT)::FLOAT / 2::FLOAT)::FLOAT AS offset_y FROM s),
  p AS (SELECT *, greatest(0::FLOAT, ((gx::FLOAT - offset_x)::FLOAT / scale)::FLOAT) AS fx, greatest(0::FLOAT, ((gy::FLOAT - offset_y)::FLOAT / scale)::FLOAT) AS fy,
    (gw::FLOAT / scale)::FLOAT AS fw, (gh::FLOAT / scale)::FLOAT AS fh FROM o),
  i AS (SELECT *, trunc(fx)::INT AS ix, trunc(fy)::INT AS iy, trunc(least((iw - fx)::FLOAT, fw))::INT AS wi, trunc(least((ih - fy)::FLOAT, fh))::INT AS hi FROM p),
  e AS (SELECT *, greatest(ix, 0) AS l, greatest(iy, 0) AS t, least(ix + wi, img_w) AS r, least(iy + hi, img_h) AS b FROM i),
  m AS (SELECT {KEYS}, CASE WHEN r >= l AND b >= t THEN l ELSE 0 END AS x, CASE WHEN r >= l AND b >= t THEN t ELSE 0 END AS y,
    CASE WHEN r >= l AND b >= t THEN r - l ELSE 0 END AS w, CASE WHEN r >= l AND b >= t THEN b - t ELSE 0 END AS h, scale, offset_x, offset_y FROM e)"""


def roi(read) -> DataFrame:
    names = ("gx", "gy", "gw", "gh", "box_w", "box_h", "img_w", "img_h")
    return frames(read).select(*KEY, G.guide_to_frame(*map(F.col, names)).alias("r")).select(*KEY, "r.mapped.*", "r.scale", "r.offset_x", "r.offset_y", "r.has_image")


@query("roi_map", f"{ROI} SELECT * FROM m")
def _(read):
    return roi(read).drop("has_image")


@query("roi_valid", f"{ROI} SELECT {KEYS}, w > 0 AND h > 0 AS has_image FROM m")
def _(read):
    return roi(read).select(*KEY, "has_image")


CUT = "trunc(img_h * 0.6::DOUBLE)::INT AS cy, trunc(img_w * 0.8::DOUBLE)::INT AS cw, trunc(img_h * 0.4::DOUBLE)::INT AS ch"


@query("ocr_crop", f"""WITH c AS (SELECT *, {CUT} FROM {FRAMES}) SELECT {KEYS}, 0 AS x, cy AS y, least(cw, img_w) AS w, least(cy + ch, img_h) - cy AS h FROM c""")
def _(read):
    return frames(read).select(*KEY, G.ocr_crop(F.col("img_w"), F.col("img_h")).alias("r")).select(*KEY, "r.*")


#: Labels: sides, an angle in (0, 90], a centre, and the code's first two corners, none at right angles to the label.
LABELS = f"""(SELECT {KEYS}, (20 + l_partkey % 300)::FLOAT AS w, (20 + l_suppkey % 200)::FLOAT AS h, (1 + l_orderkey % 90)::FLOAT AS angle,
  (100 + l_partkey % 400)::FLOAT AS cx, (100 + l_suppkey % 300)::FLOAT AS cy, (l_orderkey % 97)::FLOAT AS x0, (l_partkey % 89)::FLOAT AS y0,
  (l_orderkey % 97 + l_suppkey % 41 - 20.5)::FLOAT AS x1, (l_partkey % 89 + l_linenumber * 3 - 10.25)::FLOAT AS y1 FROM lineitem)"""


def labels(read) -> DataFrame:
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    made = {
        "w": 20 + p % 300, "h": 20 + s % 200, "angle": 1 + o % 90, "cx": 100 + p % 400, "cy": 100 + s % 300,
        "x0": o % 97, "y0": p % 89, "x1": o % 97 + s % 41 - 20.5, "y1": p % 89 + n * 3 - 10.25,
    }
    rows = read("lineitem").select(*KEY, *[c.cast("float").alias(k) for k, c in made.items()])
    corner = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    return rows.withColumn("points", F.array(corner(0), corner(1)))


ANGLE = f"""a AS (SELECT *, CASE WHEN w < h THEN angle + 90 ELSE angle END AS raw FROM {LABELS}),
  n AS (SELECT *, CASE WHEN raw >= 135 AND raw <= 180 THEN raw - 180 ELSE raw END AS label_angle, raw > 90 AS swap FROM a)"""


@query("label_angle", f"WITH {ANGLE} SELECT {KEYS}, label_angle::FLOAT AS angle, (CASE WHEN swap THEN h ELSE w END)::INT AS w, (CASE WHEN swap THEN w ELSE h END)::INT AS h FROM n")
def _(read):
    return labels(read).select(*KEY, G.label_angle(F.col("angle"), F.col("w"), F.col("h")).alias("r")).select(*KEY, "r.*")


FLIP = f"""{ANGLE}, q AS (SELECT *, atan2((y1 - y0)::DOUBLE, (x1 - x0)::DOUBLE) * (180.0::DOUBLE / pi()) AS qr FROM n),
  d AS (SELECT *, label_angle - qr AS raw_delta FROM q),
  f AS (SELECT *, CASE WHEN raw_delta <= -180 THEN raw_delta + 360 WHEN raw_delta > 180 THEN raw_delta - 360 ELSE raw_delta END AS delta FROM d)"""


@query("flip_decision", f"WITH {FLIP} SELECT {KEYS}, qr::FLOAT AS qr_angle, abs(delta) > 90 AS flip FROM f")
def _(read):
    rows = labels(read).withColumn("label", G.label_angle(F.col("angle"), F.col("w"), F.col("h"))["angle"]).withColumn("qr", G.qr_angle(F.col("points")))
    return rows.select(*KEY, F.col("qr").alias("qr_angle"), G.needs_flip(F.col("label"), F.col("qr")).alias("flip"))


WINDOW = f"""{ANGLE}, s AS (SELECT *, (CASE WHEN swap THEN h ELSE w END)::INT AS lw, (CASE WHEN swap THEN w ELSE h END)::INT AS lh FROM n),
  c AS (SELECT *, greatest(0, least(trunc((cx - (lw::FLOAT / 2::FLOAT)::FLOAT)::FLOAT)::INT, 639)) AS x, greatest(0, least(trunc((cy - (lh::FLOAT / 2::FLOAT)::FLOAT)::FLOAT)::INT, 479)) AS y FROM s),
  v AS (SELECT *, least(lw, 640 - x) AS vw, least(lh, 480 - y) AS vh, cos(radians(label_angle::DOUBLE)) AS ca, sin(radians(label_angle::DOUBLE)) AS sa FROM c)"""


def windowed(read) -> DataFrame:
    rows = labels(read).withColumn("l", G.label_angle(F.col("angle"), F.col("w"), F.col("h")))
    return rows.withColumn("v", G.crop_window(F.col("cx"), F.col("cy"), F.col("l.w"), F.col("l.h"), F.lit(640), F.lit(480))).withColumn("t", G.rotation(F.col("cx"), F.col("cy"), F.col("l.angle")))


@query("crop_window", f"WITH {WINDOW} SELECT {KEYS}, x, y, vw AS w, vh AS h FROM v")
def _(read):
    return windowed(read).select(*KEY, "v.*")


SIXTEENTHS = "round_even(({})::FLOAT::DOUBLE * 16, 0)::BIGINT"


@query("affine_points", f"""WITH {WINDOW} SELECT {KEYS}, {SIXTEENTHS.format('ca * x0 + sa * y0 + ((1 - ca) * cx - sa * cy - x)')} AS px, {SIXTEENTHS.format('-sa * x0 + ca * y0 + (sa * cx + (1 - ca) * cy - y)')} AS py FROM v""")
def _(read):
    moved = windowed(read).withColumn("moved", G.transformed(F.col("points"), F.col("t"), F.col("v.x"), F.col("v.y")))
    return moved.select(*KEY, *[F.rint(F.col("moved")[0][c].cast("double") * 16).cast("long").alias(f"p{c}") for c in "xy"])


@query("flip_points", f"SELECT {KEYS}, (w - x0)::FLOAT AS fx0, (h - y0)::FLOAT AS fy0, (w - x1)::FLOAT AS fx1, (h - y1)::FLOAT AS fy1 FROM {LABELS}")
def _(read):
    p = G.flipped(F.col("points"), F.col("w"), F.col("h"))
    return labels(read).select(*KEY, p.alias("p")).select(*KEY, *[F.col("p")[k][c].alias(f"f{c}{k}") for k in (0, 1) for c in ("x", "y")])


@query("round_clamp_points", f"""SELECT {KEYS}, greatest(0, least(round_even(x1, 0)::INT, w::INT - 1)) AS cx1, greatest(0, least(round_even(y1, 0)::INT, h::INT - 1)) AS cy1 FROM {LABELS}""")
def _(read):
    p = G.clamped(F.col("points"), F.col("w"), F.col("h"))
    return labels(read).select(*KEY, p[1]["x"].alias("cx1"), p[1]["y"].alias("cy1"))


@query("box_offset", f"SELECT {KEYS}, (x0 + 10)::FLOAT AS x0, (y0 + 20)::FLOAT AS y0, (x1 + 10)::FLOAT AS x1, (y1 + 20)::FLOAT AS y1 FROM {LABELS}")
def _(read):
    p = G.moved(F.col("points"), F.lit(10).cast("float"), F.lit(20).cast("float"))
    return labels(read).select(*KEY, p.alias("p")).select(*KEY, *[F.col("p")[k][c].alias(f"{c}{k}") for k in (0, 1) for c in ("x", "y")])


@query("bound_box", """WITH b AS (SELECT l_orderkey, min(l_partkey % 700) AS x0, min(l_suppkey % 500) AS y0, max(l_partkey % 700) AS x1, max(l_suppkey % 500) AS y1 FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, x0::INT AS x, y0::INT AS y, least(640 - x0, x1 - x0 + 1)::INT AS w, least(480 - y0, y1 - y0 + 1)::INT AS h FROM b""")
def _(read):
    p = F.struct((F.col("l_partkey") % 700).cast("int").alias("x"), (F.col("l_suppkey") % 500).cast("int").alias("y"))
    rows = read("lineitem").groupBy("l_orderkey").agg(F.collect_list(p).alias("p"))
    return rows.select("l_orderkey", G.bound(F.col("p"), F.lit(640), F.lit(480)).alias("r")).select("l_orderkey", "r.*")


@query("guide_box_drag", f"""WITH d AS (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'T' WHEN 3 THEN 'B' END AS edge, (l_suppkey % 81 - 40)::INT AS dx, (l_partkey % 61 - 30)::INT AS dy, FROM {FRAMES}),
  m AS (SELECT *, gx + CASE WHEN edge = 'L' OR edge IS NULL THEN dx ELSE 0 END AS x, gy + CASE WHEN edge = 'T' OR edge IS NULL THEN dy ELSE 0 END AS y,
    gw + CASE edge WHEN 'L' THEN -dx WHEN 'R' THEN dx ELSE 0 END AS w, gh + CASE edge WHEN 'T' THEN -dy WHEN 'B' THEN dy ELSE 0 END AS h FROM d),
  c AS (SELECT {KEYS}, greatest(0, x) AS x, greatest(0, y) AS y, w, h FROM m)
  SELECT {KEYS}, x, y, CASE WHEN x + w > 596 THEN 596 - x ELSE w END AS w, CASE WHEN y + h > 312 THEN 312 - y ELSE h END AS h FROM c""")
def _(read):
    edge = F.element_at(F.array(*map(F.lit, "LRTB"), F.lit(None)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    box = F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gw").alias("w"), F.col("gh").alias("h"))
    dragged = G.drag_box(box, edge, (F.col("l_suppkey") % 81 - 40).cast("int"), (F.col("l_partkey") % 61 - 30).cast("int"), F.lit(596), F.lit(312))
    return frames(read).select(*KEY, dragged.alias("r")).select(*KEY, "r.*")


def dealt(keys: DataFrame, most: int | None = None) -> DataFrame:
    """Keys over all cores: what is drawn from them is far larger than they are, and a small file would be one task.  ``most``: about so many in a task."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(cores, -(-keys.count() // most)) if most else cores)


def pictures(read, table: str, key: str, draw: Callable, look: Callable, schema: str) -> DataFrame:
    """What ``look`` says of the stack of pictures that ``draw`` makes of an array of keys, a row for each key."""
    import pandas as pd

    def run(parts):
        for part in parts:
            keys = part["k"].to_numpy()
            for at in range(0, len(keys), 2000):
                yield pd.DataFrame(look(keys[at : at + 2000], draw(keys[at : at + 2000])), columns=[c.split()[0] for c in schema.split(", ")])

    return dealt(read(table).select(F.col(key).alias("k"))).mapInPandas(run, schema)


def two_blocks(keys):
    """Two filled blocks on a 16 x 24 picture, which do not touch, their sizes from the key; the upper one has a hole if there is room."""
    import numpy as np

    out = np.zeros((len(keys), 24, 16), np.uint8)
    for picture, k in zip(out, keys):
        picture[1 : 4 + k % 7, 1 : 4 + k % 9] = 255
        if k % 2:
            picture[2 : 3 + k % 7, 2 : 3 + k % 9] = 0
        picture[13 : 16 + k // 5 % 7, 2 : 5 + k // 3 % 9] = 255
    return out


def largest_blocks(keys, stack):
    blobs = imaging.Blobs(stack)
    return [(k, blobs.area[blobs.runs.label[runs[0]]], *blobs.bound(runs)) for k, runs in zip(keys, blobs.largest())]


@query("handle_hit", f"""WITH b AS (SELECT {KEYS}, gx AS x, gy AS y, gw AS w, gh AS h, gx + l_suppkey % (gw + 10) - 5 AS px, gy + l_partkey % (gh + 10) - 5 AS py FROM {FRAMES}),
  i AS (SELECT *, px BETWEEN x AND x + 9 AND py BETWEEN y + h // 2 - 5 AND y + h // 2 + 4 AS l, px BETWEEN x + w - 10 AND x + w - 1 AND py BETWEEN y + h // 2 - 5 AND y + h // 2 + 4 AS r,
    px BETWEEN x + w // 2 - 5 AND x + w // 2 + 4 AND py BETWEEN y AND y + 9 AS t, px BETWEEN x + w // 2 - 5 AND x + w // 2 + 4 AND py BETWEEN y + h - 10 AND y + h - 1 AS b FROM b)
  SELECT {KEYS}, CASE WHEN l THEN 'L' WHEN r THEN 'R' WHEN t THEN 'T' WHEN b THEN 'B' END AS edge FROM i""")
def _(read):
    box = F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gw").alias("w"), F.col("gh").alias("h"))
    px, py = F.col("gx") + F.col("l_suppkey") % (F.col("gw") + 10) - 5, F.col("gy") + F.col("l_partkey") % (F.col("gh") + 10) - 5
    return frames(read).select(*KEY, G.hit_edge(box, px, py).alias("edge"))


def squares(keys):
    """A picture of 5 x 5 for each key."""
    import numpy as np

    i, j = np.arange(1, 6)[None, :, None], np.arange(5)[None, None, :]
    k = keys[:, None, None]
    return ((k * i + 31 * j * (k % 7 + 1)) % 256).astype(np.uint8)


@query("pixel_blur", """WITH c AS (SELECT o_orderkey AS k, [1, 4, 6, 4, 1] AS w FROM orders)
  SELECT k, ((list_sum(list_transform(range(25), lambda t: w[t // 5 + 1] * w[t % 5 + 1] * ((k * (t // 5 + 1) + 31 * (t % 5) * (k % 7 + 1)) % 256))) + 128) // 256)::INT AS middle FROM c""")
def _(read):
    return pictures(read, "orders", "o_orderkey", squares, lambda keys, stack: list(zip(keys, imaging.blur(stack)[:, 2, 2].astype(int))), "k long, middle int")


@query("min_area_rectangle", """WITH s AS (SELECT o_orderkey AS k, 1 + k % 9 AS a, 1 + k // 3 % 7 AS b, 1 + k % 4 AS m FROM orders)
  SELECT k, (a - b * m) / 2 AS cx, (b + a * m) / 2 AS cy, round(sqrt(a * a + b * b), 3) AS w, round(m * sqrt(a * a + b * b), 3) AS h, round(degrees(atan2(b, a)), 3) AS angle FROM s""")
def _(read):
    import numpy as np

    def corners(keys):
        a, b, m = 1 + keys % 9, 1 + keys // 3 % 7, 1 + keys % 4
        return np.stack([np.stack([0 * a, 0 * a], 1), np.stack([a, b], 1), np.stack([a - b * m, b + a * m], 1), np.stack([-b * m, a * m], 1)], 1)

    def look(keys, points):
        found = [imaging.min_area_rect(p) for p in points]
        return [(k, round(r.cx, 3), round(r.cy, 3), round(r.w, 3), round(r.h, 3), round(r.angle, 3)) for k, r in zip(keys, found)]

    return pictures(read, "orders", "o_orderkey", corners, look, "k long, cx double, cy double, w double, h double, angle double")


@query("largest_contour", """WITH s AS (SELECT o_orderkey AS k, (2 + k % 9) * (2 + k % 7) AS a, (2 + k // 3 % 9) * (2 + k // 5 % 7) AS b FROM orders)
  SELECT k, greatest(a, b)::DOUBLE AS area, (CASE WHEN a >= b THEN 1 ELSE 2 END)::INT AS x, (CASE WHEN a >= b THEN 1 ELSE 13 END)::INT AS y,
    (CASE WHEN a >= b THEN 3 + k % 9 ELSE 3 + k // 3 % 9 END)::INT AS w, (CASE WHEN a >= b THEN 3 + k % 7 ELSE 3 + k // 5 % 7 END)::INT AS h FROM s""")
def _(read):
    return pictures(read, "orders", "o_orderkey", two_blocks, largest_blocks, "k long, area double, x int, y int, w int, h int")


@query("pixel_threshold", f"""SELECT {KEYS}, round_even(0.114 * (l_orderkey % 256) + 0.587 * (l_partkey % 256) + 0.299 * (l_suppkey * 3 % 256), 0)::INT AS gray,
  CASE WHEN round_even(0.114 * (l_orderkey % 256) + 0.587 * (l_partkey % 256) + 0.299 * (l_suppkey * 3 % 256), 0) > 180 THEN 255 ELSE 0 END AS bright FROM lineitem""")
def _(read):
    import numpy as np

    def run(parts):
        for part in parts:
            pixels = np.stack([part["l_orderkey"] % 256, part["l_partkey"] % 256, part["l_suppkey"] * 3 % 256], axis=-1).astype(np.uint8)[:, None, :]
            gray = imaging.gray(pixels)
            yield part.assign(gray=gray[:, 0].astype(np.int32), bright=imaging.threshold(gray, 180)[:, 0].astype(np.int32))

    return read("lineitem").select(*[F.col(c).cast("long").alias(c) for c in KEY]).mapInPandas(run, ", ".join(f"{c} long" for c in KEY) + ", gray int, bright int")


def outcome_of_event() -> Column:
    kind = F.col("event_type")
    return outcome.outcome(F.col("ts").isNotNull(), F.col("value").isNotNull(), F.lit(False), kind != "error", kind != "signup", kind == "purchase")


OUTCOME = "CASE WHEN ts IS NULL THEN 'NO_FRAME' WHEN value IS NULL THEN 'NO_ROI' WHEN event_type = 'error' THEN 'NO_LABEL' WHEN event_type = 'signup' THEN 'ALIGN_FAIL' WHEN event_type = 'purchase' THEN 'SUCCESS' ELSE 'NO_MATCH' END"


def event_frames(read) -> DataFrame:
    return read("events").select("event_id", "user_id", "ts", outcome_of_event().alias("outcome"))


@query("frame_outcome", f"SELECT event_id, user_id, ts, {OUTCOME} AS outcome FROM events")
def _(read):
    return event_frames(read)


@query("sticky_state", f"""SELECT event_id, user_id, ts, outcome, coalesce(last_value(CASE outcome WHEN 'SUCCESS' THEN true WHEN 'NO_LABEL' THEN false END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS detected FROM (SELECT event_id, user_id, ts, {OUTCOME} AS outcome FROM events)""")
def _(read):
    return outcome.sticky(event_frames(read), "user_id", ["ts", "event_id"])


@query("pause_filter", f"""WITH RECURSIVE f AS (SELECT event_id, user_id, ts, {OUTCOME} AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  w AS (SELECT event_id, user_id, ts, outcome, n, true AS seen, CASE WHEN outcome = 'SUCCESS' THEN ts + INTERVAL 1 DAY END AS until FROM f WHERE n = 1
    UNION ALL SELECT f.event_id, f.user_id, f.ts, f.outcome, f.n, w.until IS NULL OR f.ts >= w.until,
      CASE WHEN (w.until IS NULL OR f.ts >= w.until) AND f.outcome = 'SUCCESS' THEN f.ts + INTERVAL 1 DAY ELSE w.until END FROM w JOIN f ON f.user_id = w.user_id AND f.n = w.n + 1)
  SELECT event_id, user_id, ts, outcome FROM w WHERE seen""")
def _(read):
    return outcome.paused(event_frames(read), "user_id", ["ts", "event_id"], 24 * 3600)


@query("fps", """WITH d AS (SELECT event_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS ms FROM events)
  SELECT event_id, ms, CASE WHEN ms > 0 THEN 1000.0::DOUBLE / ms ELSE 0 END AS fps FROM d""")
def _(read):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = F.date_trunc("second", "ts").cast("long") - F.date_trunc("second", before).cast("long")
    return read("events").select("event_id", seconds.alias("ms")).withColumn("fps", T.fps(F.col("ms")))


def synthetic_frames(read) -> DataFrame:
    """A bright upright rectangle on a dark 48 x 36 frame for every order, its place and size from the key."""
    import numpy as np
    import pandas as pd

    def run(parts):
        for part in parts:
            rows = []
            for key in part["frame_id"]:
                image = np.full((36, 48, 3), 20, np.uint8)
                x, y, w, h = key % 17 + 4, key % 11 + 4, key % 13 + 8, key % 7 + 8
                image[y : y + h, x : x + w] = 250
                rows.append((key, 36, 48, image.tobytes()))
            yield pd.DataFrame(rows, columns=["frame_id", "height", "width", "data"])

    return dealt(read("orders").select(F.col("o_orderkey").alias("frame_id"))).mapInPandas(run, "frame_id long, height int, width int, data binary")


# The blur takes one pixel off each side; the rectangle runs through pixel centres.
@query("imaging_pipeline", """WITH r AS (SELECT o_orderkey AS k, k % 17 + 5 AS x, k % 11 + 5 AS y, k % 13 + 6 AS w, k % 7 + 6 AS h FROM orders)
  SELECT k AS frame_id, (x + (w - 1) / 2)::FLOAT AS cx, (y + (h - 1) / 2)::FLOAT AS cy, (h - 1)::FLOAT AS w, (w - 1)::FLOAT AS h, 90::FLOAT AS angle, x::INT AS bx, y::INT AS by, w::INT AS bw, h::INT AS bh FROM r""")
def _(read):
    return imaging.detect_frames(synthetic_frames(read))
