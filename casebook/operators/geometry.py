"""Layout joins and kernels: regions, nearest boxes, next stops, affine fits, interval merging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def _tiles(x0: Column, x1: Column, y0: Column, y1: Column, tile: float) -> Column:
    """The tiles of a plane that a box touches, as array<struct<tx, ty>>."""
    side = lambda lo, hi: F.sequence(F.floor(lo / tile), F.floor(hi / tile))
    return F.flatten(F.transform(side(x0, x1), lambda tx: F.transform(side(y0, y1), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))


def point_in_region(points: DataFrame, regions: DataFrame, tile: float = 128.0) -> DataFrame:
    """(point, region): the first region by order that holds a point (point, x, y). Points meet the regions (region, ord, x0, x1,
    y0, y1) of their tile only, in an equality join."""
    dealt = regions.where("x0 <= x1 AND y0 <= y1").withColumn("_t", F.explode(_tiles(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), tile)))
    own = points.withColumn("_t", F.struct(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")))
    inside = F.expr("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return own.join(dealt, "_t").where(inside).groupBy("point").agg(F.min_by("region", F.struct("ord", "region")).alias("region"))


def nearest_on_line(labels: DataFrame, boxes: DataFrame, lo: float = -2, hi: float = 80, line: float = 7, side: str = "right") -> DataFrame:
    """(label, box, gap): the nearest box on a side of a label on its line. Labels have their edge (lx1 on the right, lx0 on
    the left) and ly, boxes the edge that faces them (bx) and by. Lines are joined by strips of twice the tolerance, so each
    label meets its own and two neighbouring strips only."""
    gap = F.col("bx") - F.col("lx1") if side == "right" else F.col("lx0") - F.col("bx")
    strip = 2.0 * line
    near = labels.withColumn("_strip", F.explode(F.array(*[F.floor(F.col("ly") / strip) + k for k in (-1, 0, 1)])))
    pairs = near.join(boxes.withColumn("_strip", F.floor(F.col("by") / strip)), "_strip").withColumn("gap", gap)
    close = pairs.where((F.abs(F.col("by") - F.col("ly")) <= line) & F.col("gap").between(lo, hi))
    best = F.min_by(F.struct("box", "gap"), F.struct(F.abs("gap"), F.col("box"))).alias("b")
    return close.groupBy("label").agg(best).select("label", "b.box", "b.gap")


def next_stop(marks: DataFrame) -> DataFrame:
    """(line, mark, x, stop): where the next mark of a line begins."""
    return marks.withColumn("stop", F.lead("x").over(Window.partitionBy("line").orderBy("x", "mark")))


def sessions(runs: DataFrame, gap: float) -> DataFrame:
    """(line, run, x, group): runs whose distance to the one before is at most ``gap`` are one group."""
    w = Window.partitionBy("line").orderBy("x", "run")
    far = F.coalesce((F.col("x") - F.lag("x").over(w)) > gap, F.lit(True)).cast("int")
    return runs.withColumn("_far", far).withColumn("group", F.sum("_far").over(w)).drop("_far")


def iou(a: str, b: str):
    """Overlap share of two boxes given as column prefixes (x0, y0, x1, y1)."""
    c = lambda p, k: F.col(f"{p}_{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    return w * h / (area(a) + area(b) - w * h)


def affine_fit(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 affine map of least squares."""
    return np.linalg.lstsq(np.column_stack([source, np.ones(len(source))]), target, rcond=None)[0].T


def affine_by_page(pairs: DataFrame) -> DataFrame:
    """(page, a, b, c, d, e, f) of each page's point pairs (x, y, u, v); a page's labels are a few hundred."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = affine_fit(pdf[["x", "y"]].to_numpy(), pdf[["u", "v"]].to_numpy()).reshape(-1)
        return pd.DataFrame([[pdf["page"].iloc[0], *m]], columns=["page", *"abcdef"])

    return pairs.groupBy("page").applyInPandas(fit, "page bigint, a double, b double, c double, d double, e double, f double")


def image_quality(sharpness, brightness, least_side):
    """array of issues of a photo."""
    return F.array_compact(F.array(F.when(sharpness < 60, "blurry"), F.when(brightness < 0.25, "too dark"), F.when(brightness > 0.97, "too bright"), F.when(least_side < 800, "too small")))


def laplacian_variance(image: np.ndarray) -> float:
    """Sharpness of a grey image."""
    g = image.astype(float)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var()) if lap.size else 0.0


def near_top_labels(found: DataFrame, slack: float = 5.0, band: float = 12.0) -> DataFrame:
    """``found`` (label, score, x, y, id) where a label's score is within ``slack`` of its best, with its place in reading
    order: by band of height, then from the left."""
    kept = found.withColumn("_top", F.max("score").over(Window.partitionBy("label"))).where(F.col("score") >= F.col("_top") - slack).drop("_top")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.round(F.col("y") / band), "x", "id")))


def marked_boxes(boxes: DataFrame, marks: DataFrame, pad: float = 1.0, tile: float = 128.0) -> DataFrame:
    """The boxes (box, page, x0, y0, x1, y1) that a mark (page, mx0, my0, mx1, my1) of their page touches within ``pad``. Boxes
    and marks meet in the tiles that they touch."""
    near = f"mx0 <= x1 + {pad} AND mx1 >= x0 - {pad} AND my0 <= y1 + {pad} AND my1 >= y0 - {pad}"
    own = boxes.withColumn("_t", F.explode(_tiles(F.col("x0") - pad, F.col("x1") + pad, F.col("y0") - pad, F.col("y1") + pad, tile)))
    other = marks.where("mx0 <= mx1 AND my0 <= my1").withColumn("_t", F.explode(_tiles(F.col("mx0"), F.col("mx1"), F.col("my0"), F.col("my1"), tile)))
    hit = own.join(other, ["page", "_t"]).where(near).select("box").distinct()
    return boxes.join(hit, "box", "left_semi")


def nearest_repeat(template: DataFrame, found: DataFrame, m: tuple[float, ...]) -> DataFrame:
    """(place, spot): for each template label (page, label, place, x, y) the nearest of its repeats that the page shows
    (page, label, spot, px, py), after the affine map ``m`` (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    x, y = F.col("x"), F.col("y")
    moved = template.withColumn("_u", x * a + y * b + F.lit(c)).withColumn("_v", x * d + y * e + F.lit(f))
    du, dv = F.col("px") - F.col("_u"), F.col("py") - F.col("_v")
    both = moved.join(found, ["page", "label"]).select("place", "spot", (du * du + dv * dv).alias("far"))
    return both.groupBy("place").agg(F.min_by("spot", F.struct("far", "spot")).alias("spot"))


def row_reach(rows: DataFrame, share: float = 0.48, least: float = 5.0, default: float = 9.0) -> DataFrame:
    """(table, reach): how far a table's row (table, y) reaches, a share of the least gap between rows that is more than
    ``least``."""
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("table").orderBy("y"))
    gaps = rows.select("table", gap.alias("gap"))
    return gaps.groupBy("table").agg(F.coalesce(F.min(F.when(F.col("gap") > least, F.col("gap"))) * share, F.lit(default)).alias("reach"))


def voted_pixels(pixels: DataFrame, votes: int = 3) -> DataFrame:
    """Pixels (x, y) that are dark on at least ``votes`` copies of a form: its print."""
    return pixels.groupBy("x", "y").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)


def nth_label(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page, anchor, id): the nth label (page, label, id in reading order) of each anchor (anchor, nth from 0): among
    equal labels where there are any, else among those that begin with it. Anchors are a form's catalog."""
    own = labels.join(F.broadcast(anchors), F.col("label").startswith(F.col("anchor"))).withColumn("_same", F.col("label") == F.col("anchor"))
    group = Window.partitionBy("page", "anchor")
    best = own.withColumn("_any", F.max("_same").over(group)).where("_same = _any")
    return best.withColumn("_n", F.row_number().over(group.orderBy("id")) - 1).where("_n = nth").select("page", "anchor", "id")


def glyphs_to_text(glyphs: DataFrame, share: float = 0.45) -> DataFrame:
    """(line, text): the glyphs (line, ord, ch, x0, x1, height) of a line in writing order; a gap of more than a share of
    the glyph's height is a blank."""
    gap = F.col("x0") - F.lag("x1").over(Window.partitionBy("line").orderBy("ord"))
    piece = F.when(gap > F.col("height") * share, F.concat(F.lit(" "), F.col("ch"))).otherwise(F.col("ch"))
    lines = glyphs.select("line", F.struct("ord", piece.alias("piece")).alias("g")).groupBy("line").agg(F.array_sort(F.collect_list("g")).alias("gs"))
    return lines.select("line", F.btrim(F.regexp_replace(F.array_join(F.transform("gs", lambda g: g["piece"]), ""), r"\s+", " ")).alias("text"))


def rows_between_bands(bands: DataFrame, anchors: DataFrame, count: int = 4) -> DataFrame:
    """(page, row, y): unlabelled rows at their share of the way from one shaded band (page, y) to the next; only pages
    with ``count`` bands. anchors: (row, band, share), a form's layout."""
    w = Window.partitionBy("page")
    order = w.orderBy("y")
    placed = bands.select("page", "y", (F.row_number().over(order) - 1).alias("band"), F.lead("y").over(order).alias("next"), F.count("*").over(w).alias("n")).where(F.col("n") == count)
    return placed.join(F.broadcast(anchors), "band").select("page", "row", (F.col("y") + F.coalesce(F.col("share") * (F.col("next") - F.col("y")), F.lit(0.0))).alias("y"))


def rect_image(m: tuple[float, ...], x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(x0, y0, x1, y1): the upright box around a box's image under an affine map (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    xs = [x * a + y * b + c for x in (x0, x1) for y in (y0, y1)]
    ys = [x * d + y * e + f for x in (x0, x1) for y in (y0, y1)]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def inverse(m: tuple[float, ...]) -> tuple[float, ...]:
    """The inverse of an affine map (a, b, c, d, e, f)."""
    full = np.linalg.inv(np.array([m[:3], m[3:], (0.0, 0.0, 1.0)]))
    return tuple(float(x) for x in full[:2].reshape(-1))


def projected(h: tuple[float, ...], x: Column, y: Column) -> Column:
    """struct(x, y): a point under a perspective map of nine numbers."""
    w = x * h[6] + y * h[7] + h[8]
    return F.struct(((x * h[0] + y * h[1] + h[2]) / w).alias("x"), ((x * h[3] + y * h[4] + h[5]) / w).alias("y"))


def clipped(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box within its page, in whole pixels."""
    at = lambda v: v.cast("int")
    return F.struct(at(F.greatest(F.lit(0.0), x0)).alias("x0"), at(F.greatest(F.lit(0.0), y0)).alias("y0"), at(F.least(width, x1)).alias("x1"), at(F.least(height, y1)).alias("y1"))


def same_line(a: Column, b: Column, tolerance: float = 6.0) -> Column:
    return F.abs(a - b) < tolerance


def page_angle(segments: DataFrame, least: float = 200.0) -> DataFrame:
    """(page, angle): the median slope, in degrees, of a page's long printed lines (page, a, lo, hi); 0 without any."""
    long = F.when(F.col("hi") - F.col("lo") > least, F.degrees(F.atan("a")))
    return segments.groupBy("page").agg(F.coalesce(F.median(long), F.lit(0.0)).alias("angle"))


def rotated(x: Column, y: Column, angle: Column, cx: Column, cy: Column) -> Column:
    """struct(x, y): a point turned back by a page's angle, in degrees, around its middle."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.struct((c * (x - cx) + s * (y - cy) + cx).alias("x"), (-s * (x - cx) + c * (y - cy) + cy).alias("y"))


def _merged(pdf):
    """Collinear pieces of one page and direction joined, in order of their middle's height."""
    import pandas as pd

    at = lambda s, t: s[0] * t + s[1]
    rows = sorted(pdf[["a", "b", "lo", "hi"]].to_numpy().tolist(), key=lambda s: (at(s, (s[2] + s[3]) / 2), s))
    out: list[list[float]] = []
    for s in rows:
        for m in out:
            left, right = max(s[2], m[2]), min(s[3], m[3])
            if left - right < JOIN_GAP and abs(at(s, (left + right) / 2) - at(m, (left + right) / 2)) < JOIN_OFFSET and abs(s[0] - m[0]) < JOIN_SLOPE:
                old, new = m[3] - m[2], s[3] - s[2]
                m[0], m[1] = ((m[k] * old + s[k] * new) / (old + new) for k in (0, 1))
                m[2], m[3] = min(m[2], s[2]), max(m[3], s[3])
                break
        else:
            out.append(list(s))
    keys = [pdf["page"].iloc[0], pdf["across"].iloc[0]]
    return pd.DataFrame([[*keys, i, *m] for i, m in enumerate(out)], columns=["page", "across", "line", "a", "b", "lo", "hi"])


#: How far apart pieces of one printed line are at most: along it, beside it, and in slope.
JOIN_GAP, JOIN_OFFSET, JOIN_SLOPE = 25.0, 4.0, 0.02


def merged_segments(pieces: DataFrame) -> DataFrame:
    """(page, across, line, a, b, lo, hi): pieces of printed lines (page, across, a, b, lo, hi; v = a t + b from lo to hi) joined
    where they are one line. A page has a few hundred pieces; pages are groups."""
    schema = "page bigint, across boolean, line int, a double, b double, lo double, hi double"
    return pieces.groupBy("page", "across").applyInPandas(_merged, schema)


#: Slopes of diagonal writing, in degrees; how tall it is in rows, how wide in pixels; a row's share that it crosses.
SLANT, SPAN_ROWS, SPAN_WIDTH, CROSSED = (20.0, 75.0), 1.3, 15.0, 0.35


def _spans(pdf):
    """Pieces of one column joined into diagonal writing, with the rows that each crosses."""
    import pandas as pd

    box = pdf[["x0", "y0", "x1", "y1", "cx", "cy"]].to_numpy(float)
    gap, rows = float(pdf["gap"].iloc[0]), pdf["rows"].iloc[0]
    row_height = float(np.median([r["y1"] - r["y0"] for r in rows]))
    head = list(range(len(box)))

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i in range(len(box)):
        p, rest = box[i], box[i + 1 :]
        dx = np.maximum(0, np.maximum(p[0], rest[:, 0]) - np.minimum(p[2], rest[:, 2]))
        dy = np.maximum(0, np.maximum(p[1], rest[:, 1]) - np.minimum(p[3], rest[:, 3]))
        slope = np.abs(np.degrees(np.arctan2(rest[:, 5] - p[5], rest[:, 4] - p[4])))
        slope = np.minimum(slope, 180 - slope)
        near = (dx <= gap) & (dy <= gap) & (((slope >= SLANT[0]) & (slope <= SLANT[1])) | ((dx == 0) & (dy == 0)))
        for j in np.flatnonzero(near).tolist():
            head[top(i)] = top(i + 1 + j)
    groups: dict[int, list[int]] = {}
    for i in range(len(box)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for own in groups.values():
        x0, y0, x1, y1 = box[own, 0].min(), box[own, 1].min(), box[own, 2].max(), box[own, 3].max()
        slant = abs(np.degrees(np.arctan2(box[own, 5].max() - box[own, 5].min(), box[own, 4].max() - box[own, 4].min()))) if len(own) > 1 else float(pdf["slant"].iloc[own[0]])
        if y1 - y0 < SPAN_ROWS * row_height or x1 - x0 < SPAN_WIDTH or not SLANT[0] <= slant <= SLANT[1]:
            continue
        crossed = [r["key"] for r in rows if min(r["y1"], y1) - max(r["y0"], y0) > CROSSED * (r["y1"] - r["y0"])]
        if len(crossed) >= 2:
            out.append((pdf["page"].iloc[0], pdf["col"].iloc[0], crossed, x0, y0, x1, y1))
    return pd.DataFrame(out, columns=["page", "col", "keys", "x0", "y0", "x1", "y1"])


def diagonal_spans(pieces: DataFrame, rows: DataFrame, gap: float) -> DataFrame:
    """(page, col, keys, x0, y0, x1, y1): writing across several rows of a column. pieces: page, col, x0, y0, x1, y1, cx, cy,
    slant (boxes, centres and slopes of ink that is no flat word); rows: page, col, key, y0, y1. Pieces at most ``gap``
    apart and in a diagonal, or overlapping, are one. A column of a page has a few dozen pieces."""
    listed = rows.groupBy("page", "col").agg(F.array_sort(F.collect_list(F.struct("y0", "y1", "key"))).alias("rows"))
    both = pieces.join(listed, ["page", "col"]).withColumn("gap", F.lit(gap))
    return both.groupBy("page", "col").applyInPandas(_spans, "page bigint, col string, keys array<string>, x0 double, y0 double, x1 double, y1 double")


def _at(t: Column) -> Column:
    return F.col("a") * t + F.col("b")


def between_lines(points: DataFrame, lines: DataFrame, reach: float = 30.0, clear: float = 2.0) -> DataFrame:
    """(point, before, after): the nearest printed lines (page, line, a, b, lo, hi) before and after a point (page, point, t, v):
    v is its height over t along the lines. A page has a few hundred lines."""
    pairs = points.join(lines, "page", "left").where(F.col("line").isNull() | F.col("t").between(F.col("lo") - reach, F.col("hi") + reach))
    far = _at(F.col("t")) - F.col("v")
    best = pairs.groupBy("page", "point").agg(
        F.max_by("line", F.when(far < -clear, F.struct(far.alias("far"), (-F.col("line")).alias("l")))).alias("before"),
        F.min_by("line", F.when(far > clear, F.struct(far.alias("far"), F.col("line").alias("l")))).alias("after"),
    )
    return points.select("page", "point").join(best, ["page", "point"], "left")


def snapped(points: DataFrame, lines: DataFrame, reach: float = 30.0) -> DataFrame:
    """(page, point, v): a point's height moved to the nearest printed line within its tolerance (page, point, t, v,
    tolerance), or left as it is."""
    pairs = points.join(lines, "page").where(F.col("t").between(F.col("lo") - reach, F.col("hi") + reach))
    at = _at(F.col("t"))
    near = pairs.where(F.abs(at - F.col("v")) <= F.col("tolerance"))
    best = near.groupBy("page", "point").agg(F.min_by(at, F.struct(F.abs(at - F.col("v")).alias("far"), at.alias("at"))).alias("to"))
    return points.join(best, ["page", "point"], "left").select("page", "point", F.coalesce("to", "v").alias("v"))


def merged_bands(bands: DataFrame, apart: float = 40.0) -> DataFrame:
    """(page, top, bottom): shaded bands (page, top, bottom) whose middles are less than ``apart`` from the band before are
    one: gaps and islands over their middles. Of equal bands the one behind the gap comes first, so none is counted to the
    island before. Bands without places (null) come last: one joins the island before, any further one is its own."""
    middle = (F.col("top") + F.col("bottom")) / 2
    places = [F.asc_nulls_last("top"), F.asc_nulls_last("bottom")]
    w = Window.partitionBy("page").orderBy(*places)
    first = F.coalesce(middle - F.lag(middle).over(w) >= apart, F.lit(False)) | F.lag("top").over(w).isNull()
    sums = Window.partitionBy("page").orderBy(*places, F.desc("_first")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = bands.withColumn("_first", first.cast("int")).withColumn("_island", F.sum("_first").over(sums))
    return islands.groupBy("page", "_island").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("_island")


def option_centres(line: Column, used: Column, x0: Column, x1: Column, options: Column) -> Column:
    """array<struct<option, x>>: the middle of each printed option on a folded line, by its characters' places; options (an
    array of folded texts in print order) are looked for one behind the other, long ones also by their first six letters."""
    wide = (x1 - x0) / F.greatest(F.lit(1), F.char_length(line))

    def one(acc: Column, o: Column) -> Column:
        behind = F.substring(line, acc["at"] + 1, F.char_length(line))
        whole, part = F.instr(behind, o), F.instr(behind, F.substring(o, 1, 6))
        found = F.when(whole > 0, whole).when(F.char_length(o) > 3, part).otherwise(0)
        place = acc["at"] + found - 1
        hit = F.struct(o.alias("option"), (x0 + (place + F.char_length(o) / 2) * wide).alias("x"))
        return F.struct(F.when(found > 0, place + 1).otherwise(acc["at"]).cast("int").alias("at"), F.when(found > 0, F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    start = F.struct(used.cast("int").alias("at"), F.array().cast("array<struct<option:string,x:double>>").alias("out"))
    return F.aggregate(options, start, one, lambda acc: acc["out"])


def text_after_label(line: Column, used: Column) -> Column:
    """What a line holds behind its label's characters."""
    return F.btrim(F.substring(line, used + 1, F.char_length(line)), F.lit(" :;."))


def label_choices(anchors: DataFrame) -> DataFrame:
    """(anchor, choice, text): the spellings of labels that are given with bars between them."""
    return anchors.select("anchor", F.posexplode(F.split("anchor", r"\|", -1)).alias("choice", "text"))


def row_anchors(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """(row, band, share): where the labelled rows (page, row, y) of a page lie between its shaded bands (page, y): the last
    band above and the share of the way to the next. Rows above all bands or below the last lie in none."""
    w = Window.partitionBy("page").orderBy("y")
    spans = bands.select("page", (F.row_number().over(w) - 1).alias("band"), F.col("y").alias("from"), F.lead("y").over(w).alias("to"))
    inside = rows.join(spans, "page").where((F.col("y") >= F.col("from")) & (F.col("y") < F.col("to")))
    return inside.select("row", "band", ((F.col("y") - F.col("from")) / (F.col("to") - F.col("from"))).alias("share"))
