"""Images to scale bars, particles and panels: plain numpy on executors, one image at a time; tables from there on.

``analyze`` is the default analyser of a decoded image and may be replaced by any function of the same shape. Contours are
traced along the centres of border pixels, so areas and perimeters are those of the polygon through them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators.vision import distinct_warnings, label_nm, scale_bar_confidence, scale_bar_like

Box = tuple[int, int, int, int]
_STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise from the right, rows going down


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG without interlacing as grey values (rows, columns)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, head, palette = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        packed += body if kind == b"IDAT" else b""
        at += size + 12
    width, height, depth, color, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG images without interlacing are read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(width * n):
                a = line[x - n] if x >= n else 0
                b, c = above[x], above[x - n] if x >= n else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    image = out.reshape(height, width, n)
    if color == 3:
        image = palette[image[..., 0]]
    return grey(image[..., 0] if image.shape[-1] in (1, 2) else image[..., :3])


def grey(image: np.ndarray) -> np.ndarray:
    """Grey values of an image of one or of three (red, green, blue) channels."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _window(mask: np.ndarray, shape: list[tuple[int, int]], use: Callable, edge: bool) -> np.ndarray:
    """``use`` (or, and) over a mask moved by each step of a shape; outside it the value is ``edge``."""
    reach = max(max(abs(a), abs(b)) for a, b in shape)
    wide = np.pad(mask, reach, constant_values=edge)
    parts = [wide[reach + a : reach + a + mask.shape[0], reach + b : reach + b + mask.shape[1]] for a, b in shape]
    return use.reduce(parts)


def _rect(w: int, h: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-(h // 2), h // 2 + 1) for b in range(-(w // 2), w // 2 + 1)]


def closed(mask: np.ndarray, w: int, h: int) -> np.ndarray:
    return _window(_window(mask, _rect(w, h), np.logical_or, False), _rect(w, h), np.logical_and, True)


def opened(mask: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    return _window(_window(mask, shape, np.logical_and, True), shape, np.logical_or, False)


def labels(mask: np.ndarray) -> np.ndarray:
    """Components of a mask by eight neighbours, numbered from 1; runs of a row are joined with those they touch above."""
    out, root, before = np.zeros(mask.shape, np.int32), [0], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y, line in enumerate(mask):
        turn = np.flatnonzero(np.diff(np.concatenate([[0], line.view(np.uint8), [0]]).astype(np.int8)))
        here = []
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            touch = [i for s, e, i in before if s <= b and e >= a]
            if touch:
                own = min(find(i) for i in touch)
                for i in touch:
                    root[find(i)] = own
            else:
                own = len(root)
                root.append(own)
            out[y, a:b] = own
            here.append((a, b, own))
        before = here
    return np.unique(np.array([find(i) for i in range(len(root))], np.int32)[out], return_inverse=True)[1].reshape(mask.shape) if len(root) > 1 else out


def contour(mask: np.ndarray) -> np.ndarray:
    """The outer border of a mask's one component as (row, column), once around clockwise."""
    ys, xs = np.nonzero(mask)
    start = (int(ys[0]), int(xs[0]))
    inside = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]
    path, at, turn, first = [start], start, 6, None
    for _ in range(8 * mask.size + 8):
        for k in range(8):
            d = (turn + k) % 8
            there = (at[0] + _STEPS[d][0], at[1] + _STEPS[d][1])
            if inside(there):
                break
        else:
            return np.array(path)
        if (at, d) == first:
            return np.array(path[:-1] if len(path) > 1 and path[-1] == path[0] else path)
        first = first or (at, d)
        at, turn = there, (d + 6) % 8
        path.append(at)
    return np.array(path)


def measured(path: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of the polygon through a closed path."""
    y, x = path[:, 0].astype(float), path[:, 1].astype(float)
    after = np.roll(path, -1, axis=0)
    area = abs((x * after[:, 0] - y * after[:, 1]).sum()) / 2
    return float(area), float(np.hypot(after[:, 0] - y, after[:, 1] - x).sum())


def boxes(mask: np.ndarray) -> list[tuple[Box, np.ndarray]]:
    """((x, y, width, height), own pixels) of each component."""
    found = labels(mask)
    if not found.any():
        return []
    ys, xs = np.nonzero(found)
    ids = found[ys, xs]
    order = np.argsort(ids, kind="stable")
    ids, ys, xs = ids[order], ys[order], xs[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
    out = []
    for a, b in zip(edge, edge[1:], strict=False):
        y0, y1, x0, x1 = ys[a:b].min(), ys[a:b].max(), xs[a:b].min(), xs[a:b].max()
        own = np.zeros((y1 - y0 + 1, x1 - x0 + 1), bool)
        own[ys[a:b] - y0, xs[a:b] - x0] = True
        out.append(((int(x0), int(y0), int(x1 - x0 + 1), int(y1 - y0 + 1)), own))
    return out


def bar_like(box: Box, width: int, height: int) -> bool:
    _, y, w, h = box
    return w >= max(20, int(width * 0.04)) and 2 <= h <= max(12, int(height * 0.04)) and w / max(h, 1) >= 6 and y >= int(height * 0.45)


def bar_confidence(box: Box, width: int, height: int) -> float:
    _, y, w, h = box
    return round(0.45 * min(1.0, w / max(h, 1) / 20) + 0.35 * min(1.0, max(0.0, (y / height - 0.45) / 0.45)) + 0.20 * min(1.0, w / max(1.0, width * 0.25)), 3)


def scale_bar(image: np.ndarray, nm: float | None = None) -> dict | None:
    """The likeliest scale bar, dark or light, by confidence, then length."""
    height, width = image.shape
    best = None
    for polarity, mask in (("dark", image <= 70), ("light", image > 185)):
        for box, _ in boxes(closed(mask, 9, 3)):
            if bar_like(box, width, height):
                one = {"bbox": list(box), "length_px": float(box[2]), "label_nm": nm, "nm_per_px": nm / box[2] if nm else None, "polarity": polarity, "confidence": bar_confidence(box, width, height)}
                if best is None or (one["confidence"], one["length_px"]) > (best["confidence"], best["length_px"]):
                    best = one
    return best


def _blurred(image: np.ndarray) -> np.ndarray:
    k = np.array([1, 4, 6, 4, 1]) / 16
    wide = np.pad(image.astype(float), 2, mode="reflect")
    rows = sum(k[i] * wide[i : i + image.shape[0]] for i in range(5))
    return np.rint(sum(k[i] * rows[:, i : i + image.shape[1]] for i in range(5))).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The grey value that parts an image into two classes of least spread."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), between, -1)))


def mask_score(mask: np.ndarray) -> float:
    share = mask.mean()
    if share <= 0.001 or share >= 0.75:
        return 0.0
    return max(0.0, 1 - abs(share - 0.15)) + min(1.0, int(labels(mask).max()) / 50)


def particle_mask(image: np.ndarray) -> np.ndarray:
    """Foreground, dark or light, without scale bars in the lowest quarter, without single specks."""
    blurred = _blurred(image)
    dark = blurred <= otsu(blurred)
    mask = (dark if mask_score(dark) >= mask_score(~dark) else ~dark).copy()
    height, width = mask.shape
    low = int(height * 0.75)
    for (x, y, w, h), _ in boxes(mask[low:]):
        if bar_like((x, y + low, w, h), width, height):
            mask[y + low : y + low + h + 1, x : x + w + 1] = False
    return opened(mask, [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)])


def contours(image: np.ndarray) -> list[dict]:
    """Every contour of the foreground with box, area and perimeter in pixels."""
    out = []
    for i, (box, own) in enumerate(boxes(particle_mask(image)), 1):
        area, perimeter = measured(contour(own))
        out.append({"contour_id": i, "bbox": list(box), "area_px": area, "perimeter_px": perimeter})
    return out


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thin edges: gradient maxima over ``high`` and what hangs on them over ``low``."""
    g = np.pad(image.astype(np.int64), 1, mode="edge")
    dx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    dy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    wide = np.pad(size, 1)
    near = lambda a, b: wide[1 + a : 1 + a + size.shape[0], 1 + b : 1 + b + size.shape[1]]
    flat, steep = np.abs(dy) * 2.414 < np.abs(dx), np.abs(dx) * 2.414 < np.abs(dy)
    same = (dx >= 0) == (dy >= 0)
    one = np.where(flat, near(0, -1), np.where(steep, near(-1, 0), np.where(same, near(-1, -1), near(-1, 1))))
    two = np.where(flat, near(0, 1), np.where(steep, near(1, 0), np.where(same, near(1, 1), near(1, -1))))
    thin = (size > one) & (size >= two) & (size > low)
    found = labels(thin)
    return thin & np.isin(found, np.unique(found[thin & (size > high)]))


def panel_kind(image: np.ndarray) -> str:
    """What a panel shows, by the share of its edges that run straight."""
    h, w = image.shape
    my, mx = max(2, int(h * 0.04)), max(2, int(w * 0.04))
    inner = image[my : h - my, mx : w - mx]
    e = edges(inner if inner.size else image)
    straight = opened(e, [(0, b) for b in range(-12, 13)]).sum() + opened(e, [(a, 0) for a in range(-12, 13)]).sum()
    if straight > max(120, e.sum() * 0.8):
        return "plot_or_histogram"
    return "microscopy" if e.sum() > max(200, e.size * 0.01) else "unknown"


def panels(image: np.ndarray, least_share: float = 0.02) -> list[dict]:
    """Boxes of an image's panels, from top to bottom; ``index`` is the order in which they were found."""
    h, w = image.shape
    out = []
    for box, _ in boxes(closed(edges(image), 15, 15)):
        x, y, bw, bh = box
        if bw * bh >= h * w * least_share and bw >= 40 and bh >= 40:
            out.append({"index": len(out) + 1, "bbox": list(box), "kind": panel_kind(image[y : y + bh, x : x + bw]), "confidence": min(1.0, bw * bh / (w * h))})
    return sorted(out, key=lambda p: (p["bbox"][1], p["bbox"][0]))


def analyze(image: np.ndarray, nm: float | None, labelled: bool) -> dict:
    """Scale bar, contours, panels and warnings of one image."""
    bar = scale_bar(image, nm)
    warnings = ["Scale label was provided, but no scale bar was detected."] if labelled and bar is None else []
    if bar is not None and bar["nm_per_px"] is None:
        warnings.append("Scale bar was detected without a numeric scale label; particle diameters are in pixels only.")
    return {"image_width": image.shape[1], "image_height": image.shape[0], "scale_bar": bar, "contours": contours(image), "panels": panels(image), "warnings": warnings}


def analyze_panels(image: np.ndarray, nm: float | None, labelled: bool, one: Callable = analyze) -> list[dict]:
    """Each panel by itself; the whole image where there is none. Plots without a scale bar are left for other readers."""
    found = panels(image)
    out = []
    for p in found:
        x, y, w, h = p["bbox"]
        crop = image[y : y + h, x : x + w]
        if p["kind"] == "plot_or_histogram" and scale_bar(crop, nm) is None:
            out.append({"image_width": w, "image_height": h, "scale_bar": None, "contours": [], "panels": [p], "warnings": ["Plot or histogram panel detected; route this crop to VLM/plot reader."]})
        else:
            out.append({**one(crop, nm, labelled), "panels": [p]})
    return out or [one(image, nm, labelled)]


_BOX = "bbox:array<int>"
RESULT = f"index int, image_width int, image_height int, scale_bar struct<{_BOX},length_px:double,label_nm:double,nm_per_px:double,polarity:string,confidence:double>, contours array<struct<contour_id:int,{_BOX},area_px:double,perimeter_px:double>>, panels array<struct<index:int,{_BOX},kind:string,confidence:double>>, warnings array<string>"


def analyze_images(images: DataFrame, keys: list[str], image: str = "image", label: str | None = None, crop_panels: bool = False, decode: Callable[[bytes], np.ndarray] = read_png, one: Callable = analyze) -> DataFrame:
    """(keys, index, image size, scale_bar, contours, panels, warnings): a row per image, or per panel with ``crop_panels``.

    ``label`` names a column with the scale label, if any. An image that can't be read gives a row with a warning.
    """
    nm = label_nm(F.col(label)) if label else F.lit(None).cast("double")
    df = images.select(*keys, F.col(image).alias("__image"), nm.alias("__nm"), (F.coalesce(F.col(label), F.lit("")) != F.lit("") if label else F.lit(False)).alias("__labelled"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                data, scale, labelled = row[-3:]
                scale = None if scale is None or np.isnan(scale) else float(scale)
                try:
                    pixels = grey(decode(data))
                    made = analyze_panels(pixels, scale, labelled, one) if crop_panels else [one(pixels, scale, labelled)]
                except Exception as e:  # an image that can't be read must not end the job
                    made = [{"image_width": 0, "image_height": 0, "scale_bar": None, "contours": [], "panels": [], "warnings": [f"Could not read image: {e}"]}]
                yield pd.DataFrame([{**dict(zip(keys, row, strict=False)), "index": i, **m} for i, m in enumerate(made, 1)], columns=[*keys, "index", "image_width", "image_height", "scale_bar", "contours", "panels", "warnings"])

    return df.mapInPandas(run, f"{kinds}, {RESULT}")


def particles_of(results: DataFrame, least_area: float = 20.0, most_share: float = 0.1) -> Column:
    """The contours that can be particles, from top to bottom, with circularity and diameters in pixels and nanometres."""
    size = F.col("image_width") * F.col("image_height") * most_share
    fit = F.filter("contours", lambda c: (c["area_px"] >= least_area) & (c["area_px"] <= size) & (c["perimeter_px"] > 0))
    d = lambda c: F.sqrt(4.0 * c["area_px"] / F.pi())
    made = F.transform(fit, lambda c: F.struct(F.get(c["bbox"], F.lit(1)).alias("y"), F.get(c["bbox"], F.lit(0)).alias("x"), c["contour_id"].alias("contour_id"), c["bbox"].alias("bbox"), c["area_px"].alias("area_px"), d(c).alias("equivalent_diameter_px"), (d(c) * F.col("scale_bar.nm_per_px")).alias("equivalent_diameter_nm"), (4 * F.pi() * c["area_px"] / (c["perimeter_px"] * c["perimeter_px"])).alias("circularity")))
    return F.array_sort(made)


def summaries(results: DataFrame, keys: list[str], least_area: float = 20.0) -> DataFrame:
    """A row per image or panel: its particles' count, mean, median, sample deviation and range, its scale, first panel and warnings.

    Deviation is null for one particle; figures in nanometres are null without a scale.
    """
    df = results.withColumn("particles", particles_of(results, least_area))
    nm, px = F.transform("particles", lambda p: p["equivalent_diameter_nm"]), F.transform("particles", lambda p: p["equivalent_diameter_px"])
    df = df.withColumns({"nm": F.array_sort(F.filter(nm, lambda v: v.isNotNull())), "px": px, "n": F.size("particles")})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    df = df.withColumn("k", F.size("nm")).withColumn("mean", F.when(F.col("k") > 0, total("nm") / F.col("k")))
    middle = (F.get("nm", F.floor((F.col("k") - 1) / 2).cast("int")) + F.get("nm", F.floor(F.col("k") / 2).cast("int"))) / 2
    spread = F.aggregate("nm", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
    panel = F.get("panels", F.lit(0))
    return df.select(*keys, "index", F.col("n").alias("count"), F.col("mean").alias("mean_diameter_nm"), F.when(F.col("k") > 0, middle).alias("median_diameter_nm"), F.when(F.col("k") > 1, F.sqrt(spread / (F.col("k") - 1))).alias("std_diameter_nm"), F.array_min("nm").alias("min_diameter_nm"), F.array_max("nm").alias("max_diameter_nm"), F.when(F.col("n") > 0, total("px") / F.col("n")).alias("mean_diameter_px"), F.col("scale_bar.length_px").alias("scale_length_px"), F.col("scale_bar.label_nm").alias("scale_label_nm"), F.col("scale_bar.nm_per_px").alias("nm_per_px"), panel["index"].alias("panel"), F.coalesce(panel["kind"], F.lit("")).alias("panel_kind"), panel["bbox"].alias("panel_bbox"), "warnings")


def display_rows(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries as people read them: the scale, the first panel, the figures, the warnings as one text."""
    return summary.select(*keys, "index", "panel_kind", F.coalesce(F.concat(F.lit("("), F.array_join(F.transform("panel_bbox", lambda v: v.cast("string")), ", "), F.lit(")")), F.lit("")).alias("panel_bbox"), F.col("scale_length_px").alias("scale_bar_px"), "scale_label_nm", "nm_per_px", F.col("count").alias("particle_count"), "mean_diameter_nm", "median_diameter_nm", "std_diameter_nm", "mean_diameter_px", F.array_join("warnings", " | ").alias("warnings"))


def best_bar(df: DataFrame, keys: list[str], width: str, height: str) -> DataFrame:
    """Of boxes (x, y, w, h) that can be scale bars, each image's best by confidence, then length."""
    box = [F.col("w"), F.col("h"), F.col("y"), F.col(width), F.col(height)]
    fit = df.where(scale_bar_like(*box)).withColumn("confidence", scale_bar_confidence(*box))
    return fit.groupBy(*keys).agg(F.max(F.struct("confidence", F.col("w").cast("double").alias("length_px"), "x", "y", "w", "h")).alias("b")).select(*keys, "b.*")


def warnings_of(results: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The first distinct warnings of all images of a key, in order."""
    return results.groupBy(*keys).agg(distinct_warnings(F.transform(F.array_sort(F.collect_list(F.struct("index", "warnings"))), lambda x: x["warnings"]), most).alias("warnings"))
