"""Blocks of recognized text on a page: boxes, reading order, merging, labels and their values.

Blocks: image_id, block_id, text, x, y, width, height. Pages are small, so pairs are a self-join by image.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.tokens import INLINE_GAP, OCR_BREAK

# Height tolerance and gap of one line, height tolerance between lines (ideographs, others); label layout windows.
SAME_LINE_HEIGHT, SAME_LINE_GAP, NEXT_LINE_HEIGHT = 0.10, 0.5, (0.09, 0.20)
HEIGHT_WINDOW, X_WINDOW, RHYTHM_WINDOW, LEAST_LABELS = 12, 64, 12, 3


def box(polygon: Column) -> Column:
    """Smallest whole box around a polygon: floor of the least, ceiling of the largest coordinates, at least 1 wide and high."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    x, y = F.floor(F.array_min(xs)), F.floor(F.array_min(ys))
    size = lambda v, lo: F.greatest(F.lit(1), F.ceil(F.array_max(v)) - lo)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), size(xs, x).cast("int").alias("width"), size(ys, y).cast("int").alias("height"))


def usable(blocks: DataFrame) -> DataFrame:
    """Without blank blocks and those without a box."""
    return blocks.where((F.trim("text") != "") & F.col("x").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0))


def _pairs(blocks: DataFrame) -> DataFrame:
    a, b = blocks.alias("a"), blocks.alias("b")
    return a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.block_id") != F.col("b.block_id")))


def chains(blocks: DataFrame) -> DataFrame:
    """(image_id, block_id, right_id, below_id): the nearest block to the right on the same row, and the nearest below whose left
    edge is within the larger height; null if there is none."""
    p = _pairs(blocks)
    row = (F.col("a.y") < F.col("b.y") + F.col("b.height")) & (F.col("b.y") < F.col("a.y") + F.col("a.height"))
    right = row & (F.col("b.x") >= F.col("a.x") + F.col("a.width"))
    below = (F.col("b.y") >= F.col("a.y") + F.col("a.height")) & (F.abs(F.col("a.x") - F.col("b.x")) <= F.greatest("a.height", "b.height"))
    near = p.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.block_id").alias("block_id")).agg(
        F.min(F.when(right, F.struct(F.col("b.x").alias("k"), F.col("b.block_id").alias("id"))))["id"].alias("right_id"),
        F.min(F.when(below, F.struct(F.col("b.y").alias("k"), F.col("b.block_id").alias("id"))))["id"].alias("below_id"),
    )
    return blocks.select("image_id", "block_id").join(near, ["image_id", "block_id"], "left")


def merges(blocks: DataFrame) -> DataFrame:
    """(image_id, a, b, how): neighbours whose texts continue each other, on one line or on the next."""
    p = _pairs(blocks)
    gap, low = F.col("b.x") - (F.col("a.x") + F.col("a.width")), F.least("a.height", "b.height")
    differ = F.abs(F.col("a.height") - F.col("b.height")) / F.greatest("a.height", "b.height")
    row = (F.col("a.y") < F.col("b.y") + F.col("b.height")) & (F.col("b.y") < F.col("a.y") + F.col("a.height"))
    han = F.col("a.text").rlike("[一-鿿]") & F.col("b.text").rlike("[一-鿿]")
    line = row & (gap >= 0) & (gap <= SAME_LINE_GAP * low) & (differ < SAME_LINE_HEIGHT)
    down = F.col("b.y") - (F.col("a.y") + F.col("a.height"))
    nxt = (down >= 0) & (down <= low) & (differ <= F.when(han, NEXT_LINE_HEIGHT[0]).otherwise(NEXT_LINE_HEIGHT[1])) & (F.abs(F.col("a.x") - F.col("b.x")) <= low)
    return p.where(line | nxt).select(F.col("a.image_id").alias("image_id"), F.col("a.block_id").alias("a"), F.col("b.block_id").alias("b"), F.when(line, "line").otherwise("next").alias("how"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with position, from 0: rows from the top, each from the left. Blocks whose heights overlap with a row's first block
    belong to the row."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def order(pages: Iterator[pd.DataFrame]) -> pd.DataFrame:
        page = pages.sort_values(["y", "x", "block_id"], kind="stable").reset_index(drop=True)
        left, out = list(page.index), []
        while left:
            head = left[0]
            bottom = page.y[head] + page.height[head]
            row = [i for i in left if page.y[i] < bottom]
            out += sorted(row, key=lambda i: (page.x[i], page.y[i]))
            left = [i for i in left if i not in set(row)]
        page = page.loc[out].reset_index(drop=True)
        page["position"] = range(len(page))
        return page

    return blocks.groupBy("image_id").applyInPandas(order, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", position int")


def stitched(blocks: DataFrame) -> DataFrame:
    """(image_id, text, starts): blocks joined in reading order. A block that continues the one before it follows after the inline
    gap mark, others after a break; ``starts`` has the offset of each block, so a span can be mapped back."""
    rows = reading_order(usable(blocks)).select("image_id", "block_id", "text", "position")
    w = Window.partitionBy("image_id").orderBy("position")
    rows = rows.withColumn("before", F.lag("block_id").over(w))
    joined = merges(usable(blocks)).select("image_id", F.col("a").alias("before"), F.col("b").alias("block_id"), F.lit(True).alias("joined")).distinct()
    rows = rows.join(joined, ["image_id", "before", "block_id"], "left")
    lead = F.when(F.col("before").isNull(), "").when(F.col("joined"), INLINE_GAP).otherwise(OCR_BREAK)
    rows = rows.withColumn("piece", F.concat(lead, "text")).withColumn("end", F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("position", "piece", "block_id", (F.col("end") - F.length("text")).alias("start"))))
    out = rows.groupBy("image_id").agg(parts.alias("p"))
    return out.select("image_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), F.transform("p", lambda x: F.struct(x["block_id"].alias("block_id"), x["start"].cast("int").alias("start"))).alias("starts"))


def bind_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, label_id, attr_type, value_id): the value block of each label, to its right or else below it, the nearest by score;
    a block that is a label itself is no value. ``labels``: image_id, block_id, attr_type."""
    marked = blocks.join(labels.select("image_id", "block_id", "attr_type"), ["image_id", "block_id"], "left")
    p = _pairs(marked).where(F.col("a.attr_type").isNotNull() & F.col("b.attr_type").isNull())
    row = (F.col("a.y") < F.col("b.y") + F.col("b.height")) & (F.col("b.y") < F.col("a.y") + F.col("a.height"))
    gap = F.col("b.x") - (F.col("a.x") + F.col("a.width"))
    down = F.col("b.y") - (F.col("a.y") + F.col("a.height"))
    tall = F.greatest("a.height", "b.height")
    right, below = row & gap.between(0, 10 * F.col("a.height")), down.between(-2, 4 * tall) & (F.abs(F.col("a.x") - F.col("b.x")) <= 2 * tall)
    score = F.when(right, 1000 - gap).when(below, 500 - down - F.abs(F.col("a.x") - F.col("b.x")))
    best = p.where(right | below).groupBy(F.col("a.image_id").alias("image_id"), F.col("a.block_id").alias("label_id"), F.col("a.attr_type").alias("attr_type")).agg(F.max(F.struct(score.alias("k"), F.col("b.block_id").alias("id")))["id"].alias("value_id"))
    return best


def label_trust(labels: DataFrame) -> DataFrame:
    """``labels`` (image_id, block_id, x, y, height) with ``reason``: null for those that look like the labels of a form, else what drops them: height, x
    (left edge) or rhythm. Each test keeps the densest window, and at least LEAST_LABELS must agree; without so many none of the page is trusted.
    The rhythm is of the gaps between labels that are left, from top to bottom: a label goes if neither of its gaps lies in the densest window of gaps."""
    names = labels.columns

    def dense(rows: DataFrame, x: str, width: int, why: str) -> DataFrame:
        w = Window.partitionBy("image_id").orderBy("_v").rangeBetween(0, width)
        live = rows.where("reason is null").select("image_id", "block_id", F.col(x).cast("long").alias("_v"))
        best = live.withColumn("_n", F.count("*").over(w)).groupBy("image_id").agg(F.max(F.struct("_n", (-F.col("_v")).alias("_l"))).alias("_b")).select("image_id", F.col("_b._n").alias("_n"), (-F.col("_b._l")).alias("_lo"))
        out = rows.join(best, "image_id", "left")
        ok = (F.col("_n") >= LEAST_LABELS) & F.col(x).between(F.col("_lo"), F.col("_lo") + width)
        return out.withColumn("reason", F.when(F.col("reason").isNotNull() | F.coalesce(ok, F.lit(False)), F.col("reason")).otherwise(F.lit(why))).drop("_n", "_lo")

    rows = dense(labels.withColumn("reason", F.lit(None).cast("string")), "height", HEIGHT_WINDOW, "height")
    rows = dense(rows, "x", X_WINDOW, "x")
    order = Window.partitionBy("image_id", F.col("reason").isNull()).orderBy("y", "block_id")
    rows = rows.withColumn("_up", F.when(F.col("reason").isNull(), F.col("y") - F.lag("y").over(order))).withColumn("_down", F.when(F.col("reason").isNull(), F.lead("y").over(order) - F.col("y")))
    gaps = rows.where("_up is not null").select("image_id", "block_id", F.col("_up").cast("long").alias("_g"))
    w = Window.partitionBy("image_id").orderBy("_g").rangeBetween(0, RHYTHM_WINDOW)
    best = gaps.withColumn("_n", F.count("*").over(w)).groupBy("image_id").agg(F.max(F.struct("_n", (-F.col("_g")).alias("_l"))).alias("_b")).select("image_id", F.col("_b._n").alias("_n"), (-F.col("_b._l")).alias("_lo"))
    rows = rows.join(best, "image_id", "left")
    near = lambda c: F.coalesce(F.col(c).between(F.col("_lo"), F.col("_lo") + RHYTHM_WINDOW), F.lit(False))
    steady = F.coalesce(F.col("_n") >= LEAST_LABELS - 1, F.lit(False)) & (near("_up") | near("_down"))
    return rows.withColumn("reason", F.when(F.col("reason").isNotNull() | steady, F.col("reason")).otherwise(F.lit("rhythm"))).select(*names, "reason")


def trusted_labels(labels: DataFrame) -> DataFrame:
    """The labels (image_id, block_id, x, y, height) that look like those of a form."""
    return label_trust(labels).where("reason is null").drop("reason")


CHUNKED = "image_id {kind}, text string, places array<struct<block_id:string,s:int,e:int,raw:array<int>>>"


def chunked(blocks: DataFrame, clean: bool = True) -> DataFrame:
    """(image_id, text, places): each page as one text. Blocks are cleaned and chained: a chunk starts at a block that nothing leads to, goes on to the
    nearest block to the right on its row, and from there below, as far as each is free. The inline gap mark stands between the blocks of a chunk, a
    break between chunks and at both ends. ``places`` has where each block stands and, for each of its characters, its index in the raw text.
    Blank blocks and those without a box are left out. A page is one task's work."""
    from spanveil.functions.ocrtext import clean as cleaned
    from spanveil.functions.ocrtext import repair

    kind = dict(blocks.dtypes)["image_id"]

    def run(page: pd.DataFrame) -> pd.DataFrame:
        items = [(str(r.block_id), r.text, int(r.x), int(r.y), int(r.width), int(r.height)) for r in page.sort_values(["y", "x", "block_id"], kind="stable").itertuples()]
        right, below = {}, {}
        for i, (_, _, x, y, w, h) in enumerate(items):
            row = [(u, j) for j, (_, _, u, v, _, k) in enumerate(items) if j != i and v < y + h and y < v + k and u >= x + w]
            down = [(v, j) for j, (_, _, u, v, _, k) in enumerate(items) if j != i and v >= y + h and abs(u - x) <= max(h, k)]
            if row:
                right[i] = min(row)[1]
            if down:
                below[i] = min(down)[1]
        led = {*right.values(), *below.values()}
        seen: set[int] = set()

        def chain(i: int) -> list[int]:
            out, todo = [], [i]
            while todo:
                j = todo.pop()
                if j in seen:
                    continue
                seen.add(j)
                out.append(j)
                todo += [k for k in (below.get(j), right.get(j)) if k is not None and k not in seen]  # the right one is taken first
            return out

        chunks = [c for c in ([chain(i) for i in range(len(items)) if i not in led] + [chain(i) for i in range(len(items))]) if c]
        text, places = OCR_BREAK, []
        for n, chunk in enumerate(chunks):
            text += OCR_BREAK if n else ""
            for m, i in enumerate(chunk):
                text += INLINE_GAP if m else ""
                got, raw = cleaned(items[i][1]) if clean else (items[i][1], list(range(len(items[i][1]))))
                got = repair(got) if clean else got
                places.append({"block_id": items[i][0], "s": len(text), "e": len(text) + len(got), "raw": raw})
                text += got
        return pd.DataFrame({"image_id": [page.image_id.iloc[0]], "text": [text + OCR_BREAK], "places": [places]})

    return usable(blocks).groupBy("image_id").applyInPandas(run, CHUNKED.format(kind=kind))


def remap(spans: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``spans`` (image_id, s, e, ...) of the text of ``chunked`` with blocks, an array of (block_id, raw_s, raw_e) in the raw texts, and the box around them."""
    names = spans.columns
    rows = spans.withColumn("_id", F.monotonically_increasing_id()).join(pages.select("image_id", "places"), "image_id")
    inside = F.filter("places", lambda p: (p["s"] < F.col("e")) & (F.col("s") < p["e"]))
    at = lambda p, place: F.get(p["raw"], place - p["s"])
    parts = F.transform(inside, lambda p: F.struct(p["block_id"].alias("block_id"), at(p, F.greatest(p["s"], F.col("s"))).alias("raw_s"), (at(p, F.least(p["e"], F.col("e")) - 1) + 1).alias("raw_e")))
    rows = rows.withColumn("blocks", parts).drop("places")
    each = rows.select("_id", "image_id", F.explode("blocks.block_id").alias("block_id")).join(blocks.select("image_id", F.col("block_id").cast("string").alias("block_id"), "x", "y", "width", "height"), ["image_id", "block_id"])
    return rows.join(union_box(each, ["_id"]), "_id", "left").select(*names, "blocks", "x", "y", "width", "height")


def bridged_numbers(pages: DataFrame, key: str = "image_id", text: str = "text") -> DataFrame:
    """(key, s, e, text, check_name): numbers that go over an inline gap and pass a check without it: a phone, identity or card number."""
    from spanveil.functions.spans import find_spans
    from spanveil.functions.validators import only_digits, route

    run = rf"(?<![A-Za-z0-9])\+?[0-9](?:[ \-()]*[0-9])*[ \-()]*{INLINE_GAP}[ \-()]*[0-9](?:[ \-(){INLINE_GAP}]*[0-9])*(?![A-Za-z0-9])"
    rows = pages.select(key, F.col(text).alias("_t")).select(key, F.inline_outer(find_spans(F.col("_t"), run))).where("s is not null")
    digits = only_digits(F.col("text"))
    return rows.withColumn("check_name", route(digits, digits, F.lit("NUM"), F.lit(None).cast("string"))).where("check_name is not null")


def union_box(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all blocks of a key."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return blocks.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"))
