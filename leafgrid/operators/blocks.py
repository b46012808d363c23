"""Block and page projections: from model payloads, annotations and jobs, and to exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as G
from leafgrid.functions import text as T

#: The text inside a seal, and the box that stands for a missing one.
SEAL_TEXT = r"^(?:(?:合同|财务|发票|业务|行政|公司)?专用章|公章)$"
UNIT_BOX = (0, 0, 1, 1)


def unit_box() -> Column:
    return F.array(*map(F.lit, UNIT_BOX))


def coordinate_mode(declared: Column, boxes: Column, width: Column, height: Column, pixel_default: Column) -> Column:
    """pixel or normalized_1000: a known declared name, else pixel evidence (a maximum over 1050 that fits the page), else the default."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in T.COORDINATE_MODES.items() for x in kv]), F.lower(F.trim(F.coalesce(declared, F.lit("")))))

    def beyond(b: Column) -> Column:
        o = G.Box.at(b).ordered()
        return F.coalesce((F.size(b) == 4) & (((o.x2 > 1050) & (o.x2 <= width * 1.05)) | ((o.y2 > 1050) & (o.y2 <= height * 1.05))), F.lit(False))

    default = F.when(pixel_default | F.exists(boxes, beyond), "pixel").otherwise("normalized_1000")
    return F.coalesce(known, default)


def described(kind: Column, *texts: Column) -> Column:
    """First non-empty description for charts and flowcharts, empty for other blocks."""
    return F.when(kind.isin(*T.DESCRIBED_TYPES), F.coalesce(*[T.filled(t) for t in texts], F.lit(""))).otherwise("")


def without_seal_texts(blocks: DataFrame, page: tuple[str, ...] = ("doc", "page_id"), coverage: float = 0.5) -> DataFrame:
    """Drops texts that repeat what a seal says and lie at least half under a seal of their page."""
    seals = blocks.where(F.col("block_type") == "seal").select(*[F.col(c).alias("s_" + c) for c in (*page, "x1", "y1", "x2", "y2")])
    inside = G.coverage(G.Box.named(), G.Box.named("s_")) >= coverage
    stamped = (F.col("block_type") == "text") & T.squeezed(F.col("text")).rlike(SEAL_TEXT)
    on = [F.col(c) == F.col("s_" + c) for c in page]
    for part in (stamped, inside):
        on.append(part)
    return blocks.join(seals, on, "left_anti")


def normalized_page_blocks(payloads: DataFrame) -> DataFrame:
    """Blocks of raw model payloads.

    Input: doc, page_id, width, height (model image), page_width, page_height, pixel_default, declared, and blocks, an array of
    struct(block_type, bbox, text, level, description). Output: one row per valid block, ids numbered over the valid blocks in the payload's order.
    """
    size = (F.col("width"), F.col("height"))
    rows = payloads.withColumn("mode", coordinate_mode(F.col("declared"), F.transform("blocks", lambda b: b["bbox"]), *size, F.col("pixel_default")))
    rows = rows.select("*", F.posexplode("blocks").alias("pos", "b")).withColumn("kind", T.block_type(F.col("b.block_type"), ""))
    rows = rows.where(F.col("kind").isin(*T.BLOCK_TYPES))
    raw = G.Box.at(F.col("b.bbox"))
    by_pixel, by_grid = G.clamped(raw, *size), G.clamped_1000(raw)
    rows = rows.withColumns({"px": F.when(F.size("b.bbox") == 4, by_pixel), "gr": F.when(F.size("b.bbox") == 4, by_grid)})
    pixel = F.col("mode") == "pixel"
    rows = rows.withColumns({
        "bbox_1000": F.when(pixel, G.let(F.col("px"), lambda x: F.when(x.isNotNull(), G.grid_of_pixels(G.Box.of(x), *size)))).otherwise(F.col("gr")),
        "model_bbox": F.when(pixel, F.col("px")).otherwise(G.let(F.col("gr"), lambda x: F.when(x.isNotNull(), G.pixels_of_1000(G.Box.of(x), *size)))),
    }).where("bbox_1000 is not null and model_bbox is not null")
    number = F.row_number().over(Window.partitionBy("doc", "page_id").orderBy("pos")) - 1
    content = G.Box(F.lit(0), F.lit(0), *size)
    bbox = G.let(F.col("model_bbox"), lambda m: G.rescaled(G.Box.of(m), content, F.col("page_width"), F.col("page_height")))
    return rows.select(
        "doc", "page_id", F.format_string("p%03d_b%03d", F.col("page_id"), number).alias("id"), F.col("kind").alias("block_type"), F.coalesce("b.text", F.lit("")).alias("text"),
        bbox.alias("bbox"), "bbox_1000", "model_bbox", described(F.col("kind"), F.col("b.description")).alias("description"),
        T.heading_level(F.col("b.level"), F.col("kind"), F.coalesce("b.text", F.lit(""))).alias("level"),
    )


def in_reading_order(blocks: DataFrame, x: str = "x1", y: str = "y1", tie: str = "pos") -> DataFrame:
    """Adds ord: position by page, top and left edge, then the given tie."""
    order = Window.partitionBy("doc").orderBy("page_id", F.col(y).cast("int"), F.col(x).cast("int"), tie)
    return blocks.withColumn("ord", F.row_number().over(order))


def annotation_block(b: Column, page_id: Column) -> Column:
    """An annotation's view of a block struct (id, bbox, label, block_type, text, description, level, source, modified)."""
    label = T.block_type(F.coalesce(T.filled(b["label"]), b["block_type"]))
    label = F.when(label.isin(*T.BLOCK_TYPES), label).otherwise("text")
    source = F.coalesce(T.filled(b["source"]), F.lit("model"))
    box = F.when(F.size(b["bbox"]) == 4, F.transform(b["bbox"], lambda v: v.cast("int"))).otherwise(unit_box())
    return F.struct(
        b["id"].alias("id"), box.alias("bbox"), label.alias("label"), label.alias("block_type"), F.coalesce(b["text"], F.lit("")).alias("text"), described(label, b["description"]).alias("description"),
        F.coalesce(b["page_id"], page_id).alias("page_id"), source.alias("source"), F.coalesce(b["modified"], source == "manual").alias("modified"), T.stored_level(b["level"], label).alias("level"),
    )


def export_block(b: Column, bbox: Column | None = None) -> Column:
    """A block struct as it goes into training answers."""
    label = T.block_type(F.coalesce(T.filled(b["label"]), b["block_type"]))
    box = F.coalesce(bbox if bbox is not None else F.lit(None), b["bbox"], unit_box())
    return F.struct(
        F.coalesce(b["id"], F.lit("")).alias("id"), F.coalesce(b["text"], F.lit("")).alias("text"), box.alias("bbox"), F.coalesce(b["page_id"], F.lit(0)).alias("page_id"),
        label.alias("block_type"), described(label, b["description"]).alias("description"), T.stored_level(b["level"], label).alias("level"),
    )


def job_block(b: Column) -> Column:
    """A block struct of an annotation as it goes back into its job; unknown labels become text."""
    label = T.block_type(F.coalesce(T.filled(b["label"]), b["block_type"]))

    def put(kind: Column) -> Column:
        return F.struct(
            b["id"].alias("id"), F.coalesce(b["text"], F.lit("")).alias("text"), F.coalesce(b["bbox"], unit_box()).alias("bbox"), F.coalesce(b["page_id"], F.lit(0)).alias("page_id"),
            kind.alias("block_type"), described(kind, b["description"]).alias("description"), T.stored_level(b["level"], kind).alias("level"),
        )

    # In a list of blocks nothing finds common parts of expressions, so the label is made once here.
    return G.let(label, lambda x: G.let(F.when(x.isin(*T.BLOCK_TYPES), x).otherwise("text"), put))


def cli_block(b: Column, index: Column) -> Column:
    """A block struct of the command-line converter: grid box if there is one, else the pixel box, cut to integers; null without a box."""
    box = F.coalesce(F.when(F.size(b["bbox_1000"]) > 0, b["bbox_1000"]), b["bbox"])
    kind = F.when(b["block_type"] == "list", "table_of_contents").otherwise(F.coalesce(T.filled(b["block_type"]), F.lit("text")))
    out = F.struct(
        F.coalesce(T.filled(b["id"]), F.format_string("b%03d", index)).alias("id"), F.coalesce(b["text"], F.lit("")).alias("text"), F.transform(box, lambda v: v.cast("int")).alias("bbox"),
        F.coalesce(b["page_id"], F.lit(0)).alias("page_id"), kind.alias("block_type"), described(kind, b["description"]).alias("description"), T.stored_level(b["level"], b["block_type"]).alias("level"),
    )
    return F.when(F.size(box) == 4, out)


def truth_box(box: Column, width: Column, height: Column) -> Column:
    """Ground-truth export: a pixel box on the 0..1000 grid of its page; null if it is empty before clamping."""
    ordered = G.checked(G.Box.at(box))
    put = lambda c, size: F.least(F.greatest(F.rint(c / size * 1000).cast("int"), F.lit(0)), F.lit(1000))
    b = G.Box.of(ordered)
    return F.when(ordered.isNotNull(), F.array(put(b.x1, width), put(b.y1, height), put(b.x2, width), put(b.y2, height)))


def export_box(b: Column, width: Column, height: Column, model_width: Column, model_height: Column, content: Column, on_model_page: Column) -> Column:
    """Grid box of an export: the block's own grid box, else its pixel box on the page's or the padded model page's grid."""
    sized = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    modelled = on_model_page & (F.coalesce(model_width, F.lit(0)) > 0) & (F.coalesce(model_height, F.lit(0)) > 0)
    whole = F.array(F.lit(0.0), F.lit(0.0), model_width.cast("double"), model_height.cast("double"))
    padding = G.Box.at(F.when(F.size(content) == 4, F.transform(content, lambda v: v.cast("double"))).otherwise(whole)).struct()

    def scaled(px: Column, pad: Column) -> Column:
        p, c = G.Box.of(px), G.Box.of(pad)
        cw, ch = F.greatest(c.x2 - c.x1, F.lit(1.0)), F.greatest(c.y2 - c.y1, F.lit(1.0))
        on_page = p.map(lambda v: v / width * 1000, lambda v: v / height * 1000).struct()
        padded = p.map(lambda v: (c.x1 + v / width * cw) / model_width * 1000, lambda v: (c.y1 + v / height * ch) / model_height * 1000).struct()
        return G.let(F.when(modelled, padded).otherwise(on_page), lambda s: G.clamped_1000(G.Box.of(s)))

    on_grid = G.let(G.clamped(G.Box.at(b["bbox"]), width, height), lambda px: G.let(padding, lambda pad: scaled(px, pad)))
    box = F.when(sized, on_grid).otherwise(G.clamped_1000(G.Box.at(b["bbox"])))
    got = F.coalesce(G.clamped_1000(G.Box.at(b["bbox_1000"])), box)
    return G.let(got, lambda s: F.when(s.isNotNull(), G.Box.of(s).array()).otherwise(unit_box()))


def segment(b: G.Box, width: Column, height: Column) -> Column:
    """A pixel box as left, top, width and height in percent of the page, clamped, three decimals."""
    part = lambda v, size: T.percent(v / size * 100)
    return F.struct(part(b.x1, width).alias("x"), part(b.y1, height).alias("y"), part(b.x2 - b.x1, width).alias("w"), part(b.y2 - b.y1, height).alias("h"))


def to_percent(b: G.Box, width: Column, height: Column) -> Column:
    return b.map(lambda c: c / width * 100, lambda c: c / height * 100).struct()


def from_percent(b: G.Box, width: Column, height: Column) -> Column:
    return b.map(lambda c: (c * width / 100).cast("int"), lambda c: (c * height / 100).cast("int")).struct()


def moved(b: G.Box, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A box shifted as far as the page allows, size kept."""
    w, h = b.x2 - b.x1, b.y2 - b.y1
    x = F.least(F.greatest(b.x1 + dx, F.lit(0)), F.greatest(width - w, F.lit(0)))
    y = F.least(F.greatest(b.y1 + dy, F.lit(0)), F.greatest(height - h, F.lit(0)))
    return G.Box(x, y, x + w, y + h).struct()


def edited(b: Column, fields: list[str]) -> Column:
    """Edit provenance of a block struct (source, modified_fields): fields joined as a set; model blocks become human_verified."""
    source = F.when(b["source"] == "manual", "manual").otherwise("human_verified")
    return F.struct(source.alias("source"), F.lit(True).alias("modified"), F.array_union(F.coalesce(b["modified_fields"], F.array().cast("array<string>")), F.array(*map(F.lit, fields))).alias("modified_fields"))


def resolved_input(candidates: list[Column], page_id: Column, width: Column, height: Column) -> Column:
    """First candidate struct(system, user) with any text, else a reconstructed page text."""
    usable = lambda c: c.isNotNull() & ((F.coalesce(c["system"], F.lit("")) != "") | (F.coalesce(c["user"], F.lit("")) != ""))
    put = lambda c: F.struct(F.coalesce(c["system"], F.lit("")).alias("system"), F.coalesce(c["user"], F.lit("")).alias("user"))
    return F.coalesce(*[F.when(usable(c), put(c)) for c in candidates], F.struct(F.lit("").alias("system"), T.page_text(page_id, width, height).alias("user")))
