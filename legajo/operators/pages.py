"""Pages, blocks and lines of extracted documents: tables, figures, margins, roles, paragraphs, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.operators.ordered import carried_forward, previous, running_sum

TOP_MARGIN, BOTTOM_MARGIN, REPETITIONS = 72.0, 735.0, 3
TERMINAL = r"[.!?:;»”\")]\s*$"


def summary(pages: DataFrame) -> DataFrame:
    """Counts for each page, repeated deliveries once."""
    return pages.select(
        "document_id", "page_number", F.size("blocks").alias("n_blocks"),
        F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(b["lines"])).alias("n_lines"),
        F.size("tables").alias("n_tables"), F.size("figures").alias("n_figures"), tx.word_count(F.col("text"), "blank").alias("n_words"), "used_ocr",
    ).distinct()


def extraction_method(n_words: Column, used_ocr: Column, fallback_words: Column, least: int = 5) -> Column:
    """Primary text layer; the fallback where the layer has fewer than ``least`` words and the fallback more; recognition last."""
    return (
        F.when(used_ocr, "ocr").when(n_words >= least, "text_layer").when(fallback_words >= least, "fallback").otherwise("empty")
    )


def detected_tables(pages: DataFrame, least_rows: int = 2, least_cells: int = 2) -> DataFrame:
    """Tables of at least so many rows that are not empty and so many filled cells: document, page, table_no, n_rows, n_cells."""
    filled = F.transform("t", lambda row: F.filter(row, lambda c: F.trim(c) != ""))
    rows = F.filter("filled", lambda row: F.size(row) > 0)
    return (
        pages.select("document_id", "page_number", F.posexplode("tables").alias("i", "t"))
        .withColumn("filled", filled)
        .withColumn("rows", rows)
        .select(
            "document_id", "page_number", (F.col("i") + 1).alias("table_no"), F.size("rows").alias("n_rows"),
            F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(r)).alias("n_cells"),
        )
        .where((F.col("n_rows") >= least_rows) & (F.col("n_cells") >= least_cells))
        .distinct()
    )


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection of two boxes [x0, y0, x1, y1] over the smaller area; 0 for an empty box."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    small = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(small > 0, width * height / small).otherwise(F.lit(0.0))


def kept_boxes(boxes: Column, most: float = 0.8) -> Column:
    """Boxes from the largest to the smallest, without those that overlap a kept one by more than ``most``."""
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    largest_first = F.reverse(F.array_sort(F.transform(boxes, lambda b: F.struct(area(b).alias("area"), b.alias("box")))))
    return F.aggregate(
        F.transform(largest_first, lambda s: s["box"]), F.array().cast("array<array<double>>"),
        lambda kept, b: F.when(F.exists(kept, lambda k: overlap_ratio(k, b) > most), kept).otherwise(F.array_append(kept, b)),
    )


def large_figures(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """Figures of at least ``share`` of the page, overlapping ones once: document, page, n_figures, n_kept."""
    boxes = F.filter(F.transform("figures", lambda f: f["bbox"]), lambda b: (b[2] - b[0]) * (b[3] - b[1]) >= share * F.col("width") * F.col("height"))
    return pages.where(F.size("figures") > 0).select(
        "document_id", "page_number", F.size("figures").alias("n_figures"), F.size(kept_boxes(boxes)).alias("n_kept")
    ).distinct()


def lines(pages: DataFrame) -> DataFrame:
    """One row per line with its place, repeated deliveries once."""
    blocks = pages.select("document_id", "page_number", "height", F.posexplode("blocks").alias("block_no", "b"))
    flat = blocks.select("document_id", "page_number", "height", "block_no", F.col("b.block_id").alias("block_id"), F.posexplode("b.lines").alias("line_no", "l"))
    return flat.select(
        "document_id", "page_number", "height", "block_no", "block_id", "line_no", F.col("l.text").alias("text"), F.col("l.size").alias("size"),
        F.col("l.bold").alias("bold"), F.col("l.bbox")[1].alias("y0"),
    ).distinct()


def corrupted_blocks(pages: DataFrame) -> DataFrame:
    """Blocks with control characters: document, page, block_id, n_bad (lines)."""
    bad = F.col("text").rlike(r"[\x00-\x08\x0b-\x1f]")
    return lines(pages).where(bad).groupBy("document_id", "page_number", "block_id").agg(F.count(F.lit(1)).alias("n_bad"))


def repeated_margin_lines(margin: DataFrame, least: int = REPETITIONS) -> DataFrame:
    """document_id, margin_key, n_pages, n_lines of the margin lines that repeat on at least ``least`` pages of a document.

    ``margin`` has document_id, page and text. Pages are counted after a first grouping by page, so that a long document
    does not gather its pages in one place.
    """
    by_page = margin.select("document_id", "page", tx.margin_key(F.col("text")).alias("margin_key")).where("margin_key <> ''")
    by_page = by_page.groupBy("document_id", "margin_key", "page").agg(F.count(F.lit(1)).alias("n"))
    return (
        by_page.groupBy("document_id", "margin_key")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_lines"))
        .where(F.col("n_pages") >= least)
    )


def line_role(size: Column, bold: Column, text: Column) -> Column:
    return (
        F.when((size >= 40) & F.trim(text).rlike("^[0-9]+$"), "number").when(size >= 12, "heading")
        .when(bold & (size >= 10.5), "subheading").otherwise("text")
    )


def role_groups(all_lines: DataFrame) -> DataFrame:
    """Consecutive lines of a block with one role (and one size, for headings): group_no, role, n_lines and the joined length."""
    role = line_role(F.col("size"), F.col("bold"), F.col("text"))
    keyed = all_lines.withColumn("role", role).withColumn("key_size", F.when(F.col("role").isin("heading", "number"), F.col("size")).otherwise(0.0))
    order = Window.partitionBy("document_id", "page_number", "block_no").orderBy("line_no")  # lines of one block
    changed = (F.lag("role").over(order) != F.col("role")) | (F.lag("key_size").over(order) != F.col("key_size"))
    island = F.sum(F.coalesce(changed.cast("int"), F.lit(1))).over(order)
    return (
        keyed.withColumn("group_no", island)
        .groupBy("document_id", "page_number", "block_no", "group_no", "role")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
    )


def joined_lines(texts: Column) -> Column:
    """Lines joined with blanks, and without the hyphen where a word goes on in small letters."""
    trimmed = F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    return F.aggregate(
        F.slice(trimmed, 2, F.greatest(F.size(trimmed) - 1, F.lit(0))), F.coalesce(F.get(trimmed, F.lit(0)), F.lit("")),
        lambda done, t: F.when(done.rlike(r"\p{L}-$") & t.rlike(r"^\p{Ll}"), F.concat(F.substring(done, F.lit(1), F.length(done) - 1), t)).otherwise(
            F.concat(done, F.lit(" "), t)
        ),
    )


def block_texts(pages: DataFrame) -> DataFrame:
    """document, page, block_no and the joined text of every block."""
    blocks = pages.select("document_id", "page_number", F.posexplode("blocks").alias("block_no", "b"))
    return blocks.select("document_id", "page_number", "block_no", joined_lines(F.col("b.lines.text")).alias("text")).distinct()


def body_font(all_lines: DataFrame) -> DataFrame:
    """The font size that holds most characters of each document (the larger among equals)."""
    sizes = all_lines.groupBy("document_id", "size").agg(F.sum(F.length("text")).alias("n_chars"))
    return sizes.groupBy("document_id").agg(F.max_by("size", F.struct("n_chars", "size")).alias("body_size"))


def block_type(text: Column, size: Column, bold: Column) -> Column:
    """Footnote, caption, heading, subheading, list item, quotation or body, the first that holds."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\[[0-9]+\]"), "footnote").when(t.rlike(r"^(Figura|Tabla|Gráfico|Gráfica|Fuente)([^\p{L}]|$)"), "caption")
        .when(size >= 12, "heading").when(bold & (size >= 10.5), "subheading").when(t.rlike(r"^[•●▪◦·–]"), "list_item")
        .when(t.rlike(r"^[“«\"]") & t.rlike(r"[”»\"]$"), "quote").otherwise("body")
    )


ORDER = ["paragraph_id"]


def with_heading(paragraphs: DataFrame) -> DataFrame:
    """Each paragraph with the last heading at or before it in its document (carried across pages)."""
    heading = F.when(F.col("block_type") == "heading", F.col("clean_text"))
    return carried_forward(paragraphs, heading, "heading", ["document_id"], "page", ORDER)


def page_heading(paragraphs: DataFrame) -> DataFrame:
    """document, page and the first heading of the page, wherever on it it stands."""
    at = F.when(F.col("block_type") == "heading", F.struct("paragraph_id", "clean_text"))
    return paragraphs.groupBy("document_id", "page").agg(F.min(at).alias("h")).select("document_id", "page", F.col("h.clean_text").alias("heading"))


def merged_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Body and list paragraphs that go on in the next one of the same section, merged: document, first id, parts, text length.

    parts is an array of (offset, page); a merged text's end is that of its last part, so that looking one row back suffices.
    """
    p = paragraphs.where(F.col("block_type").isin("body", "list_item") & F.col("clean_text").isNotNull())
    p = previous(p, ["clean_text", "section", "block_type"], ["document_id"], "page", ORDER)
    goes_on = (
        F.col("prev_clean_text").isNotNull() & ~F.col("prev_clean_text").rlike(TERMINAL) & F.col("prev_section").eqNullSafe(F.col("section"))
        & (F.col("clean_text").rlike(r"^\p{Ll}") | (F.col("block_type") == "body")) & ~F.col("clean_text").rlike(r"^[•●▪◦·–]")
    )
    p = running_sum(p, F.when(goes_on, 0).otherwise(1), "island", ["document_id"], "page", ORDER)
    parts = F.array_sort(F.collect_list(F.struct("paragraph_id", "page", F.length("clean_text").alias("n"))))
    merged = p.groupBy("document_id", "island").agg(parts.alias("parts"))
    offsets = F.transform("parts", lambda x, i: F.struct((F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda s, y: s + y["n"] + 1)).alias("offset"), x["page"].alias("page")))
    total = F.aggregate("parts", F.lit(-1), lambda s, y: s + y["n"] + 1)
    return merged.select(
        "document_id", F.col("parts")[0]["paragraph_id"].alias("paragraph_id"), F.size("parts").alias("n_parts"), total.alias("n_chars"), offsets.alias("places")
    )


def page_of_offset(places: Column, offset: Column) -> Column:
    """The page of a character: that of the last part that begins at or before it."""
    return F.element_at(F.filter(places, lambda p: p["offset"] <= offset), -1)["page"]


def section_label(*levels: str) -> Column:
    return F.concat_ws(" > ", *[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in levels])


def chapter_changes(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs whose chapter differs from that of the paragraph before in the document."""
    p = previous(paragraphs, ["chapter"], ["document_id"], "page", ORDER)
    return p.where(F.col("prev_chapter").isNotNull() & (F.col("prev_chapter") != F.col("chapter"))).select("document_id", "paragraph_id", "prev_chapter", "chapter")


def longest_prefix(texts: DataFrame, text: str, names: DataFrame, name: str, key: str) -> DataFrame:
    """``key``, the longest of ``names`` that its text begins with (case ignored), and the rest of the text.

    Joined by equality on the first word; the names that share a first word are few.
    """
    first = lambda c: F.lower(F.regexp_extract(c, r"^(\S+)", 1))
    left = texts.select(key, F.col(text).alias("_t"), first(F.col(text)).alias("_w"))
    right = names.select(F.col(name).alias("_n"), first(F.col(name)).alias("_w")).where("_n is not null").distinct()
    hit = left.join(right, "_w").where(F.lower("_t").startswith(F.lower("_n")))
    best = hit.groupBy(key, "_t").agg(F.max_by("_n", F.struct(F.length("_n"), F.col("_n"))).alias("name"))
    return best.select(key, "name", F.regexp_replace(F.expr("substring(_t, length(name) + 1)"), r"^[ :—>-]+|[ :—>-]+$", "").alias("rest"))


def page_chapters(pages: DataFrame, paragraphs: DataFrame, default: str = "none") -> DataFrame:
    """document_id, page and chapter: that of most paragraphs that begin on the page (ties: the first in code-point order), else
    the first of those that end on it, else ``default``. Counted before the joins, so that large documents are no hot keys."""
    told = paragraphs.where(F.col("chapter").isNotNull())
    counts = told.groupBy("document_id", "page", "chapter").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("document_id", "page").agg(F.min_by("chapter", F.struct(-F.col("n"), "chapter")).alias("_main"))
    ending = told.where("page_end is not null").groupBy("document_id", F.col("page_end").alias("page")).agg(F.min("chapter").alias("_ending"))
    joined = pages.join(main, ["document_id", "page"], "left").join(ending, ["document_id", "page"], "left")
    return joined.select("document_id", "page", F.coalesce("_main", "_ending", F.lit(default)).alias("chapter"))


def browsed(paragraphs: DataFrame, chapter: str, section: str | None = None) -> DataFrame:
    """The paragraphs of a chapter (and section) without running titles; paragraphs of unknown type stay."""
    chosen = paragraphs.where((F.col("chapter") == chapter) & (F.coalesce("block_type", F.lit("")) != "running_title"))
    return chosen if section is None else chosen.where(F.col("level2") == section)
