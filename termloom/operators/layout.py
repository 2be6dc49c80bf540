"""Documents to pages, sections and subsections, and back to markdown.

Every table carries its order: items by (doc, pos), blocks by (doc, block). Sections, blocks and pages are running sums and
maxima over that order within a document, so documents are independent of each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.similarity import gestalt_ratio, ratio_bound
from termloom.functions.text import anchor, heading_text, is_table_line, normalize, split_words, squeeze, strip

#: Words of an item that a page must hold, as a part of all, and for items under SHORT characters.
OVERLAP, SHORT_OVERLAP, SHORT = 0.6, 0.8, 20


def _upto(*by: str) -> Window:
    return Window.partitionBy("doc", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def items(docs: DataFrame) -> DataFrame:
    """docs (doc, markdown): a row for each line that isn't blank, with section and subsection counters and names.

    "## " begins a section and "### " a subsection; all other lines, other headings too, are text. Lines before the first
    section have section 0; subsections count anew in each section."""
    lines = docs.select("doc", F.posexplode(F.split("markdown", "\n")).alias("pos", "line")).select("doc", "pos", strip(F.col("line")).alias("line")).where("line <> ''")
    level = F.when(F.col("line").startswith("## "), 1).when(F.col("line").startswith("### "), 2)
    own = lines.withColumn("level", level).withColumn("text", F.when(level.isNotNull(), strip(F.substring(F.col("line"), F.when(F.col("level") == 1, 4).otherwise(5), F.length("line")))).otherwise(F.col("line")))
    own = own.withColumn("section", F.sum((F.coalesce("level", F.lit(0)) == 1).cast("int")).over(_upto()).cast("int"))
    name = lambda k, w: F.coalesce(F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(w), F.lit(""))
    own = own.withColumn("section_name", name(1, _upto()))
    own = own.withColumns({"subsection": F.sum((F.coalesce("level", F.lit(0)) == 2).cast("int")).over(_upto("section")).cast("int"), "subsection_name": name(2, _upto("section"))})
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("text")
    return own.select("doc", "pos", kind.alias("type"), "level", F.col("line").alias("content"), "text", "section", "section_name", "subsection", "subsection_name")


def footer_pages(lines: DataFrame) -> DataFrame:
    """lines (doc, pos, is_footer) with page: 1 plus the footers up to the line, its own among them."""
    return lines.withColumn("page", (1 + F.sum(F.col("is_footer").cast("int")).over(_upto())).cast("int"))


def common_footer(footers: DataFrame, least: float = 0.5) -> DataFrame:
    """footer and n: the commonest footer that isn't empty (ties to the first seen), if it makes up `least` of all such."""
    counts = footers.where("footer <> ''").groupBy("footer").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("first")).alias("first"), "footer")).alias("x"))
    return best.where(F.col("x.n") >= least * F.col("all")).select("x.footer", "x.n")


def common_footer_each(footers: DataFrame, least: float = 0.5) -> DataFrame:
    """doc and footer: common_footer of each document's footers (doc, footer, pos)."""
    counts = footers.where("footer <> ''").groupBy("doc", "footer").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("doc").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("first")).alias("first"), "footer")).alias("x"))
    return best.where(F.col("x.n") >= least * F.col("all")).select("doc", "x.footer")


def between_footers(lines: DataFrame, footers: DataFrame) -> DataFrame:
    """lines (doc, pos, content) with page, without those that hold their document's common footer (doc, footer), which part pages."""
    own = lines.join(footers, "doc", "left").withColumn("is_footer", F.coalesce(F.col("content").contains(F.col("footer")), F.lit(False)))
    return footer_pages(own.drop("footer")).where("NOT is_footer").drop("is_footer")


def on_page(norm: Column, page_norm: Column, least: float = OVERLAP) -> Column:
    """Whether a page holds an item: its text, or enough of its distinct words. An item without text is on every page."""
    words, shared = F.array_distinct(split_words(norm)), F.array_intersect(split_words(norm), split_words(page_norm))
    need = F.when(F.length(norm) < SHORT, SHORT_OVERLAP).otherwise(least)
    return page_norm.contains(norm) | (F.size(words) > 0) & (F.size(shared) / F.size(words) >= need)


def align(doc_items: DataFrame, pages: DataFrame) -> DataFrame:
    """items with page: pages (doc, page, text) searched from the last hit on, round to it; then never back. Before the first hit
    it is the document's first page.

    Which pages hold an item is a join; the walk from hit to hit, which depends on what came before, is a fold over one
    document's numbers. Documents with items and without pages are an error."""
    norm = pages.select("doc", "page", normalize(F.col("text")).alias("page_norm"))
    found = doc_items.select("doc", "pos", normalize(F.col("text")).alias("norm")).join(norm, "doc", "left")
    found = found.withColumn("hit", F.when(on_page(F.col("norm"), F.col("page_norm")), F.col("page")))
    hits = found.groupBy("doc", "pos").agg(F.sort_array(F.collect_set("hit")).alias("hits"), F.count("page").alias("n_pages"), F.min("page").alias("least"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        if (rows["n_pages"] == 0).any():
            raise ValueError(f"document {rows['doc'].iloc[0]} has no pages")
        at, out = 0, []
        for own in rows["hits"]:
            if len(own):
                at = min(own, key=lambda p: (p < at, p))  # the first at or after the last hit, else the first of all
            out.append(at or int(rows["least"].min()))
        return rows.assign(found=out)[["doc", "pos", "found"]]

    kind = doc_items.schema["doc"].dataType.simpleString()
    walked = hits.groupBy("doc").applyInPandas(walk, f"doc {kind}, pos int, found int")
    placed = doc_items.join(walked, ["doc", "pos"])
    return placed.withColumn("page", F.max("found").over(_upto())).drop("found")


def blocks(paged: DataFrame) -> DataFrame:
    """Items in runs of one page, section and subsection: doc, block (from 1), page, names, and their content joined."""
    keys = ["page", "section", "subsection"]
    last = Window.partitionBy("doc").orderBy("pos")
    new = reduce_or([~F.col(k).eqNullSafe(F.lag(k).over(last)) for k in keys] + [F.lag("pos").over(last).isNull()])
    shown = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), heading_text(F.col("content")))).otherwise(F.col("content"))
    own = paged.withColumn("_new", new.cast("int")).withColumn("block", F.sum("_new").over(_upto()).cast("int")).withColumn("shown", shown)
    rows = own.groupBy("doc", "block").agg(*(F.max_by(c, "pos").alias(c) for c in ("page", "section", "section_name", "subsection", "subsection_name")), F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("x"))
    return rows.withColumn("content", join_content(F.transform("x", lambda r: r["shown"]))).drop("x")


def reduce_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def join_content(lines: Column) -> Column:
    """Lines joined by a line break between two table rows, and by a blank line elsewhere."""
    n = F.size(lines)
    after = F.transform(lines, lambda x, i: F.when(i + 1 >= n, x).when(is_table_line(x) & is_table_line(F.get(lines, i + 1)), F.concat(x, F.lit("\n"))).otherwise(F.concat(x, F.lit("\n\n"))))
    return F.array_join(after, "")


def ordered_blocks(rows: DataFrame) -> DataFrame:
    """Blocks numbered by page, section and subsection, those equal in all in the order that they had."""
    order = Window.partitionBy("doc").orderBy("page", "section", "subsection", "block")
    return rows.withColumn("n", F.row_number().over(order))


def _rendered(rows: DataFrame, head: Column, lines: Column) -> DataFrame:
    """doc and markdown: head lines and then each block's lines, in order, one below the other."""
    own = rows.withColumn("_lines", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))
    return own.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "_lines"))).alias("x"), F.first(head).alias("head")).select("doc", F.concat(F.col("head"), F.lit("\n"), F.array_join(F.transform("x", lambda r: r["_lines"]), "\n")).alias("markdown"))


def _changes(rows: DataFrame) -> DataFrame:
    """Blocks with what is new in each: its page (which forgets section and subsection), its section, its subsection."""
    before = Window.partitionBy("doc").orderBy("n")
    page = ~F.col("page").eqNullSafe(F.lag("page").over(before)) | (F.col("n") == 1)
    own = rows.withColumn("new_page", page)
    own = own.withColumn("new_section", F.col("new_page") | (F.col("section") != F.lag("section").over(before)))
    return own.withColumn("new_subsection", F.col("new_section") | (F.col("subsection") != F.lag("subsection").over(before)))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def render_simple(rows: DataFrame) -> DataFrame:
    """Page marks and contents."""
    new, page = F.col("new_page"), F.col("page").cast("string")
    mark = F.when(new & (F.col("n") > 1), "---\n"), F.when(new, _text("Page ", page, "\n\n---"))
    return _rendered(_changes(rows), F.lit("# Document Content\n"), F.array(*mark, F.col("content"), F.lit("\n")))


def render_detailed(rows: DataFrame) -> DataFrame:
    """Numbered blocks with their figures in a fence."""
    new, page = F.col("new_page"), F.col("page").cast("string")
    mark = F.when(new & (F.col("n") > 1), "---"), F.when(new, _text("Page ", page, "\n---"))
    box = _text("\n## Block ", F.col("n").cast("string"), "\n```\nPage: ", page, "\nSection: ", F.col("section").cast("string"), " - ", F.col("section_name"), "\nSubsection: ", F.col("subsection").cast("string"), " - ", F.col("subsection_name"), "\n```\n")
    head = F.lit("# Document Content (Detailed View)\n\n*This view shows the complete structure with metadata*\n")
    return _rendered(_changes(rows), head, F.array(*mark, box, F.col("content"), F.lit("\n---\n")))


def _headed(section: Column) -> list[Column]:
    """Marks of new pages, sections and subsections."""
    new, page, sub = F.col("new_page"), F.col("page").cast("string"), F.col("subsection").cast("string")
    return [
        F.when(new & (F.col("n") > 1), "---"),
        F.when(new, _text("Page ", page, "\n---")),
        F.when(F.col("new_section") & (F.col("section_name") != ""), _text("\n# ", F.col("section_name"), "\n", section)),
        F.when(F.col("new_subsection") & (F.col("subsection_name") != ""), _text("\n## ", F.col("subsection_name"), "\n*Subsection ", sub, " | Page ", page, "*\n")),
    ]


def render_structured(rows: DataFrame) -> DataFrame:
    """Headings of sections and subsections, again after each new page; blocks without a subsection name their page."""
    where = F.when(F.col("subsection_name") == "", _text("\n*Page ", F.col("page").cast("string"), "*\n"))
    section = _text("*Section ", F.col("section").cast("string"), "*\n")
    return _rendered(_changes(rows), F.lit("# Document Content (Structured View)\n"), F.array(*_headed(section), where, F.col("content"), F.lit("\n")))


def contents(rows: DataFrame) -> DataFrame:
    """doc and toc: the lines of a table of contents. Sections come in the order first seen, under each its subsections by
    theirs; every block's subsection counts, of sections without a name it is left out."""
    s = rows.where("section > 0 AND section_name <> ''").groupBy("doc", "section", "section_name").agg(F.min("n").alias("n"), F.min_by("page", "n").alias("page"))
    first = s.groupBy("doc", "section").agg(F.min("n").alias("sn"))
    sub = rows.where("section > 0 AND subsection > 0 AND subsection_name <> ''").groupBy("doc", "section", "subsection", "subsection_name").agg(F.min("n").alias("n"), F.min_by("page", "n").alias("page"))
    number = F.concat(F.lit("- ["), F.col("section").cast("string"), F.lit(". "))
    top = s.select("doc", F.col("n").alias("sn"), F.lit(0).alias("n"), F.concat(number, F.col("section_name"), F.lit("](#"), anchor(F.col("section_name")), F.lit(") (Page "), F.col("page").cast("string"), F.lit(")")).alias("line"))
    below = sub.join(first, ["doc", "section"]).select("doc", "sn", "n", F.concat(F.lit("  - ["), F.col("section").cast("string"), F.lit("."), F.col("subsection").cast("string"), F.lit(". "), F.col("subsection_name"), F.lit("](#"), anchor(F.col("subsection_name")), F.lit(") (Page "), F.col("page").cast("string"), F.lit(")")).alias("line"))
    lines = top.unionByName(below).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sn", "n", "line"))).alias("x"))
    return lines.select("doc", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("toc"))


def render_toc(rows: DataFrame) -> DataFrame:
    """A table of contents with links, and the blocks below their headings."""
    toc = F.when(F.col("toc").isNull(), F.lit("")).otherwise(F.concat(F.col("toc"), F.lit("\n")))
    head = F.concat(F.lit("# Document Content\n\n## Table of Contents\n\n"), toc, F.lit("\n---\n"))
    section = _text("*Section ", F.col("section").cast("string"), " | Page ", F.col("page").cast("string"), "*\n")
    return _rendered(_changes(rows).join(contents(rows), "doc", "left"), head, F.array(*_headed(section), F.col("content")))


RENDERERS = {"simple": render_simple, "detailed": render_detailed, "structured": render_structured, "toc": render_toc}


def render_all(rows: DataFrame) -> DataFrame:
    """doc, format and markdown of all four renderings, each under a name of its own."""
    parts = [f(rows).select("doc", F.lit(k).alias("format"), "markdown") for k, f in RENDERERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extract(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The blocks of documents (doc, markdown) whose pages (doc, page, text) are known: items, their pages, and runs of them."""
    return blocks(align(items(docs), pages))


def page_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page").agg(F.count("*").alias("n_blocks")).orderBy("page")


def resolve_headings(lines: DataFrame, headings: DataFrame, least: float = 0.85) -> DataFrame:
    """lines (doc, pos, text) with the heading that each is, null if none: ord, level, section and section_name.

    headings: doc, ord, name, level, section, section_name. A line is the heading of the same squeezed text, else the first by
    ord whose ratio to it is over `least`. Only lines and headings whose lengths allow such a ratio are compared."""
    named = headings.select("doc", "ord", "level", "section", "section_name", squeeze(F.col("name")).alias("key")).where("key <> ''")
    own = lines.withColumn("line_key", squeeze(F.col("text")))
    exact = named.groupBy("doc", F.col("key").alias("line_key")).agg(F.min("ord").alias("ord"))
    hit = own.join(exact, ["doc", "line_key"]).select("doc", "pos", "ord")
    rest = own.join(hit, ["doc", "pos"], "left_anti").where("line_key <> ''")
    texts = rest.select("doc", "line_key").distinct().join(named.select("doc", "ord", "key"), "doc").where(ratio_bound(F.col("line_key"), F.col("key")) > least)
    near = texts.where(gestalt_ratio(F.col("line_key"), F.col("key")) > least).groupBy("doc", "line_key").agg(F.min("ord").alias("ord"))
    found = hit.unionByName(rest.join(near, ["doc", "line_key"]).select("doc", "pos", "ord"))
    return lines.join(found, ["doc", "pos"], "left").join(named.drop("key"), ["doc", "ord"], "left")


def paragraphs(resolved: DataFrame) -> DataFrame:
    """Items of resolved lines (doc, pos, page, text, level, section, section_name): a heading each, and the lines between
    headings joined by a blank, page by page. A heading of level 1 takes its section from the list, one of level 2 counts as a
    subsection, others leave both as they are."""
    own = resolved.where(strip(F.col("text")) != "").withColumn("text", strip(F.col("text")))
    top = F.col("level") == 1
    current = lambda c, d: F.coalesce(F.last(F.when(top, F.col(c)), ignorenulls=True).over(_upto()), F.lit(d))
    own = own.withColumns({"_part": F.sum(F.coalesce(top, F.lit(False)).cast("int")).over(_upto()), "_section": current("section", 0), "_section_name": current("section_name", "")})
    own = own.withColumns({"subsection": F.sum((F.coalesce("level", F.lit(0)) == 2).cast("int")).over(_upto("_part")).cast("int"), "subsection_name": F.coalesce(F.last(F.when(F.col("level") == 2, F.col("text")), ignorenulls=True).over(_upto("_part")), F.lit(""))})
    last = Window.partitionBy("doc").orderBy("pos")
    new = F.col("level").isNotNull() | F.lag("level").over(last).isNotNull() | ~F.col("page").eqNullSafe(F.lag("page").over(last))
    own = own.withColumn("_new", new.cast("int")).withColumn("_item", F.sum("_new").over(_upto()))
    rows = own.groupBy("doc", "_item").agg(F.min("pos").alias("pos"), F.max("page").alias("page"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"), *(F.max(a).alias(b) for a, b in (("_section", "section"), ("_section_name", "section_name"), ("subsection", "subsection"), ("subsection_name", "subsection_name"))))
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("text")
    return rows.select("doc", "pos", "page", kind.alias("type"), "level", F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("content"), "section", "section_name", "subsection", "subsection_name")


def page_blocks(paged: DataFrame) -> DataFrame:
    """Items in runs of one section and subsection within a page; contents are joined by blank lines."""
    by_page = Window.partitionBy("doc", "page").orderBy("pos")
    new = F.lag("pos").over(by_page).isNull() | (F.col("section") != F.lag("section").over(by_page)) | (F.col("subsection") != F.lag("subsection").over(by_page))
    own = paged.withColumn("_new", new.cast("int")).withColumn("block", F.sum("_new").over(by_page.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = own.groupBy("doc", "page", "block").agg(*(F.max_by(c, "pos").alias(c) for c in ("section", "section_name", "subsection", "subsection_name")), F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("x"))
    return rows.withColumn("content", F.array_join(F.transform("x", lambda r: r["content"]), "\n\n")).drop("x")
