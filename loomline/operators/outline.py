"""The map of a document: pages, numbered headings as a tree, tables of contents and table rows, with offsets into the text.

One pass over a document's lines in order, as window functions: a line's page is that of the last marker, its section the
number of headings so far. A document is the largest piece of work. Nothing is copied: offsets say where a section lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = r"^\s*\[Page (\d{1,6})\]\s*$"
HEADING = r"^\s*(\d{1,3}(?:\.\d{1,3})*)[.)]?\s+([A-Z][^.]{2,80})$"
CONTENTS = r"\.{4,}\s*\d+\s*$"
ROW = r"^[^\t|]+(?:[\t|][^\t|]+)+$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, length, text, kind, page, section, num, title): offsets count characters from 0.

    Kinds: page, contents, heading, row, text and empty, the first that fits. Pages are 1 before the first marker;
    section 0 is what stands before the first heading. Null texts have no lines.
    """
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    order = Window.partitionBy("doc_id").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("text")
    kind = F.when(c.rlike(PAGE), "page").when(c.rlike(CONTENTS), "contents").when(c.rlike(HEADING), "heading").when(c.rlike(ROW), "row").when(F.trim(c) == "", "empty").otherwise("text")
    told = each.select("*", F.char_length("text").alias("length"), kind.alias("kind"))
    head = F.col("kind") == "heading"
    marker = F.when(F.col("kind") == "page", F.regexp_extract("text", PAGE, 1).cast("int"))
    told = told.withColumns({"start": F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)), "page": F.coalesce(F.last(marker, ignorenulls=True).over(order), F.lit(1)), "section": F.count_if(head).over(order)})
    return told.withColumns({"num": F.when(head, F.regexp_extract("text", HEADING, 1)), "title": F.when(head, F.trim(F.regexp_extract("text", HEADING, 2)))})


def document_map(docs: DataFrame) -> DataFrame:
    """(doc_id, section, num, title, level, parent, page_start, page_end, start, end, n_rows, n_contents, n_text) per section.

    ``parent`` is the section of the last heading before whose number is this one's without its last part. A section
    reaches from its heading to the end of its last line; sections without a heading have a null number.
    """
    told = lines(docs)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    body = F.col("kind") != "page"
    each = told.groupBy("doc_id", "section").agg(F.max("num").alias("num"), F.max("title").alias("title"), F.min(F.when(body, F.col("page"))).alias("page_start"), F.max(F.when(body, F.col("page"))).alias("page_end"), F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), count("row").alias("n_rows"), count("contents").alias("n_contents"), count("text").alias("n_text"))
    above = F.when(F.col("num").contains("."), F.regexp_replace("num", r"\.\d+$", ""))
    each = each.withColumn("level", F.when(F.col("num").isNotNull(), F.size(F.split("num", r"\.")))).withColumn("_above", above)
    heads = each.where("num IS NOT NULL").select("doc_id", F.col("num").alias("_num"), F.col("section").alias("_section"))
    inner = each.where("_above IS NOT NULL").select("doc_id", "section", "_above")
    tree = inner.join(heads, (inner["doc_id"] == heads["doc_id"]) & (inner["_above"] == heads["_num"]) & (heads["_section"] < inner["section"]))
    tree = tree.groupBy(inner["doc_id"], inner["section"]).agg(F.max("_section").alias("parent"))
    return each.join(tree, ["doc_id", "section"], "left").select("doc_id", "section", "num", "title", "level", "parent", "page_start", "page_end", "start", "end", "n_rows", "n_contents", "n_text")
