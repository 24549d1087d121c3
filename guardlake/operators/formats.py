"""HTML, Markdown and JSON cleaning as jobs over token and line tables.

A page becomes rows of tokens in order, a document rows of lines; state that a parser would carry (depth,
hidden subtree, code fence, HTML block) is a running count over the rows of one page.
"""

from __future__ import annotations

import html as entities
import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.steps import written
from guardlake.functions.text import CSS_COMMENT, HIDDEN_KEYWORD, OPACITY, is_hidden_style, strip_categories, strip_counts, strip_invisible

# Elements that break lines, that have no content, and that never show.
BLOCK = "address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
DROPPED = "script style template noscript title meta".split()
RAW = "script|style|title"
TAG = r"""</?[A-Za-z](?:"[^"]*+"|'[^']*+'|[^"'>])*+>"""
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({RAW})\b(?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+>.*?(?:</\1\s*>|\z)|<[!?][^>]*+(?:>|\z)|{TAG}|[^<]++|<"


def _attr(token, name: str):
    """The value of an attribute, '' if it has none; null if it is absent."""
    pattern = rf"""(?is)\s{name}(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/>]))"""
    value = F.concat(*[F.regexp_extract(token, pattern, i) for i in (1, 2, 3)])
    return F.when(token.rlike(pattern), value)


def html_tokens(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, pos, token, kind (comment, raw, markup, open, close, void, text), tag and the attributes that matter."""
    rows = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    t = F.col("token")
    tag = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    void = tag.isin(VOID) | t.endswith("/>")
    kind = (
        F.when(t.startswith("<!--"), "comment").when(t.rlike(rf"(?is)^<(?:{RAW})\b"), "raw").when(t.rlike("^<[!?]"), "markup")
        .when(t.rlike("^</[A-Za-z]"), "close").when(t.rlike("^<[A-Za-z]") & void, "void").when(t.rlike("^<[A-Za-z]"), "open").otherwise("text")
    )
    rows = rows.withColumns({"kind": kind, "tag": F.when(tag != "", tag)})
    marked = F.col("kind").isin("open", "void", "raw")
    return rows.withColumns({n: F.when(marked, _attr(t, a)) for n, a in (("hidden", "hidden"), ("style", "style"), ("cls", "class"), ("aria", "aria-label"), ("title", "title"), ("alt", "alt"))})


def hidden_classes(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct (id, cls) of classes in the selectors of rules that hide."""
    css = F.regexp_replace(F.array_join(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<style\b[^>]*>(.*?)(?:</style\s*>|\z)"), F.lit(1)), "\n"), CSS_COMMENT, "")
    rules = pages.select(id_col, F.explode(F.regexp_extract_all(css, F.lit(r"[^{}]+\{[^{}]*\}"), F.lit(0))).alias("rule"))
    block = F.regexp_extract("rule", r"\{([^{}]*)\}", 1)
    zero = F.exists(F.regexp_extract_all(block, F.lit(OPACITY), F.lit(1)), lambda x: F.coalesce(x.try_cast("double") == 0, F.lit(False)))
    hiding = rules.filter(block.rlike(HIDDEN_KEYWORD) | zero)
    names = F.regexp_extract_all(F.regexp_extract("rule", r"^([^{}]+)\{", 1), F.lit(r"\.((?:[A-Za-z0-9_-]|\\.)+)"), F.lit(1))
    return hiding.select(id_col, F.explode(names).alias("cls")).select(id_col, F.regexp_replace("cls", r"\\(.)", "$1").alias("cls")).distinct()


def hidden_tokens(tokens: DataFrame, classes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """tokens with drop (inside or at a hidden subtree) and why, at the token that opens an outermost one.

    An opener pairs with the first later close of its tag at its own depth; without one it reaches the page's end.
    """
    listed = tokens.filter("cls is not null and cls <> ''").select(id_col, "pos", F.explode(F.split(F.trim("cls"), r"\s+")).alias("cls"))
    by_class = listed.join(classes, [id_col, "cls"], "left_semi").select(id_col, "pos").distinct().withColumn("by_class", F.lit(True))
    rows = tokens.join(by_class, [id_col, "pos"], "left")
    opener = F.col("kind").isin("open", "void", "raw")
    why = (
        F.when(opener & F.col("tag").isin(DROPPED), F.col("tag")).when(opener & F.col("hidden").isNotNull(), "hidden-attr")
        .when(opener & is_hidden_style(F.coalesce("style", F.lit(""))), F.concat(F.lit("hidden-style-"), F.col("tag"))).when(opener & F.coalesce("by_class", F.lit(False)), F.concat(F.lit("hidden-class-"), F.col("tag")))
    )
    in_tag = Window.partitionBy(id_col, "tag").orderBy("pos")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = rows.withColumns({"why": why, "step": step})
    rows = rows.withColumn("level", F.sum("step").over(in_tag.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("kind") == "close", 1).otherwise(0))
    paired = Window.partitionBy(id_col, "tag", "level", F.col("step") != 0).orderBy("pos")
    ends = F.when(F.col("kind") == "open", F.coalesce(F.lead("pos").over(paired), F.lit(2**31 - 1))).otherwise(F.col("pos"))
    rows = rows.withColumn("until", F.when(F.col("why").isNotNull(), ends))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.coalesce(F.max("until").over(before), F.lit(-1)))
    inside = F.col("pos") <= F.col("reach")
    return rows.withColumns({"drop": inside | F.col("why").isNotNull(), "why": F.when(~inside, F.col("why"))}).drop("by_class", "step", "level", "until", "reach")


_OPEN, _CLOSE = "", ""


def visible_text(tokens: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, text: text tokens that are not dropped, with newlines around block elements, entities decoded."""
    block = F.col("tag").isin(BLOCK)
    piece = (
        F.when(F.col("kind") == "text", F.col("token")).when(block & (F.col("kind") == "void"), F.lit(_OPEN + _CLOSE))
        .when(block & (F.col("kind") == "open"), F.lit(_OPEN)).when(block & (F.col("kind") == "close"), F.lit(_CLOSE))
    )
    pieces = tokens.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(~F.col("drop") & piece.isNotNull(), F.struct("pos", piece.alias("piece"))))).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    # the first break of nothing is none on entry and one on exit; breaks next to each other or to a newline are one
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, f"^{_OPEN}+", ""), f"\n?[{_OPEN}{_CLOSE}]+", "\n"), "\x00", "")
    out = pieces.select(id_col, text.alias("text"))
    return _decoded(out.filter(F.col("text").contains("&")), id_col).unionByName(out.filter(~F.col("text").contains("&")))


def _decoded(df: DataFrame, id_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([entities.unescape(t) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return df.mapInArrow(run, df.schema)


def attr_signals(tokens: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, kind, n: comments, and visible elements with attributes that carry text."""
    shown = tokens.filter(~F.col("drop"))
    opener = F.col("kind").isin("open", "void")
    kinds = F.array_compact(F.array(
        F.when(F.col("kind") == "comment", F.lit("comment")), F.when(opener & F.col("aria").isNotNull(), F.lit("aria-label")),
        F.when(opener & F.col("title").isNotNull(), F.lit("title-attr")), F.when(opener & F.col("alt").isNotNull() & (F.col("tag") != "img"), F.lit("alt-non-img")),
    ))
    return shown.select(id_col, F.explode(kinds).alias("signal")).groupBy(id_col, "signal").agg(F.count("*").alias("n"))


def stripped_elements(tokens: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, element, n: outermost hidden subtrees by kind."""
    return tokens.filter("why is not null").groupBy(id_col, F.col("why").alias("element")).agg(F.count("*").alias("n"))


def clean_html(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, text, stripped (map of element to count) of every page. Tokens are made and written once, with what the jobs after them read."""
    tokens = hidden_tokens(html_tokens(pages, id_col, html), hidden_classes(pages, id_col, html), id_col)
    shown = F.when(~F.col("drop") & (F.col("kind") == "text"), F.col("token")).alias("token")
    tokens = written(tokens.select(id_col, "pos", "kind", "tag", "drop", "why", "aria", "title", "alt", shown), "html-tokens")
    counts = stripped_elements(tokens, id_col).unionByName(attr_signals(tokens, id_col).withColumnRenamed("signal", "element"))
    counts = counts.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element", "n")))).alias("stripped"))
    return pages.select(id_col).join(visible_text(tokens, id_col), id_col, "left").join(counts, id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))


# Markdown


def markdown_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, line_no, line, fence (a fence marker), in_code (a fence or between two)."""
    rows = docs.select(id_col, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    marker = F.col("line").rlike(r"^ {0,3}(?:```|~~~)")
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fence", marker).withColumn("fences", F.sum(F.col("fence").cast("int")).over(w))
    return rows.withColumn("in_code", F.col("fence") | (F.col("fences") % 2 == 1)).drop("fences")


_INLINE = r"</?[A-Za-z][^<>]*>"
_COMMENT = r"<!--.*?-->"


def markdown_strip(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lines with kept (null for lines of HTML blocks) and counts of blocks, inline tags and comments.

    A block is a run of lines from one that begins with a tag to the next blank line, outside fences.
    """
    w = Window.partitionBy(id_col).orderBy("line_no")
    begins = ~F.col("in_code") & F.col("line").rlike(r"^ {0,3}</?[A-Za-z][^<>]*>?\s*")
    ends = F.col("in_code") | (F.trim("line") == "")
    rows = lines.withColumn("part", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(begins, F.col("line_no"))).over(Window.partitionBy(id_col, "part"))
    rows = rows.withColumn("block_from", first)
    in_block = ~F.col("in_code") & (F.trim("line") != "") & F.coalesce(F.col("line_no") >= F.col("block_from"), F.lit(False))
    no_comment = F.regexp_replace("line", _COMMENT, "")
    free = ~F.col("in_code") & ~in_block
    return rows.select(
        id_col, "line_no", "line", "in_code", F.when(F.col("in_code"), F.col("line")).when(~in_block, F.regexp_replace(no_comment, _INLINE, "")).alias("kept"),
        (in_block & (F.col("line_no") == F.col("block_from"))).cast("int").alias("html_block"),
        F.when(free, F.regexp_count(no_comment, F.lit(_INLINE))).otherwise(0).alias("inline"), F.when(free, F.regexp_count("line", F.lit(_COMMENT))).otherwise(0).alias("comment"),
    )


def markdown_escape(lines: DataFrame) -> DataFrame:
    """kept with '&', '<' and '>' escaped outside code, after the four common entities are decoded."""
    plain = F.col("kept")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        plain = F.replace(plain, F.lit(char), F.lit(entity))
    return lines.withColumn("kept", F.when(F.col("in_code"), F.col("kept")).otherwise(plain))


def clean_markdown(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text and counts of every document."""
    lines = markdown_escape(markdown_strip(markdown_lines(docs, id_col, text), id_col))
    return lines.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("line_no", "kept")))), lambda x: x["kept"]), "\n").alias("text"),
        F.sum("html_block").alias("html_block"), F.sum("inline").alias("inline"), F.sum("comment").alias("comment"),
    )


# JSON


def normalize_json_flat(df: DataFrame, col: str = "props") -> DataFrame:
    """df with cleaned (sorted pairs of a flat object, keys and values without invisible characters; of colliding keys
    the last in raw key order wins), collisions and stripped_count."""
    pairs = F.array_sort(F.map_entries(F.from_json(col, "map<string,string>", {"allowUnquotedControlChars": "true"})))
    clean = F.transform(pairs, lambda p: F.struct(strip_invisible(p["key"]).alias("key"), strip_invisible(p["value"]).alias("value")))
    keys = F.array_distinct(F.transform(clean, lambda p: p["key"]))
    last = F.transform(F.array_sort(keys), lambda k: F.element_at(F.filter(clean, lambda p: p["key"] == k), -1))
    count = F.aggregate(pairs, F.lit(0), lambda n, p: n + strip_counts(p["key"])["total"] + F.coalesce(strip_counts(p["value"])["total"], F.lit(0)))
    return df.withColumns({"cleaned": last, "collisions": F.size(clean) - F.size(keys), "stripped_count": count})


def normalize_json(df: DataFrame, id_col: str, col: str, max_depth: int = 64) -> DataFrame:
    """id, cleaned (compact, keys sorted), collisions, stripped_count, categories, error (JsonParse, JsonTooDeep) of JSON of any nesting."""
    import re

    from guardlake.functions.text import INVISIBLE

    invisible = re.compile("[" + "".join(INVISIBLE.values()) + "]")

    def one(text):
        counts, marked = [0, 0], []

        def clean(s):
            n = len(invisible.findall(s))
            counts[1] += n
            if n or not s.isascii():
                marked.append(s)
            return invisible.sub("", s)

        def walk(x, depth):
            if depth > max_depth:
                raise RecursionError
            if isinstance(x, dict):
                out = {}
                for k in sorted(x):
                    new = clean(k)
                    counts[0] += new in out
                    out[new] = walk(x[k], depth + 1)
                return dict(sorted(out.items()))
            return [walk(v, depth + 1) for v in x] if isinstance(x, list) else clean(x) if isinstance(x, str) else x

        def refuse(constant):
            raise ValueError(constant)

        def finite(number):
            value = float(number)
            return value if math.isfinite(value) else refuse(number)

        try:
            out = json.dumps(walk(json.loads(text, parse_constant=refuse, parse_float=finite), 0), separators=(",", ":"), ensure_ascii=False)
            "".join([out, *marked]).encode()  # a lone surrogate is no text
            return out, *counts, marked, None
        except RecursionError:
            return None, 0, 0, [], "JsonTooDeep"
        except (ValueError, TypeError):
            return None, 0, 0, [], "JsonParse"

    source = df.select(id_col, F.col(col).alias("_json"))
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, cleaned string, collisions int, stripped_count int, marked array<string>, error string"

    def run(batches):
        for batch in batches:
            rows = list(zip(*map(one, batch.column(1).to_pylist()))) or [[], [], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)], names=[id_col, "cleaned", "collisions", "stripped_count", "marked", "error"])

    met = F.array_distinct(F.flatten(F.transform("marked", strip_categories)))
    return source.mapInArrow(run, schema).select(id_col, "cleaned", "collisions", "stripped_count", met.alias("categories"), "error")
