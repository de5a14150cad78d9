"""Main text of web pages by template deduction over occurrence vectors.

The tokens of a page are its tags (with class, id and role) and its text blocks. Tokens of
one host that occur equally often on every page form an equivalence class: their occurrence
vectors over all pages of the host are equal. Vectors are never built; a token's vector is
known by a combination of hashes of (page, count) that map tasks add up, with the number of
pages and of occurrences. Three passes over the pages:

1. occurrence vectors; classes that cover nearly all pages of a host are candidates;
2. a class is valid if its tokens come in the same order on all pages and, against the
   host's root class (tokens that occur once on each page), always in the same slots. Valid
   classes nest into the template: the root's tokens bound the slots, the others fill them;
3. the text that template tokens do not account for is read from the slots that hold the
   article. A slot's role comes from the elements that enclose it and, where a host has no
   article element, from how much of its text is links, summed over all its pages.

A host's template is a row of token hashes. It is joined to the pages by host, as a
broadcast only if the planner finds the written templates small enough.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import text_of
from opsight.scratch import materialize

# Element names of HTML by role.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = set("script style noscript template textarea title iframe svg math object select option video audio canvas".split())
PLAIN = set("script style textarea title iframe xmp noembed noframes".split())  # of these, raw to their own end tag
LEFT_OUT = set("head nav footer aside form button dialog menu fieldset".split())
CONTENT = {"article", "main"}
HOLDERS = LEFT_OUT | CONTENT | {"header", "div", "section", "ul", "ol", "dl", "table", "figure", "details", "body", "html"}
# Words of class, id and role that mark what is not the article.
MARKS = set(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar widget menu nav "
    "navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus "
    "discussion share sharing social related recommended recommendations login search searchbox toolbar pager "
    "pagination skip legal copyright contentinfo complementary dialog".split()
)
# a quoted attribute value may hold ">"; a quote that is never closed is an ordinary character
_TAG = r"""</?[a-zA-Z][^\s/>]*+(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+(?:>|\Z)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|{_TAG}|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def marked(tag: str) -> bool:
    """Whether class, id or role of a tag say that it does not hold the article."""
    for _, a, b, c in _MARKED.findall(tag):
        for name in (a or b or c).lower().split():
            parts = _SPLIT.split(name)
            if parts[0] not in ("has", "with", "no", "without", "is") and MARKS & set(parts):
                return True
    return False


class Text:
    """A text block: its words, link characters, and whether it lies in an article or in something left out."""

    __slots__ = ("text", "links", "inside", "out")

    def __init__(self, text: str, links: int, inside: bool, out: bool):
        self.text, self.links, self.inside, self.out = text, links, inside, out


def parse(page: str) -> list[str | Text]:
    """The tokens of a page: tags as strings, text blocks as ``Text``."""
    tokens: list[str | Text] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    links = 0
    in_link = False
    skip = muted = ""

    def flush() -> None:
        nonlocal links
        words = " ".join("".join(parts).split())
        parts.clear()
        if words:
            _, inside, out = stack[-1] if stack else ("", False, False)
            tokens.append(Text(words, links, inside, out or bool(muted)))
        links = 0

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        raw = m.group()
        if raw[0] != "<" or raw == "<":
            if not skip:
                decoded = html.unescape(raw)
                parts.append(decoded)
                links += len(decoded) * in_link
            continue
        named = _NAME.match(raw)
        if not named:
            continue
        name, closing = named.group(1).lower(), raw[1] == "/"
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        if name in INLINE:
            in_link = (in_link or not closing) if name == "a" and not closing else (in_link and name != "a")
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        in_link = False
        if name == muted or name in HOLDERS:
            muted = ""  # a marked paragraph or other block ends with its tag, the next of its kind or its holder
        if not closing and name not in HOLDERS and name not in RAW and marked(raw):
            muted = name
        marks = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in _MARKED.findall(raw)) if not closing else ""
        tokens.append(f"</{name}>" if closing else f"<{name} {marks}>")
        if name in PLAIN and not closing:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif name in RAW and not closing and not raw.endswith("/>"):
            skip = name
        elif name in HOLDERS:
            if closing:
                open_ = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
                if open_ >= 0:
                    del stack[open_:]
            elif not raw.endswith("/>"):
                _, inside, out = stack[-1] if stack else ("", False, False)
                if name in ("html", "body"):
                    stack = [x for x in stack if x[0] in ("html", "body")]
                    out = False
                out = out or name in LEFT_OUT or (name == "header" and not inside)
                if name not in ("html", "body", "main"):
                    out = out or marked(raw)
                stack.append((name, (inside or name in CONTENT) and not out, out))
    flush()
    return tokens


def token_hash(token: str | Text) -> int:
    raw = token if isinstance(token, str) else "\0" + token.text
    return int.from_bytes(hashlib.blake2b(raw.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def body_hash(parsed: list[str | Text]) -> int:
    """What tells copies of a page: its longest text block, of those in an article if there are any."""
    blocks = [t for t in parsed if isinstance(t, Text)]
    best = max(blocks, key=lambda t: (t.inside, not t.out, len(t.text), t.text), default=None)
    return token_hash(best) if best is not None else 0


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """body, host, token, count of every page's tokens; token 0 stands for the page itself."""
    for batch in batches:
        rows: list[tuple] = []
        for host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parsed = parse(text)
            body = body_hash(parsed)
            rows.append((body, host, 0, 1))
            rows += [(body, host, k, n) for k, n in Counter(map(token_hash, parsed)).items()]
        yield _batch(rows, [pa.int64(), pa.string(), pa.int64(), pa.int64()], ["_body", "_host", "_token", "_count"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def slots(hashes: list[int], root: set[int]) -> list[int]:
    """For every token the slot it lies in: the last root token before it (or it), 0 at the start."""
    out, last = [], 0
    for h in hashes:
        last = h if h in root else last
        out.append(last)
    return out


def _order_of(sequence: list[int]) -> int:
    raw = ",".join(map(str, sequence)).encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _validity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page says about the order and slots of each class, and about each slot's links."""
    for batch in batches:
        rows: list[tuple] = []
        for host, text, root, tokens, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not tokens:
                continue
            parsed = parse(text)
            hashes = [token_hash(t) for t in parsed]
            at = slots(hashes, set(root or []))
            of = dict(zip(tokens, classes, strict=True))
            seen: dict[int, list[int]] = {}
            for h, slot in zip(hashes, at, strict=True):
                if h in of:
                    seen.setdefault(of[h], []).extend((h, slot))
            rows += [(host, 0, c, _order_of(s), 0, 0) for c, s in seen.items()]
            chars: dict[int, list[int]] = {}
            for token, slot in zip(parsed, at, strict=True):
                if isinstance(token, Text):
                    sums = chars.setdefault(slot, [0, 0])
                    sums[0] += token.links
                    sums[1] += len(token.text)
            rows += [(host, 1, slot, 0, a, b) for slot, (a, b) in chars.items()]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield _batch(rows, kinds, ["_host", "_kind", "_of", "_order", "_links", "_chars"])


def main_text(page: str, constant: set[int], root: set[int], link_slots: set[int]) -> str:
    """Text of the article's blocks: those in an article element if the page has one.

    Text that belongs to the host's template goes, and so do slots that are mostly links, in an
    article as well; enclosing elements and marked blocks that do not hold the article are out.
    """
    parsed = parse(page)
    blocks = [(i, t) for i, t in enumerate(parsed) if isinstance(t, Text) and not t.out]
    if any(t.inside for _, t in blocks):
        blocks = [(i, t) for i, t in blocks if t.inside]
    if link_slots:
        at = slots([token_hash(t) for t in parsed], root)
        blocks = [(i, t) for i, t in blocks if at[i] not in link_slots]
    return " ".join(t.text for _, t in blocks if token_hash(t) not in constant)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[2:]]
        texts = [main_text(page, set(t or []), set(r or []), set(s or [])) for page, t, r, s in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "_text"])


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), _HOST, 1), F.lit("")))


def templates(pages: DataFrame, least_pages: int, coverage: float) -> DataFrame:
    """Per host: ``_root`` tokens, ``_constant`` text of valid classes and ``_link_slots``.

    ``pages`` has ``_host`` and ``_html``. Pages with the same longest block are copies and count as one.
    """
    counted = pages.select("_host", "_html").mapInArrow(_occurrences, "_body long, _host string, _token long, _count long")
    # copies of a page, exact or near, are one page here: what they share is not the host's
    counted = counted.groupBy("_host", "_token", "_body").agg(F.max("_count").alias("_count"))
    vectors = counted.groupBy("_host", "_token").agg(
        F.bit_xor(F.xxhash64("_body", "_count")).alias("_vector"),
        F.count(F.lit(1)).alias("_pages"),
        F.sum("_count").alias("_sum"),
    )
    vectors = materialize(vectors.filter((F.col("_token") == 0) | (F.col("_pages") > 1)), "template-vectors")
    hosts = vectors.filter("_token = 0").select("_host", F.col("_pages").alias("_all")).filter(F.col("_all") >= least_pages)
    wide = vectors.filter("_token <> 0").join(hosts, "_host").filter(F.col("_pages") >= coverage * F.col("_all"))
    once = (F.col("_pages") == F.col("_all")) & (F.col("_sum") == F.col("_all"))
    wide = wide.withColumn("_class", F.when(once, 0).otherwise(F.xxhash64("_vector", "_pages", "_sum")))
    classes = materialize(wide.select("_host", "_token", "_class"), "template-classes")
    per_host = classes.groupBy("_host").agg(
        F.collect_list(F.when(F.col("_class") == 0, F.col("_token"))).alias("_root"),
        F.collect_list("_token").alias("_tokens"),
        F.collect_list("_class").alias("_classes"),
    )
    per_host = materialize(per_host, "template-hosts")
    seen = pages.join(per_host, "_host").select("_host", "_html", "_root", "_tokens", "_classes")
    seen = seen.mapInArrow(_validity, "_host string, _kind int, _of long, _order long, _links long, _chars long")
    summed = seen.groupBy("_host", "_kind", "_of").agg(
        (F.min("_order") == F.max("_order")).alias("_ordered"), (2 * F.sum("_links") > F.sum("_chars")).alias("_linked")
    )
    summed = materialize(summed, "template-validity")
    valid = summed.filter("_kind = 0 and _ordered").select("_host", F.col("_of").alias("_class"))
    kept = classes.join(valid, ["_host", "_class"]).groupBy("_host").agg(
        F.collect_list(F.when(F.col("_class") == 0, F.col("_token"))).alias("_root"),
        F.collect_list("_token").alias("_constant"),
    )
    linked = summed.filter("_kind = 1 and _linked").groupBy("_host").agg(F.collect_list("_of").alias("_link_slots"))
    return materialize(kept.join(linked, "_host", "left"), "templates")


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = 5,
    coverage: float = 0.9,
) -> DataFrame:
    """One row per page: id, url, ``text`` (main text, empty if none) and ``n_chars``.

    White space inside a block becomes one space, blocks are joined in page order by one
    space, character references are decoded. A null or empty page has an empty text. A
    null url, or one without a host, belongs to the host "". Hosts with fewer than
    ``least_pages`` different pages have no template; there only the enclosing elements decide.
    Repeated rows and null ids are pages of their own. Other columns are not read. An empty
    table gives an empty result.
    """
    chosen = pages.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).alias("_url"),
        host_of(url_col).alias("_host"),
        text_of(html_col).alias("_html"),
    )
    template = templates(chosen.select("_host", "_html"), least_pages, coverage)
    joined = chosen.join(template, "_host", "left").select("_id", "_url", "_html", "_constant", "_root", "_link_slots")
    kinds = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in (("_id", id_col), ("_url", url_col)))
    found = joined.mapInArrow(_extract, f"{kinds}, _text string")
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_text").alias("text"),
        F.length("_text").cast("long").alias("n_chars"),
    )
