"""Main text of web pages by tag-path ratios.

A page is read as blocks: runs of text between block-level tags. Blocks are grouped by their root-to-leaf path of
block-level tags (with class names). Of each path: text length per block, punctuation per block, and the share of text
outside links. A block's values are smoothed with its neighbours', fused as length * (1 + punctuation) * unlinked
share, and averaged over its path; paths of at least SHARE of the best path's value are content paths.

The article is the innermost article or main element that holds most of the content paths' text, or else the innermost
element that holds MOST of it, with the elements of that element's own path, what stands before it on content paths, and
a headline before it. Within the article, all blocks are text but those on paths of links (where no article or main element
says that they are the article's own).

Lists of names come after the ratios. What stands in menus, footers, sidebars, forms and the like by its tag is never text,
nor are scripts and styles. What is named as such by the last or first part of a class, id or role isn't either, unless the
element holds a headline, an article or most of the page's unlinked text, or the part is turned round (has-sidebar).

Defined results: null and empty html, and pages without text, give an empty text; whole pages are read at any length;
unclosed and wrongly nested tags are closed as browsers do for paragraphs, list items and cells; repeated rows give
repeated rows; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.common import bounded_batches, table

SHARE, MOST = 0.12, 0.7
#: Names of elements.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NO_TEXT = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "datalist", "template", "svg", "object", "canvas", "dialog", "audio", "video", "map", "menu", "fieldset", "frameset"}
ROOTS = {"html", "body", "article", "main"}
#: An open element of the key is closed by a start tag of the values, unless an element of its wall stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
WALL = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Parts of classes, ids and roles of what isn't the article, and parts that turn the ones after them round.
UNWANTED = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead banner footer sidebar aside complementary contentinfo widget widgets ad ads advert adverts"
    " advertisement advertisements advertising sponsor sponsored promo promos cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations comment comments commentlist replies disqus pager pagination".split()
)
TURNS = {"has", "with", "no", "without", "is", "not"}
HEADER = {"header", "pageheader", "siteheader"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<(?P<odd_end>/?)(?P<odd>[a-zA-Z][^\s/>]*+)(?P<odd_rest>[^>]*+)>", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


class _Open:
    """An open element. unwanted: by its tag; named: by a class, id or role."""

    __slots__ = ("name", "number", "unwanted", "named", "label", "path")

    def __init__(self, name, number, unwanted, named, label, path):
        self.name, self.number, self.unwanted, self.named, self.label, self.path = name, number, unwanted, named, label, path


class Block:
    """A run of text. inside: (number, name, path, named) of the elements that it stands in."""

    __slots__ = ("text", "linked", "path", "inside", "unwanted")

    def __init__(self, text, linked, path, inside, unwanted):
        self.text, self.linked, self.path, self.inside, self.unwanted = text, linked, path, inside, unwanted


def attributes(rest: str) -> dict[str, str]:
    """Of a start tag; the first of equal names counts."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(rest):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def names_chrome(names: str) -> bool:
    """Whether a class, id or role names what isn't the article: by its first or last part."""
    for whole in names.lower().split():
        parts = [x for x in re.split(r"[-_]+", whole) if x]
        if parts and parts[0] not in TURNS and (parts[0] in UNWANTED or parts[-1] in UNWANTED or "".join(parts) in HEADER):
            return True
    return False


_LOWER = {i: i + 32 for i in range(65, 91)}


def blocks(page: str) -> Iterator[Block]:
    """Blocks in page order."""
    stack: list[_Open] = []
    parts: list[str] = []
    links, linked, number, at = 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        n, linked = linked, 0
        parts.clear()
        if text:
            yield Block(text, min(n, len(text)), stack[-1].path if stack else "", tuple((e.number, e.name, e.path, e.named) for e in stack), any(e.unwanted for e in stack))

    size, lower = len(page), None
    while at < size:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m["name"] or m["odd"]
        if not name:
            continue
        name, ending, rest = name.lower(), m["end"] or m["odd_end"], m["rest"] or m["odd_rest"] or ""
        if not ending and name in RAW:
            # up to its end tag, even after "/>"; letters are turned one by one, so that places stay
            lower = page.translate(_LOWER) if lower is None else lower
            end = lower.find(f"</{name}", at)
            stop = page.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else size
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if ending else 1
            continue
        yield from flush()
        links = 0 if name != "br" else links
        if name in VOID:
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("td", "th", "table", "article", "main", "body") and name in ("p", "div", "li", "ul", "ol", "section") and name != stack[k].name:
                    break  # a stray end tag doesn't close what is around it
            continue
        if stack and stack[-1].name == "p":
            stack.pop()  # a block-level start tag closes an open paragraph
        for k in range(len(stack) - 1, -1, -1):
            if name in CLOSES.get(stack[k].name, ()):
                del stack[k:]
                break
            if stack[k].name in WALL.get(name, ROOTS):
                break
        number += 1
        given = attributes(rest)
        names = " ".join(given[k] for k in ("class", "id", "role") if given.get(k))
        bad = name in NO_TEXT or name == "header" and not any(e.name in ("article", "main") for e in stack)
        bad = bad or name not in ROOTS and ("hidden" in given or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I)))
        named = names_chrome(names) and (name not in ROOTS or name == "article" and any(e.name == "article" for e in stack) or name == "article" and "comment" in names.lower())
        label = f"{name}.{names}" if names else name
        stack.append(_Open(name, number, bad, named, label, f"{stack[-1].path}/{label}" if stack else label))
    yield from flush()


def content_paths(found: list[Block], share: float = SHARE) -> set[str]:
    """The paths whose fused and smoothed ratio is at least share of the best one's."""
    if not found:
        return set()
    groups: dict[str, list[Block]] = defaultdict(list)
    for b in found:
        groups[b.path].append(b)
    per = {p: (sum(len(b.text) for b in g) / len(g), sum(len(PUNCTUATION.findall(b.text)) for b in g) / len(g), 1 - sum(b.linked for b in g) / sum(len(b.text) for b in g)) for p, g in groups.items()}
    # a path's own ratio counts with the block's own length, so that short blocks of a long path still stand on it
    raw = [per[b.path][0] for b in found]
    smooth = [(raw[max(0, i - 1)] + 2 * raw[i] + raw[min(len(raw) - 1, i + 1)]) / 4 for i in range(len(raw))]
    fused: dict[str, list[float]] = defaultdict(list)
    for b, s in zip(found, smooth):
        fused[b.path].append(min(s, 2 * per[b.path][0]) * (1 + per[b.path][1]) * per[b.path][2] ** 2)
    value = {p: sum(v) / len(v) for p, v in fused.items()}
    top = max(value.values())
    return {p for p, v in value.items() if v > 0 and v >= share * top}


def told_by_name(found: list[Block]) -> set[int]:
    """Elements that are left out for their names: those that hold no headline and no article, and not most of the unlinked text."""
    holds: dict[int, int] = defaultdict(int)
    top: set[int] = set()
    for b in found:
        head = any(name in ("h1", "article", "main") for _, name, _, _ in b.inside)
        for i, (number, _, _, named) in enumerate(b.inside):
            if named:
                holds[number] += len(b.text) - b.linked
                if head and any(name in ("h1", "article", "main") for _, name, _, _ in b.inside[i + 1 :]):
                    top.add(number)
    total = sum(len(b.text) - b.linked for b in found)
    return {n for n, m in holds.items() if n not in top and m < 0.8 * total}


def main_text(page: str | None) -> str:
    found = [b for b in blocks(page or "") if not b.unwanted]
    left_out = told_by_name(found)
    found = [b for b in found if not any(n in left_out for n, _, _, _ in b.inside)]
    good = content_paths(found)
    held = [b for b in found if b.path in good]
    if not held:
        return ""
    total = sum(len(b.text) for b in held)
    mass: dict[int, int] = defaultdict(int)
    about: dict[int, tuple[str, str]] = {}
    for b in held:
        for number, name, path, _ in b.inside:
            mass[number] += len(b.text)
            about[number] = name, path
    # numbers grow inwards: the innermost article, or main, with most of the content; else the innermost such element
    most = [n for n, m in mass.items() if m >= 0.5 * total and about[n][0] in ("article", "main")]
    own = bool(most)
    root = max(most or [n for n, m in mass.items() if m >= MOST * total], default=None)
    if root is None:
        within = [True] * len(found)
    else:
        like = about[root][1]
        within = [any(n == root or not own and path == like for n, _, path, _ in b.inside) for b in found]
        first = within.index(True)
        if not own:
            # what comes before on content paths, and a headline
            for i in range(first):
                within[i] = found[i].path in good or any(name == "h1" for _, name, _, _ in found[i].inside)
    linked, size = defaultdict(int), defaultdict(int)
    for b in found:
        linked[b.path] += b.linked
        size[b.path] += len(b.text)
    return " ".join(b.text for b, inside in zip(found, within) if inside and (own or b.path in good or linked[b.path] <= 0.7 * size[b.path]))


def extract(pages: DataFrame, page: str = "html", keep=("page_id", "url")) -> DataFrame:
    """A row per page: the columns of keep, text, n_chars. Runs where the rows are: no shuffle."""
    bounded_batches(pages.sparkSession, 500)
    d = pages.select(*keep, page)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return d.mapInArrow(run, f"{kept}, text string, n_chars bigint")


def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_tag_path_text": op2_tag_path_text}
ORACLE: dict[str, str] = {}
