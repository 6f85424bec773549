"""Pages of storage markup as markdown text, with the people they mention and the pages they refer to.

A page is read once, tag by tag, with a stack of the elements that are open; names of people come to their pages by a join.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Who is mentioned without a name, and the attributes that carry a mention's person, a page's title, a file and an address.
UNRESOLVED = "@unresolved-user"
USER = r'<ri:user\b[^>]*ri:(?:account-id|userkey)="([^"]*)"'
LINK = r"(?s)<ac:link\b[^>]*>(.*?)</ac:link>"
PAGE = r'<ri:page\b[^>]*ri:content-title="([^"]*)"'
TARGETS = {"ri:page": ("ri:content-title",), "ri:attachment": ("ri:filename",), "ri:url": ("ri:value",), "ri:user": ("ri:account-id", "ri:userkey")}

_TOKEN = re.compile(r"""<!\[CDATA\[(?P<raw>.*?)\]\]>|<!--.*?-->|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z][\w:.-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>|(?P<text>[^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_INLINE = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
_PLAIN = frozenset(["a", "abbr", "font", "label", "small", "span", "sub", "sup", "time", "u", *_INLINE])
_UNSEEN = frozenset(["script", "style", "template"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr", *TARGETS])
_SPLIT = "]]]]><![CDATA[>"
_CLOSED_BY = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr"}, "tbody": {"tr", "thead"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BOUNDS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "thead": {"table"}, "tbody": {"table"}, "dt": {"dl"}, "dd": {"dl"}}


class _Open:
    """An open element: the blocks finished in it, the words since the last one, and where inline elements began among them."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.blocks, self.words, self.inline, self.target = tag, attrs, [], [], [], None

    def flush(self) -> None:
        while self.inline:
            self.end_inline(self.inline[-1][0])
        text = re.sub(r"[ \t\r\n\f]+", " ", "".join(self.words)).replace(" \0", "\0").replace("\0 ", "\0").strip(" \0")
        self.words = []
        if text:
            self.blocks.append(text.replace("\0", "  \n"))

    def end_inline(self, tag: str) -> None:
        while self.inline:
            name, attrs, start = self.inline.pop()
            text = "".join(self.words[start:])
            del self.words[start:]
            left, right = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
            inner = text.strip()
            if inner and name in _INLINE:
                inner = _INLINE[name] + inner + _INLINE[name]
            elif inner and name == "a" and attrs.get("href"):
                inner = f"[{inner}]({attrs['href']})"
            self.words.append(left + inner + right if inner else text)
            if name == tag:
                return


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


def _lines(text: str, first: str, rest: str) -> str:
    return "\n".join((rest if n else first) + line if line or not n else line for n, line in enumerate(text.split("\n")))


def _item(element: _Open) -> str:
    """An item's blocks; lists follow what stands before them without a blank line."""
    out = ""
    for n, block in enumerate(element.blocks):
        out += block if not n else ("\n" if re.match(r"- |\d+\. ", block) else "\n\n") + block
    return out


def _table(rows: list[list[str]]) -> str:
    wide = max(map(len, rows))
    cells = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([cells[0], "| " + " | ".join(["---"] * wide) + " |", *cells[1:]])


class _Page:
    """The stack of open elements of one page."""

    def __init__(self, names: dict[str, str]):
        self.names, self.stack, self.unseen = names, [_Open("", {})], None

    def top(self) -> _Open:
        return self.stack[-1]

    def within(self, tag: str) -> _Open | None:
        return next((e for e in reversed(self.stack) if e.tag == tag), None)

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        top = self.top()
        if tag in TARGETS:
            link = self.within("ac:link") or self.within("ac:image")
            if link is not None:
                value = next((attrs[a] for a in TARGETS[tag] if attrs.get(a)), "")
                link.target = link.target or (self.names.get(value, UNRESOLVED) if tag == "ri:user" else value)
        elif tag == "br":
            top.words.append("\0")
        elif tag == "img":
            top.words.append(f"![{attrs.get('alt', '')}]({attrs.get('src', '')})")
        elif tag == "hr":
            top.flush()
            top.blocks.append("---")
        elif tag in _PLAIN and self.within("pre") is None:
            top.inline.append((tag, attrs, len(top.words)))
        elif tag == "code" and top.tag == "pre":
            top.attrs = {**attrs, **top.attrs}
        elif tag not in _VOID and tag not in _PLAIN:
            self.end_implied(tag)
            if tag not in ("ac:link", "ac:image", "ac:parameter"):
                self.top().flush()
            self.stack.append(_Open(tag, attrs))

    def end_implied(self, tag: str) -> None:
        """What an opening tag closes: a paragraph, and what can't stand in itself, up to the list or table that both are in."""
        if self.top().tag == "p" and not tag.startswith(("ac:", "ri:")):
            self.end("p")
        for e in reversed(self.stack):
            if e.tag in _BOUNDS.get(tag, ()):
                return
            if e.tag in _CLOSED_BY.get(tag, ()):
                return self.end(e.tag)

    def end(self, tag: str) -> None:
        if tag in _PLAIN and self.within("pre") is None:
            if any(name == tag for name, *_ in self.top().inline):
                self.top().end_inline(tag)
        elif self.within(tag) is not None:
            while self.top().tag != tag:
                self.finish()
            self.finish()

    def finish(self) -> None:
        """The innermost element becomes part of the one around it."""
        e = self.stack.pop()
        up = self.top()
        if e.tag == "pre":
            language = next((c[9:] for c in e.attrs.get("class", "").split() if c.startswith("language-")), "")
            return up.blocks.append(f"```{language}\n" + "".join(e.words).strip("\n") + "\n```")
        if e.tag == "ac:parameter":
            up.attrs = {**up.attrs, "parameter " + e.attrs.get("ac:name", ""): "".join(e.words).strip()}
            return None
        if e.tag in ("ac:link", "ac:image"):
            e.flush()
            label = " ".join(e.blocks) or e.target or ""
            return up.words.append(label if e.tag == "ac:link" else f"[image: {e.target}]" if e.target else "[image]")
        e.flush()
        if not e.blocks:
            if e.tag in ("td", "th"):
                up.blocks.append("")
            return None
        if re.fullmatch("h[1-6]", e.tag):
            up.blocks.append("#" * int(e.tag[1]) + " " + " ".join(" ".join(e.blocks).split()))
        elif e.tag == "li":
            up.blocks.append(_item(e))
        elif e.tag in ("ul", "ol"):
            first = int(e.attrs["start"]) if e.attrs.get("start", "").isdigit() and len(e.attrs["start"]) < 10 else 1
            marks = ["- " if e.tag == "ul" else f"{first + n}. " for n in range(len(e.blocks))]
            up.blocks.append("\n".join(_lines(b, m, " " * len(m)) for b, m in zip(e.blocks, marks, strict=True)))
        elif e.tag == "blockquote":
            up.blocks.append(_lines("\n\n".join(e.blocks), "> ", "> ").replace("\n\n", "\n>\n"))
        elif e.tag in ("td", "th"):
            up.blocks.append(" ".join(" ".join(e.blocks).split()).replace("|", "\\|"))
        elif e.tag == "tr":
            up.blocks.append(e.blocks)
        elif e.tag == "table":
            rows = [r if isinstance(r, list) else [r] for r in e.blocks]
            up.blocks.append(_table(rows))
        else:
            up.blocks.extend(e.blocks)
        return None

    def text(self, raw: str, verbatim: bool) -> None:
        macro = self.within("ac:structured-macro")
        if verbatim and macro is not None and macro.attrs.get("ac:name") == "code" and self.top().tag == "ac:plain-text-body":
            macro.blocks.append(f"```{macro.attrs.get('parameter language', '')}\n" + raw.strip("\n") + "\n```")
        elif self.within("pre") is not None:
            self.top().words.append(raw if verbatim else html.unescape(raw))
        else:
            seen = raw if verbatim else html.unescape(raw)
            coded = any(name in ("code", "kbd", "samp") for name, *_ in self.top().inline)
            self.top().words.append(seen.replace("\0", "") if coded else re.sub(r"([*_])", r"\\\1", seen.replace("\0", "")))

    def read(self, source: str) -> str:
        source = source.replace(_SPLIT, "\1")  # the written form of ']]>' inside CDATA
        for m in _TOKEN.finditer(source):
            tag = m["tag"] and m["tag"].lower()
            if self.unseen:
                if tag == self.unseen and m["close"]:
                    self.unseen = None
            elif tag is None:
                found = m["raw"] if m["raw"] is not None else m["text"]
                if found is not None:
                    self.text(found.replace("\1", "]]>"), m["raw"] is not None)
            elif m["close"]:
                self.end(tag)
            elif tag in _UNSEEN:
                self.unseen = tag
            else:
                self.open(tag, _attributes(m["attrs"]))
                if m["attrs"].endswith("/") and tag not in _VOID and tag not in _PLAIN:
                    self.end(tag)
        while len(self.stack) > 1:
            self.finish()
        self.top().flush()
        return "\n\n".join(b if isinstance(b, str) else " ".join(b) for b in self.top().blocks)


def page_text(source: str | None, names: dict[str, str] | None = None) -> str:
    """The markdown of one page; empty for null and for pages without text."""
    return _Page(names or {}).read(source or "")


def _page_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources, named = batch.columns
        for n in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([ids.slice(n, 1), pa.array([page_text(sources[n].as_py(), dict(named[n].as_py() or []))], pa.string())], ["id", "text"])


def user_ids(source: Column) -> Column:
    """The distinct people a page mentions, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(USER), 1)))


def references(source: Column) -> Column:
    """The titles of the pages a page links to, each once, in order."""
    titles = F.transform(F.regexp_extract_all(source, F.lit(LINK), 1), lambda link: F.regexp_extract(link, PAGE, 1))
    return F.array_distinct(F.filter(titles, lambda title: title != ""))


def as_markdown(pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(id, text) of pages (id, html); names (user, name) are joined to the pages that mention them.

    Ids that repeat keep a row each and share the names. Without names no shuffle is needed."""
    kind = pages.schema["id"].dataType.simpleString()
    pages = pages.select("id", "html")
    empty = F.lit(None).cast("map<string,string>").alias("named")
    if names is not None:
        asked = pages.select("id", F.explode(user_ids(F.col("html"))).alias("user")).distinct()
        known = asked.join(names.select("user", "name").groupBy("user").agg(F.min("name").alias("name")), "user")
        known = known.where("name is not null").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("user", "name"))).alias("named"))
        pages = pages.join(known.withColumnRenamed("id", "mentions"), F.col("id").eqNullSafe(F.col("mentions")), "left").select("id", "html", "named")
    else:
        pages = pages.select("id", "html", empty)
    return pages.mapInArrow(_page_batches, f"id {kind}, text string")
