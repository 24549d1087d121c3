"""The HTML job on all pages, and on odd ones, against a plain scanner that walks each page once, token by token."""

from __future__ import annotations

import html
import re
from collections import Counter

from guardlake import catalog
from guardlake.operators import formats
from guardlake.plans import derived as D

SF = "/root/testdata/sf0.001"


def tag_end(page: str, at: int) -> int:
    """Where the tag that begins at `at` ends, quotes minded; -1 if it does not."""
    quote, i = "", at + 1
    while i < len(page):
        c = page[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i + 1
        i += 1
    return -1


def tokens(page: str) -> list[dict]:
    """kind, name and raw text of each token."""
    out, at = [], 0
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at) if "<" in page[at:] else len(page)
            out.append({"kind": "text", "raw": page[at:end], "name": ""})
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            out.append({"kind": "comment", "raw": page[at:end], "name": ""})
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            out.append({"kind": "markup", "raw": page[at:end], "name": ""})
        else:
            name = re.match(r"</?([A-Za-z][A-Za-z0-9:-]*)", page[at:])
            end = tag_end(page, at) if name else -1
            if end < 0:
                out.append({"kind": "text", "raw": "<", "name": ""})
                end = at + 1
            else:
                word, close = name[1].lower(), page[at + 1] == "/"
                raw = re.match(r"(script|style|title)\b", page[at + 1 :], re.I)
                if raw and not close:
                    stop = re.compile(rf"</{raw[1]}\s*>", re.I).search(page, end)
                    end = len(page) if stop is None else stop.end()
                    kind = "raw"
                else:
                    void = word in formats.VOID or page[end - 2] == "/"
                    kind = "close" if close else "void" if void else "open"
                out.append({"kind": kind, "raw": page[at:end], "name": word})
        at = end
    return out


def attribute(token: dict, name: str) -> str | None:
    """The first attribute of this name in the token, '' if it has no value."""
    found = re.search(rf"""\s{name}(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]))""", token["raw"], re.I)
    return None if found is None or token["kind"] not in ("open", "void", "raw") else (found[1] or "").strip("\"'")


def hides(style: str) -> bool:
    style = re.sub(r"/\*.*?\*/", "", style, flags=re.S).lower()
    zero = [float(x) == 0 for x in re.findall(r"opacity\s*:\s*([0-9.]+)", style) if x.count(".") < 2 and x != "."]
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style)) or any(zero)


def clean(page: str) -> tuple[str, dict]:
    all_, stripped = tokens(page), Counter()
    css = "\n".join(re.findall(r"(?is)<style\b[^>]*>(.*?)(?:</style\s*>|\Z)", page))
    classes = {c for head, body in re.findall(r"([^{}]+)\{([^{}]*)\}", re.sub(r"(?s)/\*.*?\*/", "", css)) if hides(body) for c in re.findall(r"\.([A-Za-z0-9_-]+)", head)}
    parts, skip_to = [], -1
    for i, t in enumerate(all_):
        kind, name = t["kind"], t["name"]
        if i <= skip_to:
            continue
        why = None
        if kind in ("open", "void", "raw"):
            if name in formats.DROPPED:
                why = name
            elif attribute(t, "hidden") is not None:
                why = "hidden-attr"
            elif hides(attribute(t, "style") or ""):
                why = f"hidden-style-{name}"
            elif classes & set((attribute(t, "class") or "").split()):
                why = f"hidden-class-{name}"
        if why:
            stripped[why] += 1
            if kind == "open":
                depth, skip_to = 1, len(all_)
                for j in range(i + 1, len(all_)):
                    if all_[j]["name"] == name:
                        depth += {"open": 1, "close": -1}.get(all_[j]["kind"], 0)
                        if depth == 0:
                            skip_to = j
                            break
            continue
        if kind == "comment":
            stripped["comment"] += 1
        if kind in ("open", "void"):
            stripped["aria-label"] += attribute(t, "aria-label") is not None
            stripped["title-attr"] += attribute(t, "title") is not None
            stripped["alt-non-img"] += attribute(t, "alt") is not None and name != "img"
        if kind == "text":
            parts.append(t["raw"])
        elif name in formats.BLOCK:
            parts += [("break", x) for x in {"open": ["enter"], "close": ["leave"], "void": ["enter", "leave"]}[kind]]
    text = ""
    for p in parts:
        if isinstance(p, str):
            text += p
        elif not (text == "" and p[1] == "enter") and not text.endswith("\n"):
            text += "\n"
    return html.unescape(text.replace("\x00", "")), {k: n for k, n in stripped.items() if n}


ODD = [
    "", "plain", "a < b", "<p>one<p>two</p></p>three", "<div hidden>a<div>b</div>c</div>d", "<b style='display: none'>x", "<br><br>x<br/>y", "x<script>if (a<b) {}</script >y", "<p title='t' aria-label=x>p</p>",
    "<img alt=a><i alt=b>c</i>", "<style>.h,.k{opacity:0.0}</style><p class='k j'>no</p>yes", "&lt;b&gt; &amp;amp; &copy", "<!-- open", "<!doctype html><title>t</title>z", "<ul><li>a</li><li>b</li></ul>", "</div>x</p>y", "<span hidden>a</span hidden>b", "<p>\n</p>\nq", "<template><p>t</p></template>v",
]


def test_odd_pages_are_cleaned_as_the_plain_scanner_does(spark):
    out = {r.page_id: r for r in formats.clean_html(spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string")).collect()}
    for i, page in enumerate(ODD):
        assert (out[i].text, dict(out[i].stripped or {})) == clean(page), page


def test_all_pages_are_cleaned_as_the_plain_scanner_does(spark):
    import hashlib

    pages = {r.page_id: r.html for r in D.pages(spark, SF).collect()}
    out = catalog.queries()["f2_html_text"](spark, SF).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        text, stripped = clean(pages[r.page_id])
        assert (r.n_chars, r.text_sha) == (len(text), hashlib.sha256(text.encode()).hexdigest()), r.page_id
        assert r.stripped == ",".join(f"{k}={n}" for k, n in sorted(stripped.items()))
