"""Pages against a second, plain renderer on random trees, and by hand."""

import random
import re

import pytest

from sparkfolio.llm.html_text import page_text

INLINE, PLAIN = ["span", "b", "i"], ["div", "section"]


def tree(rng, depth=0, inline=False, listed=False):
    """(tag, attributes, children); a string is a text."""
    kind = rng.random()
    if depth > 5 or kind < 0.35:
        return rng.choice(["", " "]) + f"w{rng.randrange(1000)}" + rng.choice(["", " ", "\n"])
    style = {}
    if rng.random() < 0.15:
        style["visibility"] = rng.choice(["hidden", "visible"])
    if rng.random() < 0.06:
        style["display"] = "none"
    some = lambda **k: [tree(rng, depth + 1, **k) for _ in range(rng.randint(0, 4))]
    if inline or kind < 0.5:
        return (rng.choice(INLINE), style, some(inline=True))
    if kind < 0.62:
        return ("p", style, some(inline=True))
    if kind < 0.78:
        return (rng.choice(PLAIN), style, some())
    if kind < 0.93:
        more = dict(style)
        if rng.random() < 0.3:
            more["start"] = rng.randint(-3, 30)
        if rng.random() < 0.2:
            more["reversed"] = True
        items = [("li", {"value": rng.randint(0, 50)} if rng.random() < 0.15 else {}, some()) for _ in range(rng.randint(0, 4))]
        return (rng.choice(["ul", "ol"]), more, items)
    if kind < 0.97:
        return ("details", style | ({"open": True} if rng.random() < 0.5 else {}), [("summary", {}, some(inline=True)), *some()])
    return ("dialog", style | ({"open": True} if rng.random() < 0.5 else {}), some())


def html(node):
    if isinstance(node, str):
        return node
    tag, own, children = node
    style = ";".join(f"{k}: {own[k]}" for k in ("visibility", "display") if k in own)
    attributes = "".join([f' style="{style}"' if style else "", *[f' {k}="{own[k]}"' for k in ("start", "value") if k in own], *[f" {k}" for k in ("reversed", "open") if k in own]])
    return f"<{tag}{attributes}>{''.join(map(html, children))}</{tag}>"


def pieces(node, visible=True, within=0, number=None):
    """Texts, breaks (1 a new line, 2 an empty one) and finished lines (lists) of a tree."""
    if isinstance(node, str):
        return [node] if visible else []
    tag, own, children = node
    if own.get("display") == "none" or (tag == "dialog" and "open" not in own):
        return []
    visible = {"hidden": False, "visible": True}.get(own.get("visibility"), visible)
    if tag in INLINE:
        return [x for c in children for x in pieces(c, visible, within)]
    if tag in ("ul", "ol"):
        size = 1 if within else 2
        step = -1 if "reversed" in own and tag == "ol" else 1
        shown = [c for c in children if c[1].get("display") != "none"]
        n = own.get("start", len(shown) if step < 0 else 1) - step if tag == "ol" else 0
        out = [size]
        for c in children:
            n = c[1].get("value", n + step)
            inner = lines([x for k in c[2] for x in pieces(k, visible, within + 1)])
            mark = f"{n}. " if tag == "ol" else "- "
            seen = {"hidden": False, "visible": True}.get(c[1].get("visibility"), visible)
            out += [1, [((mark if k == 0 and seen else " " * len(mark)) + x).rstrip() for k, x in enumerate(inner)], 1]
        return [*out, size]
    if tag == "details" and "open" not in own:
        children = children[:1]
    size = 2 if tag == "p" else 1
    return [size, *[x for c in children for x in pieces(c, visible, within)], size]


def lines(items):
    out, line, gap = [], "", 0
    for x in [*items, 1]:
        if isinstance(x, str):
            line += x
            continue
        text = re.sub(r"[ \n]+", " ", line).strip()
        if text:
            out += [""] * (gap == 2 and bool(out)) + [text]
            gap = 0
        line = ""
        if isinstance(x, list):
            if x:
                out += [""] * (gap == 2 and bool(out)) + x
                gap = 0
        else:
            gap = max(gap, x)
    return out


def test_random_trees_against_a_plain_renderer():
    rng = random.Random(11)
    for k in range(1500):
        nodes = [tree(rng) for _ in range(rng.randint(1, 4))]
        page = "".join(map(html, nodes))
        want = "\n".join(lines([x for n in nodes for x in pieces(n)]))
        assert page_text(page) == want, (k, page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<details><summary>More</summary><p>closed</details>x", "More\nx"),
        ("<details open><summary>More</summary><p>shown</details>x", "More\n\nshown\n\nx"),
        ("<details><p>no summary</details>x", "x"),
        ("a<dialog>closed</dialog>x", "ax"),
        ("a<dialog open>shown</dialog>x", "a\nshown\nx"),
        ('<div style="visibility:hidden">no<span style="visibility:visible">yes</span>no</div>z', "yes\nz"),
        ('<p style="color:red;visibility : hidden; visibility: visible">last counts</p>', "last counts"),
        ('<ul><li style="visibility:hidden">n<b style="visibility:visible">v</b><li>w</ul>', "  v\n- w"),
        ('<table><tr style="visibility:collapse"><td>gone<tr><td>a</table>', "a"),
        ("<ol start=5><li>a<li>b<li value=9>c<li>d</ol>", "5. a\n6. b\n9. c\n10. d"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol start='x'><li value=y>a</ol>", "1. a"),
        ("<table><tr><td>日本<td>x<tr><td>a<td>y</table>", "日本  x\na     y"),
        ("<table><tr><td>éé<td>x<tr><td>abc<td>y</table>", "éé   x\nabc  y"),
    ],
)
def test_what_is_shown_and_how_it_is_counted(page, text):
    assert page_text(page) == text
