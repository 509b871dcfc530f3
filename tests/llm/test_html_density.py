"""The density method against sums over all descendants of all nodes; lists, unclosed elements and deep pages."""

import math
import random
import time

import pytest

from tessera.llm import html_text

WORDS = "word " * 60


def page_of(rng):
    def block(depth):
        kind = rng.choice(["div", "section", "p", "p", "ul", "div"])
        if kind == "p" or depth > 4:
            links = "".join(f"<a href=x>{'link ' * rng.randrange(1, 5)}</a>" for _ in range(rng.randrange(3)))
            return f"<p>{'text ' * rng.randrange(1, 80)}<b>{'bold ' * rng.randrange(3)}</b>{links}</p>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a href=x>item {k}</a></li>" for k in range(rng.randrange(1, 6))) + "</ul>"
        return f"<{kind}>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{kind}>"

    return "<html><body>" + "".join(block(0) for _ in range(rng.randrange(1, 5))) + "</body></html>"


def test_densities_from_all_descendants():
    rng = random.Random(7)
    for _ in range(60):
        nodes, _pieces = html_text.parse(page_of(rng))
        body = html_text.densities(nodes)

        def under(k, nodes=nodes):
            out = {k}
            for j in range(k + 1, len(nodes)):
                if nodes[j].parent in out:
                    out.add(j)
            return out

        below = [under(k) for k in range(len(nodes))]
        chars = [sum(nodes[j].own for j in b) for b in below]
        anchors = [{j for j in b if nodes[j].tag == "a"} for b in below]
        linked = [sum(nodes[j].own for j in set().union(*(below[x] for x in a))) if a else 0 for a in anchors]
        ratio = linked[body] / max(chars[body], 1)
        sums = [0.0] * len(nodes)
        for k, node in enumerate(nodes):
            want = 0.0
            if chars[k]:
                tags, links, link_tags = max(len(below[k]) - 1, 1), max(linked[k], 1), max(len(anchors[k]), 1)
                base = max(math.log(chars[k] / max(chars[k] - linked[k], 1) * linked[k] + ratio * chars[k] + math.e), 1.0)
                want = max(chars[k] / tags * math.log(max(chars[k] / links * tags / link_tags, 1.0)) / math.log(base + math.e - 1), 0.0)
            assert node.density == pytest.approx(want)
            if k and node.tag not in html_text.INLINE:
                sums[node.parent] += want
        assert [n.total for n in nodes] == pytest.approx(sums)


def test_lists_of_an_article_stay():
    links = "<ul>" + "".join(f"<li><a href=x>Source {k}</a></li>" for k in range(4)) + "</ul>"
    for around in ("article", "main"):
        text = html_text.extract(f"<body><nav>{links}</nav><{around}><h1>T</h1><p>{WORDS}</p>{links}<p>{WORDS}</p></{around}>{links}</body>")
        assert [w for w in text.split() if w != "word"] == ["T", *("Source 0 Source 1 Source 2 Source 3".split())]


@pytest.mark.parametrize("tag", ["svg", "select", "noscript", "object", "template", "video", "canvas"])
def test_unclosed_elements_do_not_swallow_the_page(tag):
    assert html_text.extract(f"<body><article><p>First part.</p><{tag}><p>{WORDS}</p></article></body>").split() == ["First", "part.", *WORDS.split()]


def test_deep_pages_take_time_in_proportion():
    began = time.perf_counter()
    for what in ("<b>", "<svg>", "<p>a</p>", "<i><b>x</i>"):
        html_text.extract("<body>" + what * 20_000 + "text")
    assert time.perf_counter() - began < 20
