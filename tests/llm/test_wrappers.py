"""What wrappers decide: the part of a page, and standing blocks inside and outside an article."""

import random

from tidemark.llm import html

RNG = random.Random(9)


def words(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def pages(outer, inner, n=12):
    """Pages of one host: a standing paragraph in the part, a large standing block and a short menu around it."""
    rows = []
    for i in range(n):
        own = [words(30) for _ in range(3)]
        body = f"<{inner}><p>{own[0]}</p><p>We thank our readers.</p><p>{own[1]}</p><p>{own[2]}</p></{inner}>"
        page = f"<html><body><div class='x1'><p>{'standing text of the site ' * 40}</p></div><{outer}>{body}</{outer}><nav><a href='#'>Menu</a></nav></body></html>"
        rows.append((i, f"http://h.org/{i}", page, own))
    return rows


def extracted(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "page_id int, url string, html string").repartition(3)
    return {r["page_id"]: r["text"].split("\n\n") for r in html.extract_text(docs).collect()}


def test_a_standing_block_stays_in_an_article(spark):
    rows = pages("div", "article")
    found = extracted(spark, rows)
    assert all(found[i] == [own[0], "We thank our readers.", own[1], own[2]] for i, _, _, own in rows)


def test_a_standing_block_outside_an_article_goes(spark):
    rows = pages("section", "div")
    found = extracted(spark, rows)
    assert all(found[i] == own for i, _, _, own in rows)


def test_the_wrapper_and_not_the_declaration_decides_on_a_host_of_many_pages(spark):
    """An article element around a standing text: what differs between pages is the main text."""
    rows = []
    for i in range(8):
        own = [words(30), words(30)]
        page = f"<html><body><article><p>{'the same welcome text ' * 30}</p></article><div><p>{own[0]}</p><p>{own[1]}</p></div></body></html>"
        rows.append((i, f"http://h.org/{i}", page, own))
    found = extracted(spark, rows)
    assert all(found[i] == own for i, _, _, own in rows)
    alone = html.main_text(rows[0][2])
    assert alone.startswith("the same welcome text")
