"""Queries without SQL: their rows against plain Python."""

import os
import re
from collections import defaultdict

import pytest

from storyloom.functions import text
from storyloom.operators import pagination
from storyloom.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()


def test_titles(spark):
    def without(title, patterns):
        out = title.strip()
        for p in patterns:
            out = re.sub(p, "", out).strip()
        out = re.sub(r"\s+", " ", out)
        for entity, char in text.ENTITIES:
            out = out.replace(entity, char)
        return out.strip() or title.strip()

    def valid(title):
        t, low = title.strip(), title.strip().lower()
        if not 2 <= len(t) <= 200 or t in text.BAD_TITLES or any(p.lower() in low for p in text.BAD_TITLE_PARTS):
            return False
        if any(re.search(p, t) for p in text.BAD_TITLE_PATTERNS):
            return False
        return bool(re.search(text.CJK, t) or re.search("[a-zA-Z]{3,}", t) or re.search(text.CHAPTER_NUMBER, t))

    pages = {r.page_id: re.search("(?is)<title>(.*?)</title>", r.html)[1] for r in table(spark, "pages")}
    found = {r.page_id: r for r in QUERIES["title_cleaning"](spark, SF_DIR).collect()}
    assert set(found) == set(pages)
    for i, title in pages.items():
        trimmed = re.sub("<[^>]*>", "", without(title, text.TITLE_REMOVE)).strip(text.TITLE_EDGES)
        chapter = trimmed if valid(trimmed) else ""
        wanted = (without(title, text.TITLE_REMOVE), without(title, (*text.TITLE_REMOVE, *text.NOVEL_TITLE_REMOVE)), chapter, valid(title))
        assert (found[i].title, found[i].novel_title, found[i].chapter_title, found[i].valid) == wanted


def test_pages_of_texts(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents")}
    pages = defaultdict(dict)
    for r in QUERIES["paginate_by_size"](spark, SF_DIR).collect():
        pages[r.doc_id][r.page] = r.content
    for i, whole in docs.items():
        cut = [pages[i][k] for k in range(len(pages[i]))]
        assert cut == pagination.pages_by_size(whole, 3000) and all(len(p) <= 3000 + pagination.PARAGRAPH_AHEAD for p in cut)
        # pages hold the text in order; only the blank lines that they end at are gone
        assert re.sub(r"\s", "", "".join(cut)) == re.sub(r"\s", "", whole)
    for r in QUERIES["paginate_by_number"](spark, SF_DIR).collect():
        cut = pagination.pages_by_number(docs[r.doc_id], 2)
        assert (r.pages, r.last_page) == (len(cut), cut[-1]) and len(cut) <= 2


def test_reader(spark):
    turns = defaultdict(dict)
    for r in table(spark, "conversations"):
        turns[r.conv_id][r.turn] = r.text
    books = {r.o_orderkey for r in table(spark, "orders")}
    found = QUERIES["reader_chapter"](spark, SF_DIR).collect()
    assert len(found) == sum(map(len, turns.values()))
    assert len({tuple(r.books) for r in found}) == 1 and len(set(found[0].books)) == 5 and set(found[0].books) <= books
    for r in found:
        own, whole = turns[r.novel_id], turns[r.novel_id][r.sort_order]
        assert r.prev_id == max((t for t in own if t < r.sort_order), default=None)
        assert r.next_id == min((t for t in own if t > r.sort_order), default=None)
        cut = [pagination.pages_by_size(whole, 300), pagination.pages_by_number(whole, 2), [whole]][r.novel_id % 3]
        assert (r.n_pages, r.page_text) == (len(cut), cut[min(2, len(cut)) - 1])


def test_bodies_and_catalogs_of_pages(spark):
    pages = {r.page_id: r for r in table(spark, "pages")}
    for r in QUERIES["html_body"](spark, SF_DIR).collect():
        bare = re.sub(r"<[^>]+>", "", pages[r.page_id].html.replace("&amp;", "&"))
        assert r.body and all(w in bare for w in r.body.split())
    rows = QUERIES["html_catalog"](spark, SF_DIR).collect()
    # no heading stands before a page's links, which lie in its frame
    assert len(rows) == sum(len(re.findall("<a href=", p.html)) for p in pages.values()) and {r.volume for r in rows} == {None}


def test_calls_are_admitted_in_order(spark):
    calls = defaultdict(list)
    for r in QUERIES["rate_limit_replay"](spark, SF_DIR).collect():
        calls[r.task_id].append((r.ts.timestamp(), r.event_id, r.allowed))
    assert sum(map(len, calls.values())) == len(table(spark, "events"))
    for own in calls.values():
        admitted: list[float] = []
        for at, _, allowed in sorted(own):
            assert allowed == (sum(at - t < 21_600 for t in admitted) < 5)
            if allowed:
                admitted.append(at)


def test_samples_and_generated_rows(spark):
    sample = QUERIES["random_sample5"](spark, SF_DIR).collect()
    assert len({r.id for r in sample}) == 5 and {r.id for r in sample} <= {r.o_orderkey for r in table(spark, "orders")} - {1}
    assert QUERIES["synthetic_sites"](spark, SF_DIR).select("domain").distinct().count() == 1000
    assert QUERIES["synthetic_requests"](spark, SF_DIR).count() == 10_000
