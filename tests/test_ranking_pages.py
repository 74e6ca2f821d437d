"""Ranking pages: every page of a day is read, and pages stay small however many players a day ranks."""

from __future__ import annotations

import datetime

from pointline.catalog import ingest
from pointline.sources import pages


def test_all_pages_of_a_day_are_read(spark):
    row = lambda rank, who, points: f'<tr class="x"><td>{rank}</td><td><a href="/en/players/n/{who}/overview">N &amp; <b>{who}</b></a></td><td>{points}</td></tr>'
    menu = '<table><tr><td>menu</td></tr></table>'
    day = datetime.date(2001, 1, 1)
    first = menu + "<table>" + row(1, "ab1", "1,200") + row(300, "ab2", "9") + row("99999", "ab3", "1") + "<tr><td>5</td><td>nobody</td></tr></table><table>" + row(2, "zz9", "7") + "</table>"
    second = "<table>" + row(3, "cd4", "-") + row("x", "cd5", "1")
    got = pages.ranking_rows(spark.createDataFrame([(day, first), (day, second), (day, menu), (day, None)], "ranking_date date, html string"), 200).collect()
    assert sorted(map(tuple, got)) == [(day, 1, "AB1", "N & ab1", 1200), (day, 3, "CD4", "N & cd4", None)]


def test_pages_hold_no_more_rows_than_their_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pages, "ranking_rows", lambda page, limit: seen.append(page) or page)
    ingest.ranking_page_rows(spark, "/root/testdata/sf0.01")
    sizes = seen[0].selectExpr("size(split(html, '<tr>')) - 2 AS n").agg({"n": "max"}).first()[0]
    assert 0 < sizes <= ingest.PAGE
