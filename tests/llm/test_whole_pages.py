"""Page differencing gets every line of a page, those of articles too, and aligns every page."""

from __future__ import annotations

from pointline.llm import htmltext
from pointline.llm.htmltext import extract_text, line_hashes, page_blocks

PAGE = "<nav>menu</nav><p>top</p><article><p>told</p><p>top</p><div class='alert'>warned</div></article>"


def test_all_lines_are_hashed():
    own = page_blocks(PAGE)
    lines, asked = line_hashes(own)
    assert [x for x, _ in own] == ["menu", "top", "told", "top", "warned"]
    # equal lines inside and outside of an article aren't the same to the alignment
    assert len(lines) == len(set(lines)) == 5
    assert asked == [False, False, False, False, True]


def test_an_article_that_neighbours_repeat_stays_and_shared_frame_goes(spark):
    pages = [(k, f"http://h/{k}", f"<p>top</p><p>own {k}</p>" if k % 4 == 0 else f"<p>top</p><article><p>copied</p><div class='alert'>warned</div><p>own {k}</p></article>") for k in range(12)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"own {k}" for k in range(0, 12, 4))
    assert all(got[k].startswith("copied\n") and got[k].endswith(f"own {k}") for k in range(12) if k % 4)
    assert "warned" not in got[2]  # beside it, in the order of paths, are 10, 11, 3 and 4


def test_longest_alignment_of_whole_pages():
    one, two = (line_hashes(page_blocks(PAGE.replace("told", t)))[0] for t in ("told", "other"))
    assert htmltext.aligned(one, two) == [0, 1, 3, 4]
