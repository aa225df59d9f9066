"""Legacy archives (op1) and main text (op2)."""

import hashlib
import json
import random
import time

import pytest

from roadcast.llm import legacy_archive as A
from roadcast.llm import wrapper as W

PAGES = "page_id long, url string, html string, text string, n int"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_declared_lengths_survive_hostile_payloads(version):
    bodies = [None, "", "x\n\nhttp://a 0.0.0.0 20000101000000 text/html 5\nhello\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é" * 4000]
    rows = [(i, f"http://h/{i} with space", b) for i, b in enumerate(bodies)] + [(None, None, "n")]
    found = [A.warc_fields(d) for d in A.parse_arc(A.pages_to_arc(rows, version, "t.arc"))]
    assert [f["page_id"] for f in found] == [0, 1, 2, 3, 4, None]
    for f, (_, _, body) in zip(found, rows):
        raw = (body or "").encode()
        assert f["payload_bytes"] == len(raw) and f["payload_digest"] == hashlib.sha1(raw).hexdigest()
    assert found[0]["uri"] == "http://h/0%20with%20space" and found[5]["uri"] == "urn:page:None"
    assert found[0]["date"] == "2001-02-03T04:05:06Z"


def test_arc_cut_off_gives_whole_records_only():
    whole = A.pages_to_arc([(1, "http://a/", "first"), (2, "http://b/", "second")], 2, "t.arc")
    assert [A.warc_fields(d)["page_id"] for d in A.parse_arc(whole[:-4])] == [1]


def test_arc_wrong_field_count_is_an_error():
    with pytest.raises(ValueError):
        list(A.parse_arc(b"http://a/ text/html 3\nabc\n"))


def test_round_trip_against_brute_force(spark):
    big, other = "a" * 1200, "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://b/", "short"), (4, "http://b/", "short"), (5, "u", None), (6, "u", ""),
            (7, "http://c/", other), (8, "http://c/", other + " "), (7, "http://c/", other)]
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                 for r in A.round_trip(spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)).collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(j for j, _, g in rows if (g or "").encode() == raw)
        old = len(raw) >= 1000 and i < top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", top if old else None))
    assert got == sorted(want)


def test_round_trip_of_an_empty_table(spark):
    assert A.round_trip(spark.createDataFrame([], PAGES)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>menu</a></nav>
<div class="cookie-banner">We use cookies</div><aside>side</aside><article><header><h1>Title &amp; more</h1></header><p>One   <b>bold</b>
line.<p>Two&nbsp;words<br>here<script>var t="</p>"</script><form>sign up</form><div id="ad-1">buy</div>
<ul><li>x<li>y</ul><!-- c --><section class="comments"><p>nice!</p></section></article><footer>&copy; me</footer></body></html>"""


def test_main_text_drops_what_is_not_the_article():
    assert W.main_text(PAGE) == "Title & more\nOne bold line.\nTwo words here\nx\ny"


@pytest.mark.parametrize("page,text", [("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><p>cut off <a hre", "cut off"),
                                       ("1 < 2 & 3", "1 < 2 & 3"), ("<div><nav>open menu<p>x</div><p>y", "y"), ("</p></div>z", "z")])
def test_main_text_of_odd_pages(page, text):
    assert W.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ('<p class="a"">one</p><p>two</p>', "one\ntwo"), ("<p>x</p><b it's>y</b><p>two</p><p>three", "x\ny\ntwo\nthree"),
    ('<div class="content no-sidebar"><p>text</p></div>', "text"), ('<div class="post has-comments"><article><p>text</p></article></div>', "text"),
    ('<div id="sidebar-layout"><main><p>text</p></main></div>', "text"), ('<div class="menu-page"><p>' + "long text " * 9 + '</p></div><p>end</p>', ("long text " * 9).strip() + "\nend"),
    ('<p>' + "long text " * 9 + '</p><div class="sidebar"><p>side</p></div>', ("long text " * 9).strip())])
def test_main_text_keeps_what_follows_bad_quotes_and_telling_names(page, text):
    assert W.main_text(page) == text


def test_comments_marked_as_articles_and_open_adverts_stay_out():
    assert W.main_text("<article><p>story</p></article><div class='comments'><article>first!</article></div>") == "story"
    assert W.main_text("<p class='ad'>buy<p>text") == "text"


@pytest.mark.parametrize("advert", ['<div class="ad">x</div>', '<div class="ad">x', '<p class="ad">y<i>z', "<b>"])
def test_pages_of_many_elements_take_linear_time(advert):
    start = time.perf_counter()
    assert W.main_text(advert * 20_000 + "<article><p>story</p></article>") == "story"
    assert time.perf_counter() - start < 20  # quadratic: minutes


def test_deep_pages_are_read_and_aligned_whole():
    page = "<div>" * 5_000 + "deep <p>word</p>" + "</div>" * 5_000 + "<p>after</p>"
    assert W.main_text(page) == "deep\nword\nafter"
    one, other = (W.as_wrapper(W.blocks(p)[0]) for p in (page, page + "<p>more</p>"))
    both = json.loads(json.dumps(W.merge(one, other)))
    assert len(W._slots(both)) == 4 and both[1] == 2
    many = one
    for _ in range(7):
        many = W.merge(many, one)
    assert W.template_slots(one, W.constant_part(many, 8)) == {0, 1, 2}


def test_simple_tree_matching_counts_agreeing_nodes():
    a = W.as_wrapper([(("div", "p"), "x", 0), (("div", "h1"), "y", 0)])
    b = W.as_wrapper([(("div", "p"), "z", 0), (("div", "p"), "x", 0), (("div", "h1"), "y", 0)])
    merged = W.merge(a, b)
    slots = [n for n in merged[2][0][2]]
    assert [n[0] for n in slots] == ["p", "p", "h1"] and [n[1] for n in slots] == [1, 2, 2]
    assert slots[1][2][0][2] is not None  # the same text in both


def test_constant_slots_of_a_host_are_template(spark):
    rows = [(i, f"https://host.example/{i}", f"<body><div><p>Welcome to our site</p><p>Story number {i} {'word ' * 30}{i * 7}</p><p>All about us</p></div></body>", "t", 1)
            for i in range(12)]
    rows += [(100 + i, "https://copies.example/", "<article><p>same text</p><p>on every page</p></article>", "t", 1) for i in range(8)]
    rows += [(200, None, "<p>no host</p>", "t", 1), (201, "https://lonely.example/", None, "t", 1), (201, "https://lonely.example/", None, "t", 1)]
    got = {}
    for r in W.extracted(spark.createDataFrame(rows, PAGES)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for i in range(12):
        assert got[i] == [f"Story number {i} {'word ' * 30}{i * 7}"]
    assert got[100] == ["same text\non every page"] and got[200] == ["no host"] and got[201] == ["", ""]


def test_one_deviating_page_leaves_the_template_as_it_is(spark):
    def greeting(i):
        return "Good evening" if i in (3, 17) else "Welcome to our site"

    rows = [(i, "https://host.example/", f"<div><p>{greeting(i)}</p><p>Story {i} {'word ' * 30}{i * 7}</p><p>All about us</p></div>", "t", 1) for i in range(24)]
    # half of the pages have the same text, more than the counters can tell from the other texts
    rows += [(100 + i, "https://half.example/", f"<div><p>{'Half of all' if i % 2 == 0 else f'greeting {i}'}</p><p>Story {i} {'word ' * 30}</p></div>", "t", 1) for i in range(60)]
    got = {r.page_id: r.text for r in W.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == ("Good evening\n" if i in (3, 17) else "") + f"Story {i} {'word ' * 30}{i * 7}" for i in range(24))
    assert all("Half of all" not in got[100 + i] for i in range(60))


@pytest.mark.parametrize("mixed", [False, True])
def test_long_pages_align_as_short_ones_do(mixed):
    long = [(("div", "p"), f"item {k}", 0) for k in range(700)]
    if mixed:
        long[5] = (("div", "ul", "li"), "in a list", 0)
    a = W.as_wrapper([*long, (("div", "p"), "All about us", 0), (("div", "h2"), "Contact", 0)])
    b = W.as_wrapper([*long[:3], (("div", "p"), "inserted", 0), *long[3:], (("div", "p"), "All about us", 0), (("div", "h2"), "Contact", 0)])
    merged = W.merge(a, b)[2][0][2]
    assert len(merged) == 703 and [n[1] for n in merged].count(1) == 1
    assert merged[3][1] == 1 and all(len(n) == 3 for n in W._slots(["", 1, merged]))  # no slot met two texts


def test_alignment_by_halves_has_the_score_of_the_table(monkeypatch):
    rng = random.Random(4)
    for _ in range(40):
        x, y = (tuple(rng.choice(["p", "h2", "li"]) for _ in range(rng.randint(2, 14))) for _ in range(2))
        xs, ys = ([rng.randrange(4) for _ in z] for z in (x, y))

        def score(pairs):
            assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            return sum(2.5 if xs[i] == ys[j] else 2 for i, j in pairs if x[i] == y[j])

        whole = score(W._plain_pairs(x, y, xs, ys))
        monkeypatch.setattr(W, "CELLS", 0)
        assert score(W._plain_pairs(x, y, xs, ys)) == whole
        monkeypatch.undo()


def test_wrapper_join_without_broadcast_is_the_same(spark, monkeypatch):
    rows = [(i, "https://h/", f"<div><p>fixed</p><p>{'v ' * 20}{i}</p></div>", "t", 1) for i in range(9)]
    df = spark.createDataFrame(rows, PAGES)
    one = sorted(map(tuple, W.extracted(df).collect()))
    monkeypatch.setattr(W, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, W.extracted(df).collect())) == one and "fixed" not in one[0][2]


def test_main_text_of_an_empty_table(spark):
    assert W.extracted(spark.createDataFrame([], PAGES)).count() == 0
