"""Review pages in both layouts, with missing fields and decoys."""

from reviewloom.sources.pages import extract_records, review_records

TIP = '<aside class="gd-ui-tooltip-info toolTip tooltip css-15sm7sw e1mbtzkk0"></aside>'
PAGE = f"""<html><script>var x='<li class="noBorder empReview cf pb-0 mb-0" id="fake">';</script><ol>
<li class="noBorder empReview cf pb-0 mb-0" id="empReview_1"><a class="reviewLink" href="#">"Great &amp; fun"</a>
<span class="ratingNumber mr-xsm">4.0</span>{TIP}<div class="tooltipContainer"><span></span><div>
<div>Work/Life Balance</div><div class="css-94nhxw e1">x</div><div>Culture &amp; Values</div><div class="css-zzz"></div></div></div>
<span class="authorInfo"><span>May 1, 2021 - Engineer</span></span><span class="authorLocation">Austin, TX</span>
<span data-test="pros">Good
food</span><span data-test="cons">Long hours</span></li>
<li id="empReview_2" class="noBorder empReview cf pb-0 mb-0">
<span class="common__EiReviewDetailsStyle__newUiJobLine"><span>Jun 2, 2022 - Analyst&nbsp;in Boston, MA</span></span>
<span data-test="pros">ok</span></li></ol></html>"""


def test_review_records(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<html></html>"), (3, None)], "page int, html string")
    one, two = review_records(pages, "page", "html").orderBy("review_id").collect()
    assert (one["review_id"], one["summary"], one["overall_rating"]) == ("empReview_1", '"Great & fun"', "4.0")
    assert (one["date"], one["job_title"], one["author_location"]) == ("May 1, 2021", "Engineer", "Austin, TX")
    assert (one["pros"], one["cons"]) == ("Good\nfood", "Long hours")
    assert (one["wl_balance"], one["culture_values"], one["senior_management"]) == ("4", "-", "-")
    assert (two["date"], two["job_title"], two["author_location"]) == ("Jun 2, 2022", "Analyst", "Boston, MA")
    assert (two["summary"], two["overall_rating"], two["cons"], two["wl_balance"]) == ("-", "-", "-", "-")


def test_generic_records_keep_position(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><!-- <p>no</p> --><p>a</p><p><b>B</b> c</p>")], "page int, html string")
    got = extract_records(pages, "page", "html", r"(?s)<p>(.*?)</p>", {"lead": ["<b>(.*?)</b>"]}, {"title": ["<h1>(.*?)</h1>"]})
    assert [tuple(r) for r in got.orderBy("position").collect()] == [(1, 0, "T", "-"), (1, 1, "T", "B")]
